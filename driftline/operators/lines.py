"""Line operators: cleaning, dedupe, paragraphs, segments and chunks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT
from driftline.functions import predicates as p
from driftline.functions import text as t
from driftline.operators import line_folds


def explode_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: trimmed lines that aren't blank, numbered as they were."""
    d = docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return d.select(key, "pos", F.trim("line").alias("line")).where("line <> ''")


def line_frequency(lines: DataFrame, key: str) -> DataFrame:
    fp = t.fingerprint(F.col("line"))
    return lines.withColumn("fp", fp).withColumn("freq", F.count("*").over(Window.partitionBy(key, "fp")))


def drop_boilerplate(lines: DataFrame, key: str) -> DataFrame:
    """Of short interface-like lines that repeat in a document, the first only; lines of no letter or digit all stay."""
    f = line_frequency(lines, key)
    repeats = (F.col("fp") != "") & (F.col("freq") >= DEFAULT.boilerplate_freq) & (F.length("line") <= DEFAULT.boilerplate_chars) & p.ui_like(F.col("line"))
    so_far = Window.partitionBy(key, "fp").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = f.withColumn("__ui", repeats).withColumn("__nth", F.sum(F.col("__ui").cast("int")).over(so_far))
    return f.where(~(F.col("__ui") & (F.col("__nth") > 1))).drop("__nth", "__ui", "freq", "fp")


def dedupe_exact(lines: DataFrame, key: str) -> DataFrame:
    """First of equal lines in each document; lines of white space alone all stay."""
    w = Window.partitionBy(key, "k").orderBy("pos")
    return lines.withColumn("k", t.exact_key(F.col("line"))).withColumn("nth", F.row_number().over(w)).where("nth = 1 or k = ''").drop("k", "nth")


def char_budget(lines: DataFrame, key: str, chars: int, n_lines: int) -> DataFrame:
    """The start of each document: so many lines at most, and of these so many characters, newlines between them included."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("used", F.sum(F.length("line") + 1).over(w) - 1).withColumn("nth", F.count("*").over(w)).where((F.col("used") <= chars) & (F.col("nth") <= n_lines)).drop("nth")


def _lines_of(docs: DataFrame, key: str, text: str, fold: Callable[[str | None], list[str]]) -> DataFrame:
    """key, pos, line: each document's lines from one pass over its text in the row."""
    return docs.select(key, F.posexplode(_udf(fold, "array<string>")(F.col(text))).alias("pos", "line"))


def clean_dom(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: the DOM line pipeline."""
    return _lines_of(docs, key, text, line_folds.dom_lines)


def paragraph_index(lines: DataFrame, key: str) -> DataFrame:
    """Adds ``para``: 1, 2, ... over runs between blank or <PARA> lines, null on those."""
    edge = (F.trim("line") == "") | (F.trim("line") == "<PARA>")
    w = Window.partitionBy(key).orderBy("pos")
    start = F.when(~edge & F.coalesce(F.lag(edge).over(w), F.lit(True)), 1).otherwise(0)
    d = lines.withColumn("__edge", edge).withColumn("__start", start)
    n = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("para", F.when(~F.col("__edge"), n)).drop("__edge", "__start")


def fixed_chunks(lines: DataFrame, key: str, size: int = 24, overlap: int = 0) -> DataFrame:
    """key, chunk, from_line, to_line, text: windows of ``size`` lines."""
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / step)).cast("int")
    numbered = lines.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    at = numbered.select(key, "n", "line", F.explode(F.sequence(first, F.floor(F.col("n") / step).cast("int"))).alias("chunk")) if overlap else numbered.select(key, "n", "line", F.floor(F.col("n") / step).cast("int").alias("chunk"))
    g = at.groupBy(key, "chunk").agg(F.min("n").alias("from_line"), F.max("n").alias("to_line"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    return g.select(key, "chunk", "from_line", "to_line", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def range_errors(chunks: DataFrame, key: str) -> DataFrame:
    """key, from_line, to_line, error: null, hole, overlap or order of each range after the one before."""
    before = F.lag("to_line", 1, -1).over(Window.partitionBy(key).orderBy("from_line", "to_line"))
    c = chunks.withColumn("before", before)
    error = F.when(F.col("to_line") < F.col("from_line"), "order").when(F.col("from_line") > F.col("before") + 1, F.concat(F.lit("hole:"), F.col("before") + 1, F.lit(".."), F.col("from_line") - 1)).when(F.col("from_line") <= F.col("before"), "overlap")
    return c.withColumn("error", error).drop("before")


def unique_keys(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Slug keys of titles, numbered from the second of a kind on."""
    c = chunks.withColumn("slug", t.slug(F.col("title")))
    n = F.row_number().over(Window.partitionBy(key, "slug").orderBy(order))
    return c.withColumn("chunk_key", F.when(n > 1, F.concat("slug", F.lit("-"), n.cast("string"))).otherwise(F.col("slug"))).drop("slug")


# --- folds over one document's lines, which no window expresses


#: Rows of a batch that are Python objects at a time.
ROWS_AT_ONCE = 64


def _udf(f: Callable, schema: str):
    """``f`` of each row; values and results are Python objects for a few rows at a time, Arrow's for the others."""

    def run(*columns: pa.Array) -> pa.Array:
        some = lambda i: zip(*(c.slice(i, ROWS_AT_ONCE).to_pylist() for c in columns))
        return pa.concat_arrays([pa.array([f(*row) for row in some(i)], run.type) for i in range(0, max(1, len(columns[0])), ROWS_AT_ONCE)])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    run.type = to_arrow_type(_parse_datatype_string(schema))
    return F.arrow_udf(run, schema)


def dedupe_sliding(lines: Column, window: int = DEFAULT.dedupe_window) -> Column:
    """Array of lines without those whose key, unless empty, was kept at most ``window`` positions ago."""
    fold = _udf(lambda ls, ks: [x for x, k in zip(ls or [], line_folds.keep_within_window(ks or [], window)) if k], "array<string>")
    return fold(lines, F.transform(lines, t.exact_key))


def wrap_single(text: Column, width: int = DEFAULT.wrap_at) -> Column:
    """Lines of a text; one that has no newline though it is long gets wrapped."""
    wrapped = _udf(lambda x: line_folds.wrap_words(x, width), "array<string>")(text)
    return F.when(F.contains(text, F.lit("\n")) | (F.length(text) < max(600, 3 * width)), F.split(text, "\n")).otherwise(wrapped)


def cut_long_lines(lines: Column) -> Column:
    return _udf(lambda ls: [y for x in ls or [] for y in line_folds.pieces_of(x or "", DEFAULT.line_most)], "array<string>")(lines)


def without_json_blobs(text: Column) -> Column:
    return _udf(lambda x: None if x is None else line_folds.without_state(x), "string")(text)


def sanitised(text: Column) -> Column:
    return _udf(line_folds.sanitised, "string")(text)


def candidate_lines(text: Column) -> Column:
    """Lines of a text that is broken where it has too few breaks, blank ones left out."""
    return _udf(lambda x: [y for y in map(str.strip, line_folds.candidate_lines(x).split("\n")) if y], "array<string>")(text)


def common_form(text: Column) -> Column:
    return _udf(lambda x: None if x is None else line_folds.common_form(x), "string")(text)


SEGMENT = "array<struct<kind: string, from_line: int, to_line: int, text: string>>"


def build_segments(lines: list[str] | None, kinds: list[str] | None, wrap_at: int) -> list[dict]:
    """Headings and tokens alone, runs of list items together, wrapped lines joined again."""
    out: list[dict] = []
    for i, (x, kind) in enumerate(zip(lines or [], kinds or [])):
        if kind == "blank":
            continue
        last = out[-1] if out else None
        follows = last is not None and last["to_line"] == i - 1
        if kind == "list" and follows and last["kind"] == "list":
            last["text"] += "\n" + x
        elif kind in ("text", "sentence") and follows and last["kind"] == "text" and _joins(last["text"], wrap_at):
            last["text"] = last["text"][:-1] + x.strip() if last["text"].endswith("-") else last["text"] + " " + x.strip()
        else:
            out.append({"kind": kind if kind in ("heading", "token", "list") else "text", "from_line": i, "to_line": i, "text": x})
            continue
        last["to_line"] = i
    return out


def _joins(text: str, wrap_at: int) -> bool:
    bare = text.rstrip()
    ends = bare.rstrip("\"'”)]")[-1:] in ".!?" and bool(bare)
    return not ends and (bare[-1:] in ",;:-" or len(text) >= max(40, 0.6 * wrap_at))


def segments(lines: Column, wrap_at: int = DEFAULT.wrap_at) -> Column:
    return _udf(lambda ls, ks: build_segments(ls, ks, wrap_at), SEGMENT)(lines, F.transform(lines, p.line_kind))


def merge_short(segs: list[dict] | None, anchor: int = DEFAULT.one_liner_chars) -> list[dict]:
    """Headings and short one-liners go in front of the next longer segment; a rest goes to the last."""
    out: list[dict] = []
    held: list[dict] = []
    join = lambda ss, kind: {"kind": kind, "from_line": ss[0]["from_line"], "to_line": ss[-1]["to_line"], "text": "\n".join(s["text"] for s in ss)}
    for s in segs or []:
        if s["kind"] in ("heading", "token") or ("\n" not in s["text"] and len(s["text"]) < anchor):
            held.append(s)
        else:
            out.append(join([*held, s], s["kind"]))
            held = []
    if held:
        out = [*out[:-1], join([out[-1], *held], out[-1]["kind"])] if out else [join(held, "text")]
    return out


def merged_segments(segs: Column) -> Column:
    return _udf(merge_short, SEGMENT)(segs)


def pack_segments(segs: list[dict] | None, most: int, least: int, n_most: int) -> list[dict]:
    """Greedy packing towards equal sizes; chunks with ids, line spans and numbered paragraphs."""
    segs = segs or []
    total = sum(len(s["text"]) + 2 for s in segs)
    target = -(-total // max(1, min(50, -(-total // most))))
    out: list[dict] = []
    size = count = 0
    for i, s in enumerate(segs):
        n = len(s["text"]) + 2
        if not out or count >= n_most or (count and size + n > most) or (size >= target and size >= least):
            out.append({"id": f"c_lines_{len(out) + 1:02d}", "from_line": s["from_line"], "to_line": s["to_line"], "text": ""})
            size = count = 0
        c = out[-1]
        c["text"] += ("\n" if c["text"] else "") + f"[P{i + 1:03d}] {s['text']}"
        c["to_line"] = s["to_line"]
        size, count = size + n, count + 1
    return out


CHUNK = "array<struct<id: string, from_line: int, to_line: int, text: string>>"


def packed_chunks(segs: Column) -> Column:
    return _udf(lambda s: pack_segments(s, DEFAULT.pack_most, DEFAULT.pack_least, DEFAULT.pack_segments), CHUNK)(segs)


def apply_template(text: str | None, anchors: list[list[str]] | None) -> list[dict]:
    """Chunks from each anchor found, in order, to the next; with how many were found."""
    import re

    text, at, starts = text or "", 0, []
    for k, options in enumerate(anchors or []):
        best = None
        for a in options or []:
            words = re.findall(r"\w+", a)
            m = re.compile(r"[\W_]+".join(map(re.escape, words)), re.I).search(text, at) if words else None
            if m and (best is None or (m.start(), -len(m.group())) < (best.start(), -len(best.group()))):
                best = m
        if best:
            starts.append((k, best.start()))
            at = best.end()
    ends = [s for _, s in starts[1:]] + [len(text)]
    return [{"anchor": k, "start": s, "text": text[s:e].strip()} for (k, s), e in zip(starts, ends)]


def template_chunks(text: Column, anchors: Column) -> Column:
    return _udf(apply_template, "array<struct<anchor: int, start: int, text: string>>")(text, anchors)


def template_fit(text: Column, anchors: Column) -> Column:
    return F.when(F.size(anchors) > 0, F.size(template_chunks(text, anchors)) / F.size(anchors)).otherwise(0.0)


def pair_snippets(before: str | None, after: str | None, around: int = 140) -> list[dict]:
    """What lies between the common start and end of two texts, with some context."""
    a, b = before or "", after or ""
    if a == b:
        return []
    most = min(len(a), len(b))
    pre = next((i for i in range(most) if a[i] != b[i]), most)
    post = next((i for i in range(most - pre) if a[len(a) - 1 - i] != b[len(b) - 1 - i]), most - pre)
    cut = lambda t: t[max(0, pre - around) : max(pre, len(t) - post) + around]
    return [{"before": cut(a), "after": cut(b)}]


def snippets(before: Column, after: Column) -> Column:
    return _udf(pair_snippets, "array<struct<before: string, after: string>>")(before, after)


def split_lines(text: str | None, width: int = DEFAULT.wrap_at) -> list[str]:
    """Lines of text without newlines: parts at bullets, double spaces and pipes, wrapped softly.

    Continued list items keep their indent.
    """
    import re

    if not text:
        return []
    raw = text.split("\n") if "\n" in text else re.split(r"\s{2,}|\s*\|\s*|\s+(?=[•▪]\s)", text)
    out: list[str] = []
    for line in raw:
        pad = " " * len(m.group()) if (m := re.match(r"\s*(?:[-*•▪]|\d{1,3}[.)])\s+", line)) else ""
        first = True
        while len(line) > width:
            at = line.rfind(" ", int(0.6 * width), width)
            at = at if at > 0 else width
            out.append(line[:at].rstrip() if first else pad + line[:at].strip())
            line, first = line[at:].lstrip(), False
        if line.strip():
            out.append(line.rstrip() if first else pad + line.strip())
    return out


def soft_lines(text: Column) -> Column:
    return _udf(split_lines, "array<string>")(text)


def clean_ocr(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: the recognised-text pipeline."""
    return _lines_of(docs, key, text, line_folds.ocr_lines)


def uniq_ranges(ranges: list[tuple[int, int]] | None, n: int) -> list[tuple[int, int]]:
    """Ranges within [0, n) that don't overlap an earlier one."""
    out: list[tuple[int, int]] = []
    for a, b in ranges or []:
        a, b = max(0, a), min(n, b)
        if a < b and all(b <= x or a >= y for x, y in out):
            out.append((a, b))
    return out


def common_affix(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common start and, in what is left, the common end."""
    most = min(len(a), len(b))
    pre = next((i for i in range(most) if a[i] != b[i]), most)
    post = next((i for i in range(most - pre) if a[len(a) - 1 - i] != b[len(b) - 1 - i]), most - pre)
    return pre, post
