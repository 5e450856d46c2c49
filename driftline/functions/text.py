"""String functions as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a web page means it: with no-break space and byte order mark.
WS = r"[\s\x{00A0}\x{FEFF}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
CONTROLS = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}\x{2500}-\x{257F}]"
BULLET = r"^\s*(?:[-*•]|\d{1,3}[.)])\s+"


def let(x: Column, f) -> Column:
    """``f`` of ``x``, evaluated once.

    An expression that stands inside a lambda is evaluated for each element,
    and one that a filter repeats is evaluated each time; a bound one isn't.
    """
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(x, f"{WS}+", " "))


def squeeze_strict(x: Column) -> Column:
    return F.coalesce(squeeze(x), F.lit(""))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def blank_to(x: Column, fallback: str) -> Column:
    return F.coalesce(blank_to_null(x), F.lit(fallback))


def clamp_ellipsis(x: Column, most: int = 20_000) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("…"))).otherwise(x)


def clamp_marked(x: Column, most: int = 8_000) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("\n...[TRUNCATED]"))).otherwise(x)


def excerpt(x: Column, most: int = 220) -> Column:
    return F.left(squeeze_strict(x), F.lit(most))


def slug(x: Column, most: int = 48, empty: str = "chunk") -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(x), r"\p{Mn}+", ""), r"[^\p{L}\p{N}]+", "-")
    return F.left(F.coalesce(F.nullif(F.regexp_replace(dashed, r"^-+|-+$", ""), F.lit("")), F.lit(empty)), F.lit(most))


def _normalised(form: str):
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in x.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def slug_ascii(x: Column) -> Column:
    """Accents stripped by decomposition, the rest dashed."""
    bare = F.regexp_replace(_normalised("NFKD")(x), r"\p{Mn}+", "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def decode_entities(x: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def strip_zero_width(x: Column) -> Column:
    return F.regexp_replace(x, ZERO_WIDTH, "")


def split_letters_digits(x: Column) -> Column:
    letter = "A-Za-ząćęłńóśźżĄĆĘŁŃÓŚŹŻ"
    return F.regexp_replace(F.regexp_replace(x, f"([0-9])([{letter}])", "$1 $2"), f"([{letter}])([0-9])", "$1 $2")


def clean_inline(x: Column) -> Column:
    return squeeze(split_letters_digits(squeeze(strip_zero_width(decode_entities(x)))))


def clean_line_indent(x: Column) -> Column:
    """Inline cleaning that keeps up to 8 leading spaces of list lines."""
    indent = F.left(F.regexp_extract(x, "^( *)", 1), F.lit(8))
    return F.when(F.regexp_like(x, F.lit(BULLET)), F.concat(indent, clean_inline(x))).otherwise(clean_inline(x))


def clean_multiline(x: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(x, "\r\n?", "\n"), "\n"), clean_inline)
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def strip_tags(html: Column) -> Column:
    for tag in ("script", "style", "noscript", "template"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(html, "(?s)<[^>]+>", " ")


def normalise_newlines(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), r"\x{00A0}", " "), CONTROLS, "")


def collapse_lines(x: Column) -> Column:
    """Spaces squeezed within each line; lines stay."""
    return F.array_join(F.transform(F.split(x, "\n"), lambda t: F.trim(F.regexp_replace(t, "[ \t]+", " "))), "\n")


def merge_hyphens(x: Column) -> Column:
    return F.regexp_replace(x, r"(\p{L})-\n+(\p{L})", "$1$2")


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, CONTROLS, "")


def fingerprint(x: Column) -> Column:
    """Letters and digits only, lower case: what makes two lines the same."""
    return F.trim(F.regexp_replace(F.lower(x), r"[\p{P}\p{S}\s\x{00A0}]+", " "))


def exact_key(x: Column) -> Column:
    return squeeze(F.lower(x))


def norm_key(x: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(x), "[\"'„”“’«»`]", ""))


def quote_norm(x: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "[ \t]+", " ")
    return F.lower(F.trim(F.regexp_replace(lines, " ?\n ?", "\n")))


def product_key(x: Column) -> Column:
    """What stays the same of a product line: no price, unit, date, stock or quotes."""
    x = F.lower(x)
    for pattern in (
        BULLET,
        r"(?:in stock|out of stock|dost[ęe]pn\S*|niedost[ęe]pn\S*).*$",
        r"\d+\s*(?:min|godz|dni|hours?|days?|minutes?)\.?\s*(?:temu|ago)",
        r"[0-9]{1,2}[-./][0-9]{1,2}(?:[-./][0-9]{2,4})?",
        r"\d[\d .,]*\s*(?:zł|zl|pln|eur|usd|€|\$|£)",
        r"[0-9]+(?:[,.][0-9]+)?\s*(?:ml|kg|g|l|cm|mm|szt)(?![\p{L}\p{N}])",
        "[\"'„”“’«»`]",
    ):
        x = F.regexp_replace(x, pattern, " ")
    return F.regexp_replace(squeeze(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), r"^(\S+) \1(?= |$)", "$1")


def para_tag(n: Column) -> Column:
    s = n.cast("string")
    return F.concat(F.lit("[P"), F.lpad(s, F.greatest(F.lit(3), F.length(s)), F.lit("0")), F.lit("]"))


def head_tail(x: Column, whole: int = 320, part: int = 180) -> Column:
    return F.when(F.length(x) <= whole, F.array(x)).otherwise(F.array(F.left(x, F.lit(part)), F.right(x, F.lit(part))))


def raw_concat(title: Column, description: Column, text: Column) -> Column:
    """Title, description and text, each once, with blank lines between."""
    t, d, b = blank_to_null(title), blank_to_null(description), blank_to_null(text)
    return F.concat_ws("\n\n", t, F.when(d.isNotNull() & ~d.eqNullSafe(t), d), F.when(b.isNotNull() & ~b.eqNullSafe(t) & ~b.eqNullSafe(d), b))


def soft_join(a: Column, b: Column) -> Column:
    return F.when(F.endswith(a, F.lit("-")), F.concat(F.left(a, F.length(a) - 1), b)).otherwise(F.concat(F.trim(a), F.lit(" "), F.trim(b)))


def should_join(prev: Column, cur: Column, wrap_at: int = 140) -> Column:
    """Whether a wrapped line goes on in the next one."""
    ends = F.regexp_like(prev, F.lit(r"[.!?][\"'”)\]]?\s*$"))
    soft = F.regexp_like(prev, F.lit(r"[,;:]\s*$"))
    return ~ends & (soft | (F.length(prev) >= max(40, int(0.6 * wrap_at)))) & (F.trim(cur) != "")


def pseudo_lines(x: Column) -> Column:
    """Lines; where there are two or fewer, parts between pipes or sentences."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s_: F.trim(s_)), lambda t: t != "")
    parts = F.filter(F.transform(F.split(x, r"(?<=[!.?])\s+|\s*[|]\s*"), lambda s_: F.trim(s_)), lambda t: t != "")
    return F.when(F.size(lines) > 2, lines).otherwise(parts)


def truncate_lines(lines: Column, most: int = 1_200) -> Column:
    return F.slice(lines, 1, most)


def first_words_template(x: Column) -> Column:
    """Paragraphs with key, title (4 words) and anchor (12 words) of each."""
    paras = F.filter(F.transform(F.split(x, r"\n\s*\n"), squeeze), lambda t: t != "")
    words = lambda t, n: F.array_join(F.slice(F.split(t, " "), 1, n), " ")
    return F.transform(paras, lambda t: F.struct(slug(words(t, 4)).alias("key"), words(t, 4).alias("title"), F.array(words(t, 12)).alias("anchor_candidates")))


# --- hashes and encodings


def sha1_or_null(x: Column) -> Column:
    return F.sha1(F.nullif(x, F.lit("")))


def prompt_hash(x: Column) -> Column:
    return F.sha1(blank_to_null(x))


def json_hash(x: Column) -> Column:
    return F.sha1(F.to_json(x))


def stable_json(m: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def djb_hash(x: Column) -> Column:
    """32-bit h * 31 + c over characters, as an unsigned number."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))


def base64_body(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(x), "(?i)^data:[^,]*,", ""), r"\s+", ""), F.lit(""))


def image_kind(x: Column) -> Column:
    return F.when(F.startswith(x, F.lit("iVBOR")), "png").when(F.startswith(x, F.lit("/9j/")), "jpg").otherwise("bin")


def render_marked(lines: Column, paras: Column) -> Column:
    """Lines with their paragraph's mark at the first line of each."""
    mark = lambda x, i: F.when((F.get(paras, i).isNotNull()) & (F.array_position(paras, F.get(paras, i)) == i + 1), F.concat(para_tag(F.get(paras, i)), F.lit(" "), x)).otherwise(x)
    return F.array_join(F.transform(lines, mark), "\n")


# --- semi-structured


def json_lenient(x: Column) -> Column:
    """Variant of JSON text: as it is, without code fences, or its outermost braces."""
    bare = F.regexp_replace(x, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))))


DECISION = "important boolean, category string, importance_reason string, evidence_used array<string>, short_title string, short_description string"


def parse_decision(x: Column) -> Column:
    """A judge's answer as a struct; what is missing or malformed is null."""
    return F.from_json(F.coalesce(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit("")), x), DECISION)
