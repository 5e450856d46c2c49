"""Line dedup over the whole corpus, returned as keep bitmaps.

Lines are hashed to 128 bits; the hashes are range-partitioned and sorted by
(hash, document, position), and a streaming pass over each partition keeps the
first occurrence of every hash.  What moves is hashes and positions, never text.
A line that is in very many documents doesn't make a hot partition: each map
task drops repeats among so many rows at a time before the exchange.

A bitmap is run-length encoded: alternating run lengths, kept lines first, as in
``"3,1,2"`` for 3 kept, 1 dropped, 2 kept.

Defined results:

* lines end at ``\\n``.  Blank lines and lines shorter than ``min_chars`` are
  always kept and count as no occurrence.
* documents come in order of doc_id, a null first, then of their text's hash;
  rows that agree in doc_id and text are one document with one bitmap.
* a null text has 0 lines and an empty bitmap; an empty text is one blank line.
* very long texts and lines are treated whole; other columns don't matter.
* an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import read

MIN_CHARS = 16
#: Rows among which a map task drops repeats.
COMBINED = 1 << 16
_KEY = "doc_id bigint, t1 bigint, t2 bigint"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line that takes part, and one per document (pos -1)."""
    text = F.col("text")
    d = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit("text"), text).alias("t2"),
        F.when(text.isNotNull(), F.split(text, "\n", -1)).alias("lines"),
    )
    d = d.select("doc_id", "t1", "t2", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.concat(F.array(F.lit(None).cast("string")), F.coalesce("lines", F.array().cast("array<string>"))).alias("lines"))
    d = d.select("doc_id", "t1", "t2", "n_lines", F.posexplode("lines").alias("pos", "line"))
    d = d.where(F.col("line").isNull() | ((F.length("line") >= min_chars) & (F.trim("line") != "")))
    unique = F.struct("doc_id", "t1", "t2")
    return d.select(
        F.when(F.col("line").isNull(), F.xxhash64(unique)).otherwise(F.xxhash64("line")).alias("h1"),
        F.when(F.col("line").isNull(), F.xxhash64(F.lit("document"), unique)).otherwise(F.xxhash64(F.lit("line"), "line")).alias("h2"),
        "doc_id",
        "t1",
        "t2",
        (F.col("pos") - 1).alias("pos"),
        F.when(F.col("line").isNull(), F.col("n_lines")).alias("n_lines"),
    )


_LINE = f"h1 bigint, h2 bigint, {_KEY}, pos int, n_lines int"


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal hashes among some rows together, the first by document and position."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= COMBINED:
            yield from _combined(held)
            held = []
    yield from _combined(held)


def _combined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not any(b.num_rows for b in held):
        return
    b = pa.Table.from_batches(held).combine_chunks()
    h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
    doc = b.column("doc_id")
    known = doc.is_valid().to_numpy()
    order = np.lexsort((b.column("pos").to_numpy(), b.column("t2").to_numpy(), b.column("t1").to_numpy(), doc.fill_null(0).to_numpy(), known, h2, h1))
    s1, s2 = h1[order], h2[order]
    first = np.ones(len(order), bool)
    first[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    yield from b.take(pa.array(np.sort(order[first]))).to_batches()


def _first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those whose hash differs from the row before."""
    last: tuple[int, int] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
        first = np.ones(len(h1), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first[0] = last != (h1[0], h2[0])
        last = (h1[-1], h2[-1])
        yield b.filter(pa.array(first)).drop_columns(["h1", "h2"])


def first_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t1, t2, pos, n_lines of every line kept, and of each document (pos -1)."""
    lines = _lines(docs, min_chars).mapInArrow(_first_of_batch, _LINE)
    ranged = lines.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_first(), "t1", "t2", "pos")
    return ranged.mapInArrow(_first_of_run, f"{_KEY}, pos int, n_lines int")


def run_lengths(kept: np.ndarray) -> str:
    """``kept`` (booleans) as alternating run lengths, kept first."""
    if not len(kept):
        return ""
    edges = np.flatnonzero(kept[1:] != kept[:-1]) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(kept)]]))
    return ",".join(map(str, runs.tolist() if kept[0] else [0, *runs.tolist()]))


def kept_flags(bitmap: str) -> np.ndarray:
    runs = [int(x) for x in bitmap.split(",")] if bitmap else []
    return np.repeat(np.arange(len(runs)) % 2 == 0, runs)


def _bitmaps(n_lines: pa.Array, kept: pa.Array, in_play: pa.Array) -> pa.Array:
    out = []
    for n, k, p in zip(n_lines.to_pylist(), kept.to_pylist(), in_play.to_pylist()):
        flags = np.ones(n, bool)
        flags[p] = False
        flags[k] = True
        out.append(run_lengths(flags))
    return pa.array(out, pa.string())


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n_lines, n_kept, keep_bitmap.

    A line that isn't in play (blank or short) has to be told from a dropped
    one; so documents also send which of their positions are in play, as one
    row, to the bitmap's task.
    """
    text = F.col("text")
    lines = F.split(text, "\n", -1)
    in_play = F.filter(
        F.transform(lines, lambda x, i: F.when((F.length(x) >= min_chars) & (F.trim(x) != ""), i)),
        lambda i: i.isNotNull(),
    )
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("n_lines"), F.coalesce(in_play, F.array().cast("array<int>")).alias("in_play"))
    firsts = first_occurrences(docs, min_chars).withColumn("in_play", F.lit(None).cast("array<int>"))
    g = firsts.unionByName(own).groupBy("doc_id", "t1", "t2").agg(
        F.max("n_lines").alias("n_lines"),
        F.collect_set(F.when(F.col("pos") >= 0, F.col("pos"))).alias("kept"),
        F.first("in_play", ignorenulls=True).alias("in_play"),
    )
    bitmap = F.arrow_udf(_bitmaps, "string")
    return g.select(
        "doc_id",
        "t1",
        "t2",
        "n_lines",
        (F.col("n_lines") - F.size("in_play") + F.size("kept")).alias("n_kept"),
        bitmap("n_lines", "kept", "in_play").alias("keep_bitmap"),
    )


def _apply(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    out = []
    for t, b in zip(text.to_pylist(), bitmap.to_pylist()):
        if t is not None and b is not None and "," in b:
            t = "\n".join(x for x, k in zip(t.split("\n"), kept_flags(b).tolist()) if k)
        out.append(t)
    return pa.array(out, pa.string())


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without repeated lines; a document left without any goes.

    The other columns stay as they are, but n_chars, where there is one, is
    counted again (a null text keeps its own).  Documents that had no text to begin with stay.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    text = F.col("text")
    left = docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("k0"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2"))
    b = keep_bitmaps(docs, min_chars).where(F.col("n_kept") < F.col("n_lines"))  # the others lose nothing
    right = b.select(F.col("doc_id").alias("b0"), F.col("t1").alias("b1"), F.col("t2").alias("b2"), "n_kept", "keep_bitmap").hint("shuffle_hash")
    j = left.join(right, F.col("k0").eqNullSafe(F.col("b0")) & (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")), "left")
    j = j.where(F.coalesce(F.col("n_kept"), F.lit(1)) > 0)
    apply = F.arrow_udf(_apply, "string")
    j = j.select("row", F.when(F.col("keep_bitmap").isNull(), F.col("row.text")).otherwise(apply("row.text", "keep_bitmap")).alias("new"))
    j = j.where((F.col("row.text").isNull()) | (F.col("row.text") == "") | (F.trim("new") != ""))
    cols = [F.col("new").alias(c) if c == "text" else F.coalesce(F.length("new").cast("bigint"), F.col(f"row.`{c}`").cast("bigint")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names]
    return j.select(*cols)


def query(spark, sf_dir: str) -> DataFrame:
    return keep_bitmaps(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "keep_bitmap")


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs
), flagged AS (
  SELECT doc_id, pos,
    CASE WHEN length(line) < {MIN_CHARS} OR trim(line, ' ') = '' THEN TRUE
         ELSE row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 END AS keep
  FROM lines
), edges AS (
  SELECT doc_id, pos, keep,
    CASE WHEN keep IS DISTINCT FROM lag(keep) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS edge
  FROM flagged
), runs AS (
  SELECT doc_id, run, min(pos) AS p0, count(*) AS n, bool_and(keep) AS keep FROM (
    SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edges) GROUP BY doc_id, run
)
SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines, CAST(coalesce(sum(n) FILTER (keep), 0) AS INTEGER) AS n_kept,
  CASE WHEN arg_min(keep, p0) THEN '' ELSE '0,' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY p0) AS keep_bitmap
FROM runs GROUP BY doc_id
"""
