"""Token counts as an exact length histogram.

Each document is encoded once; from then on only (encoded length, documents)
counts exist.  Suffix sums over the histogram answer document and token totals,
quantiles and truncated totals for every context limit, exactly.

Defined results:

* null and empty texts are documents of length 0.
* very long texts are encoded whole.
* repeated rows each count; other columns are never read.
* an empty table gives an empty histogram, and queries on it give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import BPE_RANKS, bpe_lengths, cut, read

#: Lengths are summed in blocks of so many, then across blocks, so that no
#: single task sorts the whole histogram.
BLOCK = 1024


def histogram(docs: DataFrame, tokenizer: str = BPE_RANKS, text_col: str = "text") -> DataFrame:
    """n_tokens, docs: how many documents encode to each length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in batches:
            seen.update(bpe_lengths(b.column(0).to_pylist(), tokenizer))
        lengths = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array([seen[n] for n in lengths], pa.int64())], ["n_tokens", "docs"])

    part = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "n_tokens bigint, docs bigint")
    return part.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds, for every length L that occurs, taken as a context limit:

    docs_at_least, tokens_at_least (documents of length L or more),
    docs_below, tokens_below, and truncated_total, the tokens left of all
    documents when each is cut to L.
    """
    h = hist.select(F.floor(F.col("n_tokens") / BLOCK).alias("block"), "n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per block: the longest text over BLOCK
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(Window.partitionBy(F.lit(0))).alias("all_docs"),
        F.sum("t").over(Window.partitionBy(F.lit(0))).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.join(blocks, "block").select(
        "n_tokens",
        "docs",
        "tokens",
        (F.col("docs_after") + F.sum("docs").over(within)).alias("docs_at_least"),
        (F.col("tokens_after") + F.sum("tokens").over(within)).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    below = F.col("all_tokens") - F.col("tokens_at_least")
    return h.select(
        "n_tokens",
        "docs",
        "tokens",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
        below.alias("tokens_below"),
        (below + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_cut, kept_tokens for each context limit, occurring or not."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit bigint")
    longer = F.col("n_tokens") > F.col("limit")
    agg = sums.crossJoin(F.broadcast(wanted)).groupBy("limit").agg(
        F.coalesce(F.sum(F.when(longer, F.col("docs"))), F.lit(0)).alias("docs_cut"),
        F.sum(F.least("n_tokens", "limit") * F.col("docs")).alias("kept_tokens"),
    )
    return agg


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that so many of all documents don't exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    total = F.col("docs_below") + F.col("docs_at_least")
    reached = (F.col("docs_below") + F.col("docs")) >= F.col("share") * total
    return sums.crossJoin(F.broadcast(wanted)).where(reached).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    return with_suffix_sums(cut(histogram(read(spark, sf_dir, "documents"))))
