"""Vector bin packing of training examples.

An example has three sizes: tokens, segments and loss-bearing tokens; a packed
sequence has a limit on each.  Examples are spread over shards by hash of their
id (as many shards as their number asks for) and each shard is packed by the
dot-product heuristic: of the examples that still fit the open sequence, place
the one whose sizes, relative to the limits, have the greatest dot product with
what is left of them; open the next sequence when none fits.

Defined results:

* an example over a limit is split: its tokens are cut into pieces that fit.
* examples without tokens (null, empty texts) take no place and have no row.
* rows that agree in id are one example in conversations (their turns are put
  in order of turn, role, text); as documents, each is an example of its own.
* a null id is packed like any other; ties are broken by id, then by position.
* very long texts are counted whole; other columns are never read; an empty
  table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import BPE_RANKS, bpe_lengths, cut, read

ROWS = "shard bigint, bin int, slot int, doc_id bigint, start bigint, tokens bigint, segments bigint, loss_tokens bigint"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 32
    loss_tokens: int = 3072


def dot_product_bins(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bin of each item; ``sizes`` is items x dimensions, each item within the limits.

    Items come in order of preference among equals.
    """
    rel = sizes / limits
    n = len(rel)
    bins = np.full(n, -1, np.int64)
    order = np.lexsort((np.arange(n), -rel.sum(axis=1)))
    rel, left_sizes = rel[order], sizes[order]
    alive = np.arange(n)  # items not placed yet, largest first
    current = -1
    while len(alive):
        current += 1
        left = limits.astype(np.int64).copy()
        fits = np.arange(len(alive))
        taken = np.zeros(len(alive), bool)
        while len(fits):
            pick = fits[int(np.argmax(rel[alive[fits]] @ (left / limits)))]
            taken[pick] = True
            bins[order[alive[pick]]] = current
            left -= left_sizes[alive[pick]]
            ok = (left_sizes[alive[fits]] <= left).all(axis=1) & ~taken[fits]
            fits = fits[ok]
        alive = alive[~taken]
    return bins


def split_example(spans: list[tuple[int, bool]], limits: Limits) -> list[tuple[int, int, int]]:
    """(start, tokens, loss tokens) of the pieces of an example.

    ``spans`` are its stretches in order: (tokens, loss-bearing).
    """
    pieces, start, tokens, loss = [], 0, 0, 0
    for n, bears in spans:
        while n > 0:
            room = min(limits.tokens - tokens, limits.loss_tokens - loss if bears else n)
            take = min(n, room)
            tokens, loss, n = tokens + take, loss + take * bears, n - take
            if n > 0:
                pieces.append((start, tokens, loss))
                start, tokens, loss = start + tokens, 0, 0
    if tokens:
        pieces.append((start, tokens, loss))
    return pieces


def pack(pieces: DataFrame, limits: Limits = Limits(), shard_size: int = 4096) -> DataFrame:
    """Rows of ``ROWS``: where every piece goes.

    ``pieces``: doc_id, start, tokens, segments, loss_tokens, each within the
    limits.  They are written first, since they are both counted and packed.
    """
    pieces = cut(pieces)
    shards = max(1, -(-pieces.count() // shard_size))
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("segments", "ascending"), ("loss_tokens", "ascending")])
        sizes = np.stack([table.column(c).to_numpy() for c in ("tokens", "segments", "loss_tokens")], axis=1)
        bins = dot_product_bins(sizes, cap)
        order = np.lexsort((np.arange(len(bins)), bins))
        bins = bins[order]
        slot = np.arange(len(bins)) - np.searchsorted(bins, bins)
        table = table.take(pa.array(order))
        return pa.table([table.column("shard"), pa.array(bins, pa.int32()), pa.array(slot, pa.int32()), *(table.column(c) for c in ("doc_id", "start", "tokens", "segments", "loss_tokens"))], names=["shard", "bin", "slot", "doc_id", "start", "tokens", "segments", "loss_tokens"])

    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("bigint"))
    tasks = min(shards, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(tasks, "shard").groupBy("shard").applyInArrow(run, ROWS)  # a shard is much work and few bytes: not to be merged into few tasks


def document_pieces(docs: DataFrame, limits: Limits, tokenizer: str = BPE_RANKS) -> DataFrame:
    """Every document one example of one segment, all tokens loss-bearing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, n in zip(b.column("doc_id").to_pylist(), bpe_lengths(b.column("text").to_pylist(), tokenizer)):
                out += [(doc, s, t, 1, loss) for s, t, loss in split_example([(n, True)], limits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["doc_id", "start", "tokens", "segments", "loss_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, start bigint, tokens bigint, segments bigint, loss_tokens bigint")


def conversation_pieces(turns: DataFrame, limits: Limits, tokenizer: str = BPE_RANKS, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Every conversation one example of one segment; turns of ``loss_roles`` bear loss.

    Texts are counted before the conversations are put together, so that only
    numbers move.
    """

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(bpe_lengths(texts.to_pylist(), tokenizer), pa.int64())

    tokens = F.arrow_udf(count, "bigint")
    t = turns.select(F.col("conv_id").cast("bigint").alias("doc_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("bears"), F.xxhash64("role", "text").alias("tie"), tokens(F.col("text")).alias("n"))
    g = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("turn", "bears", "tie", "n"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist()):
                out += [(doc, s, t, 1, loss) for s, t, loss in split_example([(x["n"], x["bears"]) for x in spans], limits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["doc_id", "start", "tokens", "segments", "loss_tokens"])

    return g.mapInArrow(run, "doc_id bigint, start bigint, tokens bigint, segments bigint, loss_tokens bigint")


def query(spark, sf_dir: str) -> DataFrame:
    """conversations is the table of instruction data; doc_id is its conv_id."""
    limits = Limits()
    return pack(conversation_pieces(read(spark, sf_dir, "conversations"), limits), limits)
