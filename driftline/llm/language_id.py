"""Language identification with bit-sliced Bloom filters over n-grams.

One table serves all languages: row ``i`` is a bit mask with a bit for every
language whose filter has bit ``i`` set.  The AND of the rows an n-gram hashes
to is the set of languages that contain it.  Per-language popcounts over a
document, corrected for each filter's false-positive rate, decide.

The filters are trained on labelled documents, at most ``train_docs`` of each
language, chosen by hash of doc_id; everything else is done for every document.

Defined results:

* null, empty or very short text: no n-grams or too few, language ``und``.
* no language above ``min_share``: ``und``.  Of equal shares the language that
  is first in the alphabet wins.
* documents without a label don't train; a table without labels gives ``und``.
* very long texts are read whole; repeated rows are decided alike; other columns
  are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import mix64, read, runs_within, text_buffer

GRAM = 5  # bytes
PIECE = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 13]] = 32


@dataclass(frozen=True)
class Settings:
    train_docs: int = 400  # bound of the labelled sample, by language
    min_count: int = 2  # in the sample, for an n-gram to enter a filter
    rows: int = 1 << 21  # rows of the table, a power of two
    min_grams: int = 8
    min_share: float = 0.2


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (rows, planes) of uint8: bit l % 8 of plane l // 8
    false_positive: np.ndarray  # by language
    settings: Settings


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram within a document, and the document's index."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _LOWER[data].astype(np.uint64)
    x = low[:n].copy()
    for i in range(1, GRAM):
        x |= low[i : n + i] << np.uint64(8 * i)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    whole = np.zeros(n, bool)
    whole[:] = doc[:n] == doc[GRAM - 1 :]
    return mix64(x[whole]), doc[:n][whole]


def _rows_of(h: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    bits = np.uint64(rows.bit_length() - 1)
    for k in range(3):
        yield ((h >> (bits * np.uint64(k))) & np.uint64(rows - 1)).astype(np.int64)


def build(by_language: dict[str, np.ndarray], settings: Settings) -> Model:
    languages = tuple(sorted(by_language))
    table = np.zeros((settings.rows, max(1, -(-len(languages) // 8))), np.uint8)
    for i, lang in enumerate(languages):
        for rows in _rows_of(by_language[lang], settings.rows):
            table[rows, i // 8] |= np.uint8(1 << (i % 8))
    fill = np.array([np.count_nonzero(table[:, i // 8] & (1 << (i % 8))) / settings.rows for i in range(len(languages))])
    return Model(languages, table, fill**3, settings)


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Filters from at most ``train_docs`` labelled documents of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("lang", "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= settings.train_docs).select("doc_id").distinct()
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # train_docs rows a language

    def collect(table: pa.Table) -> pa.Table:
        data, off = text_buffer(table.column("text"))
        h, _ = grams(data[off[0] : off[-1]], off - off[0])
        seen, count = np.unique(h, return_counts=True)
        kept = seen[count >= settings.min_count].view(np.int64)
        return pa.table({"lang": table.column("lang").slice(0, 1), "grams": pa.array([kept], pa.list_(pa.int64()))})

    rows = sample.select("lang", "text").groupBy("lang").applyInArrow(collect, "lang string, grams array<bigint>").collect()  # bounded by the sample
    return build({r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in rows}, settings)


def decide(model: Model, hits: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and its corrected share, for popcounts (documents x languages)."""
    if not model.languages:
        return ["und"] * len(n), np.zeros(len(n))
    share = (hits / np.maximum(n, 1)[:, None] - model.false_positive) / (1 - model.false_positive)
    best = share.argmax(axis=1)
    top = share[np.arange(len(n)), best]
    sure = (n >= model.settings.min_grams) & (top >= model.settings.min_share)
    return [model.languages[b] if s else "und" for b, s in zip(best.tolist(), sure.tolist())], np.where(n > 0, np.maximum(top, 0.0), 0.0)


def popcounts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents x languages: n-grams that each filter claims; and all n-grams."""
    n_docs = len(offsets) - 1
    hits, total = np.zeros((n_docs, len(model.languages)), np.int64), np.zeros(n_docs, np.int64)
    for a, b in runs_within(np.diff(offsets), PIECE):
        h, doc = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        total[a:b] += np.bincount(doc, minlength=b - a)
        if not len(model.languages) or not len(h):
            continue
        masks = None
        for rows in _rows_of(h, model.settings.rows):
            masks = model.table[rows] if masks is None else masks & model.table[rows]
        for plane in range(masks.shape[1]):
            by_mask = np.bincount(doc * 256 + masks[:, plane], minlength=(b - a) * 256).reshape(b - a, 256)
            for i in range(plane * 8, min(plane * 8 + 8, len(model.languages))):
                hits[a:b, i] += by_mask[:, (np.arange(256) >> (i % 8)) & 1 == 1].sum(axis=1)
    return hits, total


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, language, share, n_grams, hits (by language in model order)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # rows x planes bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = text_buffer(b.column("text"))
            hits, n = popcounts(m, data, off)
            lang, share = decide(m, hits, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(m.languages), pa.int32()), pa.array(hits.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.round(share, 6)), pa.array(n), lists], ["doc_id", "language", "share", "n_grams", "hits"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, language string, share double, n_grams bigint, hits array<bigint>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
