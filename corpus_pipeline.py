"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.

Defined results:

* quality rules: a document of a language without reference, or too short to
  judge (null and empty texts too), stays.
* line dedup: the first document in order of doc_id keeps a line; a document
  that loses all its lines goes, one that had none (null, empty text) stays.
* near duplicates: the least doc_id of each group stays; documents without
  words, and rows without a doc_id, stay; repeated rows stay or go together.
* personal data: null and empty texts stay as they are, nothing goes.
* packing: documents without tokens have no row; equal sizes are placed in order
  of doc_id, then of position.
* very long texts are read whole in every stage.  All but the last return the
  columns of ``docs``, whatever else and under whatever names there is.  An
  empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import common, crf, line_dedup, near_dups, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms lie near their language's."""
    common.bounded_batches(spark)
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dups.one_of_each_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return crf.mask_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: shard, bin and slot."""
    limits = packing.Limits(tokens=4096, segments=32, loss_tokens=4096)
    return packing.pack(packing.document_pieces(docs, limits), limits)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("near duplicates", near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Trained decoding, approximate search and encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread.

    What the stage before wrote is deleted when the next one's is complete; the
    last one's input stays for as long as the result is read.
    """
    common.shared_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            common.delete(spark, f"{base}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
