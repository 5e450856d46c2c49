"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.sources.tables import BATCH_BYTES, BATCH_ROWS, bounded_batches, table  # noqa: F401

TOKENIZER_DIR = "/opt/tokenizers"
BPE_RANKS = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
PIECE_MODEL = f"{TOKENIZER_DIR}/piece_bpe_32k.model"

#: Split pattern that belongs to the byte-level BPE vocabulary.
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    The folder named in ``spark.checkpoint.dir`` is used as it is; where the
    session names none, one of our own is set if all runs in this process, and
    on a cluster it is an error: its machines share no temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[[^]]*\])?", sc.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftline-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy.

    The copy outlives any executor, so a lost one costs no recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def runs_within(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive [start, stop) runs whose sizes sum to ``most`` at most.

    A single larger item is a run of its own.
    """
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BPE: dict[str, object] = {}


def bpe(path: str = BPE_RANKS):
    """The byte-level BPE encoder of ``path``, loaded once in each process."""
    if path not in _BPE:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _BPE[path] = tiktoken.Encoding(os.path.basename(path), pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _BPE[path]


def bpe_lengths(texts: list[str | None], path: str = BPE_RANKS) -> list[int]:
    """Encoded length of each text; a null has length 0."""
    encode = bpe(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]
