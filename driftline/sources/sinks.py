"""Where results go: partitioned tables, upserts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Append to a Parquet table partitioned by a hash bucket of the key."""
    b = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", b).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Overwrite, with nothing too (which clears the table)."""
    df.write.mode("overwrite").parquet(path)


def idempotent(df: DataFrame, batch_id: int, path: str) -> None:
    """A micro-batch as a partition of its own: written again, it replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def last_n(df: DataFrame, n: int, created: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(created).desc(), F.col(tie).desc()).limit(n)


def binary(b64: Column) -> Column:
    """Decoded image of base64 text, with or without its data prefix; null if it isn't base64."""
    from driftline.functions.text import base64_body

    return F.try_to_binary(base64_body(b64), F.lit("base64"))
