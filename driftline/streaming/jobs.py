"""Structured Streaming jobs; each can run once over what there is and return its result.

Finite runs write to the shared checkpoint folder, so that their result is a
table like any other.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names; a temporary one where it names none and all runs in this process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and re.fullmatch(r"local(\[[^]]*\])?", sc.master) is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='driftline-stream-')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """events as a stream, with event time that watermarks accept."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_dir(spark, path) else spark.readStream.schema(schema).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_once(stream: DataFrame, write: Callable[[DataFrame, str], None], mode: str = "append") -> str:
    """Runs over all there is; ``write`` gets each micro-batch and the folder."""
    folder = scratch(stream.sparkSession)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, n: write(df, f"{folder}/out/{n}")).start()
    q.awaitTermination()
    return f"{folder}/out"


def _last_batch(spark: SparkSession, folder: str) -> DataFrame:
    """In complete mode each batch is the whole result; the latest counts."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [int(s.getPath().getName()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return spark.read.parquet(f"{folder}/{max(names)}")


def status_counts(spark: SparkSession, path: str) -> DataFrame:
    s = source(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return _last_batch(spark, run_once(s, lambda df, to: df.write.mode("overwrite").parquet(to), "complete"))


def windowed_counts(spark: SparkSession, path: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    s = source(spark, path).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    s = s.select("event_type", F.unix_seconds("window.start").alias("day"), "n")
    return _last_batch(spark, run_once(s, lambda df, to: df.write.mode("overwrite").parquet(to), "complete"))


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows whose type differs from the one before them; the last type is the state."""
    last = state.get[0] if state.exists else None
    pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    before = pdf["event_type"].shift(1)
    before.iloc[0] = last
    state.update((pdf["event_type"].iloc[-1],))
    yield pdf.loc[pdf["event_type"] != before, ["user_id", "event_id", "event_type"]]


def changed_only(spark: SparkSession, path: str) -> DataFrame:
    """Consecutive repeats dropped per key: one state value a key, keys in parallel, each serial."""
    s = source(spark, path).select("user_id", "event_id", "ts", "event_type").groupBy("user_id")
    s = s.applyInPandasWithState(_changes, "user_id bigint, event_id bigint, event_type string", "last string", "append", GroupStateTimeout.NoTimeout)
    return spark.read.parquet(f"{run_once(s, lambda df, to: df.write.mode('overwrite').parquet(to))}/*")


def upsert_snapshots(batch: DataFrame, target: DataFrame | None, keys: list[str], sha: str, ts: str) -> DataFrame:
    """The table after a micro-batch: the newest row of a key replaces it unless its hash is the same."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(sha))
    new = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    if target is None:
        return new
    same = target.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(sha).alias("__sha"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    changed = new.join(same, match & F.col(sha).eqNullSafe(F.col("__sha")), "left_anti")
    marks = changed.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return target.join(marks, match, "left_anti").unionByName(changed)


def notify(batch: DataFrame, send: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Sends an outbox micro-batch; rows that ``send`` doesn't return stay pending (at least once)."""
    return batch.where("status = 'pending'").mapInPandas(send, schema)
