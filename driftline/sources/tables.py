"""Tables as the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables with much work in each row, and the column by which their rows are spread.
SPREAD_BY = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


#: Arrow batches of texts: so many rows and bytes at most (a longer text alone).
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a task's texts never pile up in memory.

    Sets the session's limits, which hold for the plans it makes from now on;
    a lower limit that someone has set stays.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        now = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, a scan, over all cores where its files give fewer splits than there are.

    One row group is one task, however many cores wait.  A table of many files
    is left as it is, so nothing moves at size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, SPREAD_BY[name]) if name in SPREAD_BY else df


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as monitors: one a customer, owned by its nation."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com/"), F.col("c_custkey")).alias("url"),
        ((F.col("c_custkey") % 30 + 1) * 86400).cast("int").alias("interval_sec"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.lit("1996-01-01").cast("timestamp_ntz").alias("created_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as scan tasks: late open ones pending, late partial ones running, the others done."""
    o = table(spark, sf_dir, "orders")
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    status = F.when(late & (F.col("o_orderstatus") == "O"), "pending").when(late & (F.col("o_orderstatus") == "P"), "running").otherwise("ok")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("monitor_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("planned_at"),
        F.col("o_orderdate").alias("started_at"),
        F.when(status == "ok", F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 1000).cast("decimal(18,6)") / 4)).alias("finished_at"),
        "o_totalprice",
    )


MONITORS = """(SELECT c_custkey AS id, c_nationkey AS user_id, c_name AS name,
 'https://' || lower(c_mktsegment) || '.example.com/' || c_custkey AS url,
 CAST((c_custkey % 30 + 1) * 86400 AS INTEGER) AS interval_sec, c_acctbal > 0 AS active, TIMESTAMP '1996-01-01' AS created_at FROM customer)"""
TASKS = """(SELECT o_orderkey AS id, o_custkey AS monitor_id,
 CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'O' THEN 'pending' WHEN o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'P' THEN 'running' ELSE 'ok' END AS status,
 o_orderdate AS planned_at, o_orderdate AS started_at,
 CASE WHEN NOT (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus IN ('O', 'P')) THEN o_orderdate + to_microseconds(CAST((o_orderkey % 1000) * 250000 AS BIGINT)) END AS finished_at, o_totalprice FROM orders)"""
