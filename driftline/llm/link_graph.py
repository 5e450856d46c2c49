"""URL filtering by propagation over the host graph.

Hosts link to hosts: hyperlinks of pages, and a host and the domain it is part
of.  Trust is personalised PageRank from trusted seed hosts along the links;
distrust is personalised PageRank from blocked seed hosts against them.  A host
whose distrust outweighs its trust by the threshold is dropped with its pages.

Defined results:

* a page whose url is null or has no http(s) host gets a null host and is kept.
* null or empty html has no links; very long html is searched whole.
* links without a host are the page's own host's and are no edge.
* without seeds on one side, that side's rank is 0 for every host; if seeds are
  named but none is among the hosts, a warning says so.
* repeated pages count their links again; hosts of equal rank are equal, so
  ties need no order; other columns are never read; an empty table gives an
  empty result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import cut, read

HOST = r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//(?:[^/?#@\"'>\s]*@)?([^/?#:@\"'>\s]+)"


@dataclass(frozen=True)
class Settings:
    trusted: tuple[str, ...] = ("example.org",)  # these hosts and all below them
    blocked: tuple[str, ...] = ("example.net",)
    damping: float = 0.85
    tolerance: float = 0.01  # share of the mass that may be left unspread
    threshold: float = 0.0  # of distrust over trust
    checkpoint_every: int = 4

    def rounds(self) -> int:
        """After k rounds damping^(k + 1) of the mass is unspread at most, whatever the graph."""
        return max(0, math.ceil(math.log(self.tolerance) / math.log(self.damping)) - 1)


def _of(host: Column, suffixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | (host == s) | host.endswith(f".{s}")
    return found


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, host, links (hosts): all that is needed of pages, found in one pass."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    links = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), F.lower)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.when(host != "", host).alias("host"), links.alias("links"))


def host_edges(linked: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts."""
    p = linked.where("host is not null")
    links = p.select(F.col("host").alias("src"), F.explode("links").alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = p.select("host").distinct()
    part = hosts.where(F.size(F.split("host", r"\.")) > 2).select("host", F.regexp_replace("host", r"^[^.]*\.", "").alias("domain"))
    ends = F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("domain").alias("dst")), F.struct(F.col("domain").alias("src"), F.col("host").alias("dst"))))
    both = part.select(ends.alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("weight"))
    return links.unionByName(both).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Plans made and run in here are not planned again after each of their stages.

    In a loop of many small stages that would fill the driver's memory with
    plans, and nothing is won where the partitions are in place already.
    """
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def personalised_ranks(hosts: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """side, host, rank: the personalised ranks of all sides in one loop.

    ``hosts``: side, host, seed (its share of the restart mass); ``edges``:
    side, src, dst, share (of the source's mass).  Each round passes on the mass
    that came in the round before and adds it up; what hosts without edges would
    give back to the seeds is the same for all hosts as scaling the sums to 1.
    The edges are put in place once; a round shuffles sums by host only and
    broadcasts nothing.
    """
    spark = hosts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = hosts.select("side", F.col("host").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("share"))  # keeps a host's sum
    placed = edges.unionByName(own).repartition(n, "side", "src")
    start = F.lit(1 - s.damping) * F.col("seed")
    state = hosts.select("side", "host", start.alias("came"), start.alias("total"))
    with planned_once(spark):  # so that the partitions of what is cut are known
        placed = cut(placed).persist(StorageLevel.MEMORY_AND_DISK)  # cut: else all rounds' plans hold its own
        for i in range(s.rounds()):
            at = state.withColumnsRenamed({"side": "__side", "host": "__host"})
            met = placed.join(at.hint("shuffle_hash"), (F.col("side") == F.col("__side")) & (F.col("src") == F.col("__host")))
            passed = F.lit(s.damping) * F.col("came") * F.col("share")
            met = met.select("side", F.coalesce("dst", "src").alias("host"), passed.alias("came"), F.when(F.col("dst").isNull(), F.col("total")).otherwise(passed).alias("total"))
            state = met.groupBy("side", "host").agg(F.sum("came").alias("came"), F.sum("total").alias("total"))
            if (i + 1) % s.checkpoint_every == 0:
                state = cut(state)
        state = cut(state)
    placed.unpersist()
    whole = state.groupBy("side").agg(F.sum("total").alias("whole"))  # a row a side
    return state.join(F.broadcast(whole), "side").select("side", "host", F.coalesce(F.try_divide("total", "whole"), F.lit(0.0)).alias("rank"))


def host_decisions(linked: DataFrame, s: Settings = Settings()) -> DataFrame:
    """host, trust, distrust, keep; ``linked`` as of ``page_links``."""
    edges = cut(host_edges(linked))
    named = linked.where("host is not null").select("host")
    hosts = cut(named.unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct())
    seeded, shares = [], []
    for side, suffixes, (src, dst) in (("trust", s.trusted, ("src", "dst")), ("distrust", s.blocked, ("dst", "src"))):
        seeds = hosts.select(F.lit(side).alias("side"), "host", _of(F.col("host"), suffixes).cast("double").alias("s"))
        total = seeds.agg(F.sum("s")).first()[0]
        if suffixes and total == 0:
            warnings.warn(f"op6_url_link_graph: no host matches the seeds of {side} {suffixes}, so it is 0 for all hosts", stacklevel=2)
        seeded.append(seeds.select("side", "host", (F.col("s") / (total or 1.0)).alias("seed")))
        e = edges.select(F.lit(side).alias("side"), F.col(src).alias("src"), F.col(dst).alias("dst"), "weight")
        out = e.groupBy("src").agg(F.sum("weight").alias("out"))
        shares.append(e.join(out, "src").select("side", "src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    ranks = personalised_ranks(seeded[0].unionByName(seeded[1]), shares[0].unionByName(shares[1]), s)
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("rank"))).alias(side)
    return ranks.groupBy("host").agg(of("trust"), of("distrust")).withColumn("keep", F.col("distrust") - F.col("trust") <= s.threshold)


def filter_pages(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """page_id, host, trust, distrust, keep of every page."""
    linked = cut(page_links(pages))
    p = linked.select("page_id", "host")
    return p.join(host_decisions(linked, s), "host", "left").select("page_id", "host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), F.coalesce("keep", F.lit(True)).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    return filter_pages(read(spark, sf_dir, "pages"))


def _oracle(s: Settings = Settings()) -> str:
    def of(suffixes: tuple[str, ...]) -> str:
        return " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in suffixes) or "FALSE"

    link = LINK.replace("'", "''")
    sql = f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, html FROM pages
), links AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (
    SELECT host AS src, lower(unnest(regexp_extract_all(html, '{link}', 1))) AS dst FROM p WHERE host IS NOT NULL) GROUP BY src, dst
), part AS (
  SELECT DISTINCT host, regexp_replace(host, '^[^.]*\\.', '') AS domain FROM p WHERE len(string_split(host, '.')) > 2
), edges AS MATERIALIZED (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT * FROM links UNION ALL SELECT host, domain, 1.0 FROM part UNION ALL SELECT domain, host, 1.0 FROM part)
  WHERE src <> dst GROUP BY src, dst
), hosts AS MATERIALIZED (
  SELECT host FROM p WHERE host IS NOT NULL UNION SELECT src FROM edges UNION SELECT dst FROM edges
)"""
    for name, suffixes, src, dst in (("trust", s.trusted, "src", "dst"), ("distrust", s.blocked, "dst", "src")):
        sql += f""", {name}_edges AS MATERIALIZED (
  SELECT {src} AS src, {dst} AS dst, weight / sum(weight) OVER (PARTITION BY {src}) AS share FROM edges
), {name}_seeds AS MATERIALIZED (
  SELECT host, {1 - s.damping}::DOUBLE / count(*) OVER () AS mass FROM hosts WHERE {of(suffixes)}
), {name}_round AS (
  SELECT 0 AS i, host, mass FROM {name}_seeds
  UNION ALL
  SELECT i + 1, dst, sum({s.damping}::DOUBLE * mass * share) FROM {name}_round r JOIN {name}_edges e ON e.src = r.host WHERE i < {s.rounds()} GROUP BY i + 1, dst
), {name}_rank AS (
  SELECT host, coalesce(total / sum(total) OVER (), 0) AS rank FROM (SELECT h.host, coalesce(sum(mass), 0) AS total FROM hosts h LEFT JOIN {name}_round r ON r.host = h.host GROUP BY h.host)
)"""
    return sql + f"""
SELECT p.page_id, p.host, round(t.rank, 9) AS trust, round(d.rank, 9) AS distrust, coalesce(d.rank - t.rank <= {s.threshold}, TRUE) AS keep
FROM p LEFT JOIN trust_rank t ON p.host = t.host LEFT JOIN distrust_rank d ON p.host = d.host
"""


ORACLE = _oracle()
