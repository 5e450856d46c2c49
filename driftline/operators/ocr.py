"""Recognised text: tokens to lines, tall images to slices, bounds, language codes, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = {"pl": "pl", "pol": "pl", "polish": "pl", "en": "en", "eng": "en", "english": "en", "de": "german", "deu": "german", "fr": "french", "fra": "french", "es": "es", "spa": "es"}


def language(code: Column) -> Column:
    """The recogniser's code of a language; English if unknown."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(code))], F.lit("en"))


def bounds(points: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of an array of (x, y): a box or a polygon."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def slices(height: Column, window: int = 1800, overlap: int = 220) -> Column:
    """struct(top, bottom) of overlapping windows; the last one ends at the bottom."""
    step = window - overlap
    n = F.ceil(F.greatest(F.lit(0), height - window) / F.lit(step)).cast("int")
    top = lambda i: F.greatest(F.lit(0), F.least(i * step, height - window))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(top(i).alias("top"), F.least(top(i) + window, height).alias("bottom")))


def lines(tokens: DataFrame, key: str) -> DataFrame:
    """key, line, text, score of tokens (x, y, w, h, text, score).

    A new line starts where y jumps by more than max(10, 0.6 median height); a
    line is split where the gap to the next token exceeds max(80, 3 median heights).
    """
    med = tokens.groupBy(F.col(key).alias("__k")).agg(F.percentile("h", 0.5).alias("med"))
    t = tokens.join(med, F.col(key) == F.col("__k")).drop("__k")
    by_y = Window.partitionBy(key).orderBy("y", "x")
    t = t.withColumn("__jump", F.coalesce(F.col("y") - F.lag("y").over(by_y) > F.greatest(F.lit(10.0), 0.6 * F.col("med")), F.lit(True)))
    t = t.withColumn("row", F.sum(F.col("__jump").cast("int")).over(by_y.rowsBetween(Window.unboundedPreceding, 0)))
    by_x = Window.partitionBy(key, "row").orderBy("x", "y")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(by_x) > F.greatest(F.lit(80.0), 3 * F.col("med"))
    t = t.withColumn("__gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("part", F.sum("__gap").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy(key, "row", "part").agg(F.array_sort(F.collect_list(F.struct("x", "y", "text"))).alias("ts"), F.avg("score").alias("score"), F.count("*").alias("tokens"))
    return g.select(key, "row", "part", F.array_join(F.transform("ts", lambda x: x["text"]), " ").alias("text"), "score", "tokens")


def page_text(line_rows: DataFrame, key: str) -> DataFrame:
    """key, text, confidence: lines put together, scores weighed by tokens."""
    g = line_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "part", "text"))).alias("ls"), (F.sum(F.col("score") * F.col("tokens")) / F.sum("tokens")).alias("confidence"))
    return g.select(key, F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"), "confidence")


def not_cached(snapshots: DataFrame, cache: DataFrame, keys: tuple[str, str] = ("snapshot_id", "source_hash")) -> DataFrame:
    """Snapshots that no cached result of the same source covers."""
    c = cache.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return snapshots.join(c, on, "left_anti")
