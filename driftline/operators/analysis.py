"""From a snapshot to its analysis, and the whole change pipeline.

Language models are providers: functions over a DataFrame that add a column.
None is needed; without one the deterministic path runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import DEFAULT
from driftline.functions import numbers, predicates, sets
from driftline.functions import text as t
from driftline.operators import diffs, evidence, lines

#: Adds columns summary, metrics, router_labels or important, as the stage asks.
Provider = Callable[[DataFrame], DataFrame]


def chunk_source(dom_clean: Column, ocr_clean: Column, dom_raw: Column, ocr_raw: Column) -> Column:
    """struct(source, text): the first that isn't blank, its trailing blank lines dropped."""
    named = [("dom_clean", dom_clean), ("ocr_clean", ocr_clean), ("dom_raw", dom_raw), ("ocr_raw", ocr_raw)]
    return F.coalesce(*[F.when(t.blank_to_null(x).isNotNull(), F.struct(F.lit(n).alias("source"), F.regexp_replace(x, r"\s+$", "").alias("text"))) for n, x in named])


def chunk_mode(wanted: Column, provider: bool) -> Column:
    """semantic only where it is asked for, or auto, and there is a provider."""
    low = F.lower(F.trim(F.coalesce(wanted, F.lit("auto"))))
    return F.when(low.isin("semantic", "auto") & F.lit(provider), "semantic").otherwise("deterministic")


def cache_valid(version: Column, sha: Column, text_sha: Column, method: Column, wanted: Column, n_chunks: Column, current: int = 1) -> Column:
    return (version == current) & sha.eqNullSafe(text_sha) & (F.split_part(method, F.lit("_"), F.lit(1)) == wanted) & (n_chunks > 0)


def reuse_template(fit: Column, baseline: Column, fresh: Column) -> Column:
    """The baseline's template while it fits, else the fresh one."""
    return F.when(baseline.isNotNull() & (fit >= DEFAULT.fit_reuse), baseline).otherwise(fresh)


def quotes(items: Column, plain: Column, before: Column, after: Column) -> Column:
    """Evidence quotes wherever an analysis keeps them: items, a list, or two sides."""
    of = F.when(F.size(items) > 0, F.transform(items, lambda x: F.coalesce(x["quote"], x["text"])))
    return sets.sanitise(F.coalesce(of, F.when(F.size(plain) > 0, plain), F.concat(F.coalesce(before, F.array().cast("array<string>")), F.coalesce(after, F.array().cast("array<string>")))))


def derived_metrics(qs: Column) -> Column:
    """struct(rating, reviews, trend_price): of the first quote that has it, else of all together."""
    joined = F.array_join(qs, " ")
    first = lambda f: F.coalesce(F.get(F.filter(F.transform(qs, f), lambda v: v.isNotNull()), F.lit(0)), f(joined))
    return F.struct(first(numbers.rating).alias("rating"), first(numbers.review_count).alias("reviews"), first(numbers.trend_price).alias("trend_price"))


def focus(chunks: DataFrame, focus_ids: DataFrame, key: str) -> DataFrame:
    """Chunks that are in focus, by normalised id; ``discovery`` where a key has none."""
    norm = lambda c: F.regexp_replace(F.lower(c), "^c_", "")
    f = focus_ids.select(F.col(key).alias("__k"), norm(F.col("chunk_id")).alias("__id")).distinct()
    hit = chunks.join(f, (F.col(key) == F.col("__k")) & (norm(F.col("id")) == F.col("__id")), "left_semi")
    n = hit.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("focused"))
    return chunks.groupBy(key).agg(F.count("*").alias("chunks")).join(n, F.col(key) == F.col("__k"), "left").select(key, "chunks", F.coalesce("focused", F.lit(0)).alias("focused"), F.col("focused").isNull().alias("discovery"))


def summarise(snapshots: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Adds ``summary``; null without a provider."""
    return provider(snapshots) if provider else snapshots.withColumn("summary", F.lit(None).cast("string"))


def email_text(title: Column, body: Column, url: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(t.blank_to_null(title), F.lit("A page has changed")), t.blank_to_null(body), t.blank_to_null(url))


def change_pipeline(snapshots: DataFrame, prompt: Column | None = None, judge: Provider | None = None) -> DataFrame:
    """snapshots (monitor_id, version, title, text) to decisions.

    As-of pair, text scores and character chunks, early exit as a filter, then
    evidence of both sides and the decision; the evidence, which runs in Python,
    sees only pairs that got through.
    """
    p = diffs.previous(snapshots, "monitor_id", "version", "title", "text").where("prev_version is not null")
    p = p.withColumns({"text_diff": sets.text_diff_score(F.col("prev_text"), F.col("text")), "m": diffs.chunk_metrics(diffs.band_best(diffs.chunk_sets(F.col("prev_text")), diffs.chunk_sets(F.col("text"))))})
    d = diffs.machine_diff(p.select("*", "m.chunks", "m.changed", "m.significant").drop("m"))
    ask = F.lit(None).cast("string") if prompt is None else prompt
    d = d.where(~predicates.early_exit(F.col("any_change"), F.col("significant"), F.lit(False), F.lit(False), ask))
    kws = F.coalesce(evidence.keywords(ask), F.array().cast("array<string>"))
    found = lambda c: F.transform(F.slice(evidence.candidates(F.col(c), evidence.wants_of(ask), kws), 1, DEFAULT.evidence_total), lambda x: x["quote"])
    d = d.withColumns({"before": found("prev_text"), "after": found("text")})
    d = judge(d) if judge else d
    x = diffs.decision(F.col("any_change"), F.col("significant"), F.when(F.size("before") > 0, F.col("before")).otherwise(F.array("prev_text")), F.when(F.size("after") > 0, F.col("after")).otherwise(F.array("text")))
    return d.withColumn("decision", x).select("monitor_id", "version", "prev_version", "reasons", "significant", "decision.important", "decision.category", derived_metrics(F.col("after")).alias("metrics"))


def analyses(snapshots: DataFrame) -> DataFrame:
    """key version, chunks: a snapshot's lines segmented, merged and packed."""
    segs = lines.merged_segments(lines.segments(F.split("text", "\n")))
    return snapshots.select("monitor_id", "version", F.sha1(F.trim("text")).alias("text_sha1"), lines.packed_chunks(segs).alias("chunks"))
