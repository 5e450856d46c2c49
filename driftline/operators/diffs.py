"""Versions against their predecessors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT
from driftline.functions import sets
from driftline.functions import text as t


#: Versions of one key that one task puts in order, about; a key of more is cut by quantiles of its order.
VERSIONS_A_TASK = 65_536
_CUTS = [i / 256 for i in range(1, 256)]


def _cuts(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """key, cuts of the keys with more than ``most`` versions: a row for each ``most`` rows at most, so small enough to broadcast."""
    hot = df.groupBy(key).agg(F.count("*").alias("__n")).where((F.col("__n") > most) & F.col(key).isNotNull()).select(key)
    return df.select(key, order).join(F.broadcast(hot), key).groupBy(key).agg(F.percentile_approx(order, _CUTS).alias("__cuts"))


def previous(df: DataFrame, key: str, order: str, *columns: str, versions_a_task: int = VERSIONS_A_TASK) -> DataFrame:
    """As-of join with the version before: ``prev_<column>`` of each column.

    A key with many versions (``order`` is numeric there) is ordered in
    stretches, each a task's; the first of a stretch gets its predecessor from
    the end of the one before.  Rows of a null key are one stretch.
    """
    names = (order, *columns)
    numeric = dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    if not numeric:
        w = Window.partitionBy(key).orderBy(order)
        return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in names})
    cut = df.join(F.broadcast(_cuts(df, key, order, versions_a_task)), key, "left")
    at = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(order))))
    cut = cut.withColumns({"__hot": F.col("__cuts").isNotNull(), "__at": at}).drop("__cuts")
    w = Window.partitionBy(key, "__at").orderBy(order)
    inner = cut.withColumns({f"prev_{c}": F.lag(c).over(w) for c in names} | {"__first": F.row_number().over(w) == 1})
    # the last row of each stretch, as the predecessor of the next stretch's first
    ends = cut.where("__hot").groupBy(key, "__at").agg(F.max(order).alias("__end"))
    ends = ends.select(F.col(key).alias("__k"), F.lead("__at").over(Window.partitionBy(key).orderBy("__at")).alias("__a"), "__end").where("__a is not null")
    last = df.join(F.broadcast(ends), (F.col(key) == F.col("__k")) & (F.col(order) == F.col("__end")))  # 256 rows a hot key at most
    last = last.groupBy("__k", "__a").agg(F.any_value(F.struct(*names)).alias("__row"))
    met = inner.join(last, (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__a")), "left")
    out = {f"prev_{c}": F.when(F.col("__first"), F.col(f"__row.{c}")).otherwise(F.col(f"prev_{c}")) for c in names}
    return met.withColumns(out).drop("__k", "__a", "__row", "__first", "__hot", "__at")


def token_sets(df: DataFrame, text: str) -> DataFrame:
    """Adds tokens and words, the hashed sets that scores compare: found once a version, and what moves instead of its text."""
    return df.withColumns({"tokens": sets.hashed(sets.tokens_ws(F.coalesce(text, F.lit("")), lower=False)), "words": sets.hashed(sets.words(F.coalesce(text, F.lit(""))))})


def set_scores(pairs: DataFrame) -> DataFrame:
    """Adds text_diff and word_jaccard of tokens and words with those before; no version before is an empty text."""
    none = F.array().cast("array<bigint>")
    before = lambda c: F.coalesce(f"prev_{c}", none)
    return pairs.withColumns({"text_diff": 1 - sets.jaccard(before("tokens"), F.col("tokens")), "word_jaccard": sets.jaccard(before("words"), F.col("words"))})


def chunk_sets(x: Column) -> Column:
    """Hashed words of each character chunk, and whether it has a digit."""
    chunks = sets.char_chunks(F.coalesce(x, F.lit("")), DEFAULT.chunk_chars, DEFAULT.chunk_overlap, DEFAULT.chunks_most)
    return F.transform(chunks, lambda c: F.struct(sets.hashed(sets.words(c)).alias("words"), F.regexp_like(c, F.lit("[0-9]")).alias("digits")))


def band_best(before: Column, after: Column, band: int = DEFAULT.band) -> Column:
    """struct(best, digits) of each new chunk: its best Jaccard among old ones at most ``band`` away, 0 if there is none."""
    def near(i: Column) -> Column:
        first = F.greatest(i - band, F.lit(0))
        return F.slice(before, first + 1, i + band + 1 - first)

    best = lambda c, i: F.array_max(F.transform(near(i), lambda o: sets.jaccard(c["words"], o["words"])))
    return F.transform(after, lambda c, i: F.struct(F.coalesce(best(c, i), F.lit(0.0)).alias("best"), c["digits"].alias("digits")))


def chunk_band(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, i, best, digits: ``band_best`` of two texts, a row for each new chunk."""
    p = pairs.select(key, chunk_sets(F.col(before)).alias("b"), chunk_sets(F.col(after)).alias("a"))
    return p.select(key, F.posexplode(band_best(F.col("b"), F.col("a"))).alias("i", "x")).select(key, "i", "x.best", "x.digits")


def chunk_metrics(band: Column) -> Column:
    """struct of chunks, changed, changed_digits, max_diff, avg_similarity, ratio and significant of a pair's ``band_best``; null without chunks."""

    def of(v: Column) -> Column:
        diffs = F.transform(v, lambda x: 1 - x["best"])
        changed = F.filter(v, lambda x: 1 - x["best"] >= F.when(x["digits"], DEFAULT.changed_at_digits).otherwise(DEFAULT.changed_at))
        n, c, cd = F.size(v), F.size(changed), F.size(F.filter(changed, lambda x: x["digits"]))
        at = F.when(cd > 0, DEFAULT.significant_diff_digits).otherwise(DEFAULT.significant_diff)
        significant = (c > 0) & ((F.array_max(diffs) >= at) | (c / n >= DEFAULT.significant_ratio) | (c >= DEFAULT.significant_changed))
        mean = F.aggregate(v, F.lit(0.0), lambda z, x: z + x["best"]) / n
        parts = {"chunks": n.cast("bigint"), "changed": c.cast("bigint"), "changed_digits": cd.cast("bigint"), "max_diff": F.array_max(diffs), "avg_similarity": mean, "ratio": c / n, "significant": significant}
        return F.when(n > 0, F.struct(*[x.alias(k) for k, x in parts.items()]))

    return t.let(band, of)


def chunk_full_outer(before: DataFrame, after: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, change (added, removed, changed, same), delta of chunks of two versions by id."""
    b = before.select(*keys, F.col(text).alias("before"))
    a = after.select(*keys, F.col(text).alias("after"))
    j = b.join(a, keys, "full")
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    delta = F.when(both, 1 - sets.jaccard(sets.hashed(sets.tokens_ws(F.col("before"))), sets.hashed(sets.tokens_ws(F.col("after")))))
    numeric = F.when(both, sets.numeric_ratio_delta(F.col("before"), F.col("after")))
    j = j.withColumns({"delta": delta, "numeric_delta": numeric})
    at = F.when(F.col("numeric_delta") >= 0.12, 0.08).otherwise(0.12)
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("delta") >= at, "changed").otherwise("same")
    return j.withColumn("change", change)


def template_diff_metrics(changes: DataFrame, key: str) -> DataFrame:
    """Per pair: counts by kind of change and significance."""
    strong = (F.col("change") == "changed") & (F.col("delta") >= F.when(F.col("numeric_delta") >= 0.12, 0.14).otherwise(0.18))
    g = changes.groupBy(key).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")], F.count("*").alias("chunks"), F.coalesce(F.bool_or(strong), F.lit(False)).alias("strong"))
    return g.withColumn("significant", (F.col("changed") >= 2) | (F.col("changed") / F.col("chunks") >= 0.08) | F.col("strong"))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(t.squeeze_strict(x), "[.!?]+"), lambda s_: F.trim(s_)), lambda s: F.length(s).between(6, 220))


def added_removed(pairs: DataFrame, before: str, after: str, most: int = 5) -> DataFrame:
    """Adds ``added`` and ``removed``: sentences of one side only, in order, ``most`` of each."""
    low = lambda s: F.transform(s, F.lower)

    def only(here: str, there: str) -> Column:
        other = low(sentences(F.col(there)))
        return t.let(other, lambda o: F.filter(sentences(F.col(here)), lambda s: ~F.array_contains(o, F.lower(s))))

    return pairs.withColumns({"added": F.slice(sets.uniq_ordered_ci(only(after, before)), 1, most), "removed": F.slice(sets.uniq_ordered_ci(only(before, after)), 1, most)})


def score_text(name: str, score: Column) -> Column:
    return F.format_string(name + "(score=%.3f)", score.cast("double"))


def reasons(*pairs: tuple[Column, Column]) -> Column:
    """Texts whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, x) for c, x in pairs]), lambda x: x.isNotNull())


def machine_diff(pairs: DataFrame) -> DataFrame:
    """reasons, any_change and significant of rows with text_diff, the title before and after, and chunk metrics."""
    known = F.col("prev_version").isNotNull()
    title = known & ~t.squeeze_strict(F.col("prev_title")).eqNullSafe(t.squeeze_strict(F.col("title")))
    text = known & (F.col("text_diff") > DEFAULT.text_reason_at)
    chunks = known & (F.coalesce("changed", F.lit(0)) > 0)
    listed = reasons(
        (~known, F.lit("no_prev_snapshot")),
        (title, F.lit("title_changed")),
        (text, score_text("text_changed", F.col("text_diff"))),
        (chunks, F.format_string("text_chunk_changed(changed=%d/%d,mode=chars)", "changed", "chunks")),
    )
    return pairs.withColumns({"reasons": listed, "any_change": known & (title | text | chunks), "significant": known & ((F.col("text_diff") > DEFAULT.text_significant_at) | F.coalesce("significant", F.lit(False)))})


def decision(any_change: Column, significant: Column, before: Column, after: Column) -> Column:
    """struct(important, category): the deterministic judge, with no provider asked.

    Equal evidence on both sides is never important.
    """
    same = sets.same_set(F.transform(before, t.quote_norm), F.transform(after, t.quote_norm))
    important = any_change & significant & ~same
    return F.struct(important.alias("important"), F.when(important, "content_change").when(any_change, "minor_change").otherwise("no_change").alias("category"))


def metric_decision(deltas: Column) -> Column:
    """Any metric that changed (non-null struct) makes a metric change."""
    changed = F.exists(deltas, lambda d: d.isNotNull())
    return F.struct(changed.alias("important"), F.when(changed, "metric_change").otherwise("minor_change").alias("category"))
