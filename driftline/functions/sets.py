"""Token sets, arrays and maps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.text import blank_to, blank_to_null, let, slug, squeeze


def words(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens_ws(x: Column, lower: bool = True) -> Column:
    return F.filter(F.split(F.lower(x) if lower else x, r"[ \n\t\r]+"), lambda t: t != "")


def shingles(x: Column, n: int = 1) -> Column:
    """Set of n-grams of words; fewer than n words are one shingle."""
    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) == 0, none).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(grams))

    return let(words(x), of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets (arrays without repeats): 1 if both are empty, 0 if one is."""

    def of(v: Column) -> Column:
        both, all_ = F.size(F.array_intersect(v["a"], v["b"])), F.size(v["a"]) + F.size(v["b"])
        return F.when(all_ == 0, 1.0).otherwise(let(both, lambda k: k / (all_ - k)))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def hashed(tokens: Column) -> Column:
    """The set of 64-bit hashes of tokens: eight bytes each, and compared without strings."""
    return F.array_distinct(F.transform(tokens, lambda x: F.xxhash64(x)))


def text_diff_score(a: Column, b: Column) -> Column:
    """1 - Jaccard of case-sensitive tokens between white space."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return 1 - jaccard(hashed(tokens_ws(x, lower=False)), hashed(tokens_ws(y, lower=False)))


def numeric_ratio_delta(a: Column, b: Column) -> Column:
    from driftline.functions.numbers import number_tokens

    return 1 - jaccard(F.array_distinct(number_tokens(a)), F.array_distinct(number_tokens(b)))


def uniq_ordered(a: Column) -> Column:
    return F.array_distinct(a)


def uniq_ordered_ci(a: Column) -> Column:
    """Order-preserving, the first of those that differ in case only."""
    both = F.struct(a.alias("a"), F.transform(a, F.lower).alias("low"))
    return let(both, lambda v: F.filter(v["a"], lambda x, i: F.array_position(v["low"], F.lower(x)) == i + 1))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def allowed_ids(used: Column, pool: Column) -> Column:
    """Ids in the pool, tried as they are and with their last ``:part`` dropped."""
    def of(p: Column) -> Column:
        base = F.transform(used, lambda x: F.when(F.array_contains(p, x), x).otherwise(F.regexp_replace(x, ":[^:]*$", "")))
        return F.array_distinct(F.filter(base, lambda x: F.array_contains(p, x)))

    return let(pool, of)


def sanitise(a: Column) -> Column:
    return F.filter(F.transform(a, squeeze), lambda x: x.isNotNull() & (x != ""))


def char_chunks(x: Column, size: int = 900, overlap: int = 120, most: int = 60) -> Column:
    """Slices of ``size`` characters that overlap."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(x) - overlap) / F.lit(step)).cast("int"))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1), lambda i: F.substr(x, i * step + 1, F.lit(size))))


def paragraph_numbers(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\[P([0-9]+)\]"), F.lit(1)), lambda t: t.cast("int"))))


def paragraph_blocks(x: Column, wanted: Column) -> Column:
    """Blocks ``[Pnnn] ...`` of the wanted paragraph numbers."""
    blocks = F.filter(F.split(x, r"(?=\[P[0-9]+\])"), lambda t: t != "")
    return let(wanted, lambda w: F.filter(blocks, lambda t: F.array_contains(w, F.regexp_extract(t, r"^\[P([0-9]+)\]", 1).try_cast("int"))))


def key_values(entries: Column) -> Column:
    """Array of (key, value) to a map: trimmed, the last of a key wins, blank values unknown."""
    named = F.filter(F.transform(entries, lambda e: F.struct(blank_to_null(e["key"]).alias("key"), blank_to(e["value"], "unknown").alias("value"))), lambda e: e["key"].isNotNull())

    def of(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        both = F.struct(es.alias("es"), keys.alias("keys"))
        return let(both, lambda v: F.map_from_entries(F.filter(v["es"], lambda e, i: ~F.array_contains(F.slice(v["keys"], i + 2, F.greatest(F.size(v["keys"]), F.lit(1))), e["key"]))))

    return let(named, of)


def map_diff(before: Column, after: Column) -> Column:
    """struct(added, removed, changed, any) of two maps."""
    added = F.array_sort(F.array_except(F.map_keys(after), F.map_keys(before)))
    removed = F.array_sort(F.array_except(F.map_keys(before), F.map_keys(after)))
    changed = F.array_sort(F.filter(F.array_intersect(F.map_keys(before), F.map_keys(after)), lambda k: ~before[k].eqNullSafe(after[k])))
    return F.struct(added.alias("added"), removed.alias("removed"), changed.alias("changed"), (F.size(added) + F.size(removed) + F.size(changed) > 0).alias("any"))


def merge_meta(images_a: Column, images_b: Column, attrs_a: Column, attrs_b: Column) -> tuple[Column, Column]:
    """Union of images; attributes of both, the second's where they clash."""
    keep = F.map_filter(attrs_a, lambda k, _: ~F.array_contains(F.map_keys(attrs_b), k))
    return F.array_union(images_a, images_b), F.map_concat(keep, attrs_b)


def template_valid(chunks: Column) -> Column:
    return (F.size(chunks) > 0) & F.forall(chunks, lambda c: blank_to_null(c["key"]).isNotNull() & (F.size(c["anchor_candidates"]) > 0))


def template_norm(chunks: Column, most: int = 18) -> Column:
    """Slug keys, anchors of 14 to 96 characters, one chunk of a key, ``most`` at most."""
    t = F.transform(chunks, lambda c: F.struct(slug(c["key"]).alias("key"), c["title"].alias("title"), F.filter(F.transform(c["anchor_candidates"], squeeze), lambda a: F.length(a).between(14, 96)).alias("anchor_candidates")))
    both = lambda v: F.struct(v.alias("t"), F.transform(v, lambda c: c["key"]).alias("keys"))
    first = lambda v: F.filter(v["t"], lambda c, i: (F.array_position(v["keys"], c["key"]) == i + 1) & (F.size(c["anchor_candidates"]) > 0))
    return F.slice(let(t, lambda v: let(both(v), first)), 1, most)
