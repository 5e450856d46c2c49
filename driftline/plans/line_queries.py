"""Line operators over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import predicates
from driftline.operators import lines as ln
from driftline.sources.tables import table

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


LINES = "(SELECT doc_id, pos, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line, ' ') <> '')"
ALNUM = r"len(regexp_extract_all(line, '[\p{L}\p{N}]'))"
ALPHA, DIGIT = r"len(regexp_extract_all(line, '\p{L}'))", r"len(regexp_extract_all(line, '\p{N}'))"
SOLID = "nullif(length(line), 0)"
FP = r"trim(regexp_replace(lower(line), '[\p{P}\p{S}\s\x{00A0}]+', ' ', 'g'))"
EXACT = r"trim(regexp_replace(lower(line), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g'))"
TOKENS = r"len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> ''))"
Q_ALPHA, Q_DIGIT = f"coalesce({ALPHA}::DOUBLE / {SOLID}, 0)", f"coalesce({DIGIT}::DOUBLE / {SOLID}, 0)"
Q_OTHER = f"coalesce(({SOLID} - {ALPHA} - {DIGIT} - length(line) + length(replace(line, ' ', '')))::DOUBLE / {SOLID}, 0)"
JUNK = rf"(({ALNUM} < 2 AND NOT regexp_matches(line, '^[0-9]{{2,}}([.,][0-9]+)?[%+]?$')) OR ({Q_ALPHA} < 0.12 AND {Q_DIGIT} < 0.08 AND {Q_OTHER} > 0.45 AND length(line) < 140))"
UI = f"({TOKENS} <= 10 AND ({Q_ALPHA} < 0.78 OR {Q_DIGIT} > 0.22))"


def lines(spark, d):
    return ln.explode_lines(table(spark, d, "documents"), "doc_id", "text")


@query("line_frequency", f"SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, {FP}) AS freq FROM {LINES}")
def frequency(spark, d):
    return ln.line_frequency(lines(spark, d), "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "freq")


@query("line_quality", f"SELECT doc_id, pos, round({Q_ALPHA}, 6) AS alpha, round({Q_DIGIT}, 6) AS digit, round({Q_OTHER}, 6) AS other, {TOKENS}::BIGINT AS tokens FROM {LINES}")
def quality(spark, d):
    q = predicates.line_quality(F.col("line"))
    return lines(spark, d).select("doc_id", F.col("pos").cast("bigint").alias("pos"), *[F.round(q[k], 6).alias(k) for k in ("alpha", "digit", "other")], q["tokens"].cast("bigint").alias("tokens"))


@query("junk_filter", f"SELECT doc_id, pos FROM {LINES} WHERE NOT {JUNK}")
def junk(spark, d):
    return lines(spark, d).where(~predicates.junk_line(F.col("line"))).select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("boilerplate_first", f"""
WITH f AS (SELECT *, {FP} AS fp FROM {LINES}), g AS (SELECT *, fp <> '' AND count(*) OVER (PARTITION BY doc_id, fp) >= 2 AND length(line) <= 90 AND {UI} AS ui FROM f)
SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fp, ui ORDER BY pos) AS nth FROM g) WHERE NOT (ui AND nth > 1)""")
def boilerplate(spark, d):
    return ln.drop_boilerplate(lines(spark, d), "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("dedupe_exact", f"SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {EXACT} ORDER BY pos) AS nth FROM {LINES}) WHERE nth = 1 OR {EXACT} = ''")
def exact(spark, d):
    return ln.dedupe_exact(lines(spark, d), "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("dedupe_sliding")
def sliding(spark, d):
    """Lines left when a repeat of one kept among the 80 before is dropped."""
    x = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    return x.select("doc_id", F.size("ls").alias("lines"), F.size(ln.dedupe_sliding(F.col("ls"))).alias("kept"))


@query("char_budget", f"SELECT doc_id, pos, used FROM (SELECT doc_id, pos, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT - 1 AS used, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM {LINES}) WHERE used <= 2000 AND nth <= 12")
def budget(spark, d):
    return ln.char_budget(lines(spark, d), "doc_id", 2000, 12).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "used")


@query("clean_lines_dom")
def clean(spark, d):
    x = ln.clean_dom(table(spark, d, "documents"), "doc_id", "text")
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.sha1("line").alias("line_sha1"))


@query("paragraph_index", """
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10) || chr(10)), chr(10)) AS ls FROM documents)),
e AS (SELECT *, trim(line, ' ') = '' OR trim(line, ' ') = '<PARA>' AS edge FROM l),
s AS (SELECT *, CASE WHEN NOT edge AND coalesce(lag(edge) OVER (PARTITION BY doc_id ORDER BY pos), TRUE) THEN 1 ELSE 0 END AS st FROM e)
SELECT doc_id, pos, CASE WHEN NOT edge THEN sum(st) OVER (PARTITION BY doc_id ORDER BY pos) END::BIGINT AS para FROM s""")
def paragraphs(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit("\n\n")), "\n")).alias("pos", "line"))
    return ln.paragraph_index(x, "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("para").cast("bigint").alias("para"))


@query("doc_script_stats", r"""
WITH h AS (SELECT doc_id, left(text, 12000) AS t FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(t, '\p{L}'))::DOUBLE AS l, len(regexp_extract_all(t, '\p{Latin}')) AS la, len(regexp_extract_all(t, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) AS cjk FROM h)
SELECT doc_id, coalesce(la / nullif(l, 0), 0) >= 0.45 AND coalesce(cjk / nullif(l, 0), 0) <= 0.35 AS latin FROM c""")
def scripts(spark, d):
    return table(spark, d, "documents").select("doc_id", predicates.latin_dominant(F.col("text")).alias("latin"))


@query("serialized_blob_flag", r"""
WITH c AS (SELECT page_id, html, length(html)::DOUBLE AS n, len(regexp_extract_all(html, '[\[\]{}":,\\]')) AS p, len(regexp_extract_all(html, '[A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]')) AS l, len(regexp_extract_all(html, '"')) AS q, len(regexp_extract_all(html, ':')) AS k FROM pages)
SELECT page_id, n >= 180 AND (regexp_matches(html, '(?i)\$snuxt|@context|@type|__next|__nuxt|apollo|hydration|pinia|redux|schema\.org|webpack') OR (p / n > 0.12 AND l / n < 0.75) OR (q >= 20 AND k >= 10)) AS serialised FROM c""")
def blobs(spark, d):
    return table(spark, d, "pages").select("page_id", predicates.serialised(F.col("html")).alias("serialised"))


@query("drop_line_rules", rf"""
SELECT doc_id, pos FROM {LINES} WHERE length(line) = 0 OR len(regexp_extract_all(line, '[\[\]{{}}\\"]')) >= 3 OR regexp_matches(line, '(?i)https?://\S+|(?:^|\s)/api/\S+|mailto:|tel:|\S+@\S+\.\S+')
 OR len(regexp_extract_all(line, '/')) >= 6 OR regexp_matches(line, '(?i)\$snuxt|@context|@type|__next|__nuxt|apollo|hydration|pinia|redux|schema\.org') OR regexp_matches(line, '(?i)no elements found|list is empty')
 OR (length(line) >= 30 AND len(regexp_extract_all(line, '[0-9A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]'))::DOUBLE / length(line) < 0.55) OR (length(line) <= 1 AND NOT regexp_matches(line, '^[0-9]$'))""")
def drops(spark, d):
    return lines(spark, d).where(predicates.drop_line(F.col("line"))).select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("structure_score", r"""
WITH l AS (SELECT doc_id, trim(text, ' ') AS t, list_filter(list_transform(string_split(trim(text, ' '), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents),
c AS (SELECT *, len(ls) AS n, len(list_filter(ls, lambda x: regexp_matches(x, '^#{1,6}\s+'))) AS h, len(list_filter(ls, lambda x: regexp_matches(x, '^(?:\s*-\s+|\s*[0-9]+\.\s+)'))) AS li, len(list_filter(ls, lambda x: regexp_matches(x, '^[^:]{2,60}:\s\s*\S'))) AS kv,
 len(regexp_extract_all(t, 'https?://')) AS u, len(regexp_extract_all(t, '[{}\[\]]')) AS br FROM l)
SELECT doc_id, round(CASE WHEN t = '' THEN 0 ELSE greatest(0, least(1, (least(1, n / 120.0::DOUBLE) * 0.35 + least(1, h / 6.0::DOUBLE) * 0.25 + least(1, li / 30.0::DOUBLE) * 0.2 + least(1, kv / 30.0::DOUBLE) * 0.15
 + CASE WHEN length(t)::DOUBLE / greatest(1, n) <= 160 THEN 0.05 ELSE 0 END - CASE WHEN n <= 2 AND length(t) > 800 THEN 0.3 ELSE 0 END - least(0.4, u * 0.05 + br / 200.0::DOUBLE)) * 0.8::DOUBLE)) END, 6)::DOUBLE AS score FROM c""")
def structure(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(predicates.structure_score(F.col("text"), F.lit(0.5), F.lit(False)), 6).alias("score"))


@query("fixed_line_chunks", f"""
WITH n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM {LINES})
SELECT doc_id, CAST(floor(n / 24) AS INTEGER) AS chunk, CAST(min(n) AS INTEGER) AS from_line, CAST(max(n) AS INTEGER) AS to_line, sha1(string_agg(line, chr(10) ORDER BY n)) AS text_sha1 FROM n GROUP BY ALL""")
def fixed(spark, d):
    return ln.fixed_chunks(lines(spark, d), "doc_id").select("doc_id", "chunk", F.col("from_line").cast("int").alias("from_line"), F.col("to_line").cast("int").alias("to_line"), F.sha1("text").alias("text_sha1"))


@query("chunk_ranges_valid", """
WITH r AS (SELECT user_id, event_id % 40 AS a, event_id % 40 + event_id % 4 - 1 AS b FROM events),
s AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY a, b), -1) AS p FROM r)
SELECT user_id, coalesce(CASE WHEN b < a THEN 'order' WHEN a > p + 1 THEN 'hole:' || (p + 1) || '..' || (a - 1) WHEN a <= p THEN 'overlap' END, 'ok') AS error, count(*) AS n FROM s GROUP BY ALL""")
def ranges(spark, d):
    a = F.col("event_id") % 40
    r = table(spark, d, "events").select("user_id", a.alias("from_line"), (a + F.col("event_id") % 4 - 1).alias("to_line"))
    return ln.range_errors(r, "user_id").groupBy("user_id", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


def _segments(spark, d):
    return table(spark, d, "documents").select("doc_id", ln.segments(F.split("text", "\n")).alias("s"))


@query("segments")
def segments(spark, d):
    return _segments(spark, d).select("doc_id", F.explode("s").alias("x")).select("doc_id", "x.kind", "x.from_line", "x.to_line", F.sha1("x.text").alias("text_sha1"))


@query("chunk_pack")
def packed(spark, d):
    m = _segments(spark, d).select("doc_id", ln.merged_segments(F.col("s")).alias("s"))
    return m.select("doc_id", F.explode(ln.packed_chunks(F.col("s"))).alias("c")).select("doc_id", "c.id", "c.from_line", "c.to_line", F.sha1("c.text").alias("text_sha1"))


@query("template_apply")
def template(spark, d):
    """Every conversation turn cut by a template of the turn before."""
    from driftline.functions import text as t
    from driftline.operators import diffs

    p = diffs.previous(table(spark, d, "conversations"), "conv_id", "turn", "text").where("prev_text is not null")
    anchors = F.transform(t.first_words_template(F.col("prev_text")), lambda c: c["anchor_candidates"])
    return p.select("conv_id", "turn", F.size(ln.template_chunks(F.col("text"), anchors)).alias("chunks"), ln.template_fit(F.col("text"), anchors).alias("fit"))
