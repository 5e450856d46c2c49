"""Scalar library and version diffs over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import numbers, predicates, sets
from driftline.functions import text as t
from driftline.operators import diffs, evidence
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


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


WS = r"[ \n\t\r]+"
JAC = "CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({x}, '{WS}'), lambda t: t <> ''))"


def _words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'))"


@query("prev_text_diff", f"""
WITH p AS (SELECT source, doc_id, text, lag(text) OVER w AS prev, lag(doc_id) OVER w AS prev_doc_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
s AS (SELECT *, {_tokens("coalesce(prev, '')")} AS a, {_tokens('text')} AS b, {_words("coalesce(prev, '')")} AS wa, {_words('text')} AS wb FROM p)
SELECT source, doc_id, prev_doc_id, round(1 - {JAC}, 6) AS text_diff, round({JAC.replace('(a', '(wa').replace('b)', 'wb)').replace('len(a)', 'len(wa)')}, 6) AS word_jaccard,
 prev_doc_id IS NOT NULL AND 1 - {JAC} > 0.15 AS significant FROM s""")
def prev_text_diff(spark, d):
    """As-of predecessor by source, token distance and its significance: the flagship."""
    p = diffs.token_sets(table(spark, d, "documents").select("source", "doc_id", "text"), "text").drop("text")
    p = diffs.set_scores(diffs.previous(p, "source", "doc_id", "tokens", "words"))
    significant = F.col("prev_doc_id").isNotNull() & (F.col("text_diff") > 0.15)
    return rounded(p.select("source", "doc_id", "prev_doc_id", "text_diff", "word_jaccard", significant.alias("significant")), "text_diff", "word_jaccard")


@query("asof_previous", """
SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, sha1(lag(text) OVER w) AS prev_sha1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def asof(spark, d):
    p = diffs.previous(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return p.select("conv_id", "turn", "prev_turn", F.sha1("prev_text").alias("prev_sha1"))


@query("ws_normalize", r"""
SELECT doc_id, sha1(trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g'))) AS squeezed, sha1(CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END) AS ellipsis,
 sha1(CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || '...[TRUNCATED]' ELSE text END) AS marked, left(trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g')), 220) AS excerpt FROM documents""")
def ws(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha1(t.squeeze(x)).alias("squeezed"), F.sha1(t.clamp_ellipsis(x, 500)).alias("ellipsis"), F.sha1(t.clamp_marked(x, 500)).alias("marked"), t.excerpt(x).alias("excerpt"))


@query("hashes", """
SELECT doc_id, sha1(nullif(text, '')) AS sha1, sha256(text) AS sha256, sha1(nullif(trim(source), '')) AS prompt FROM documents""")
def hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", t.sha1_or_null(F.col("text")).alias("sha1"), F.sha2("text", 256).alias("sha256"), t.prompt_hash(F.col("source")).alias("prompt"))


@query("slugify", r"""
SELECT doc_id, left(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(text), '\p{Mn}+', '', 'g'), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'chunk'), 48) AS slug FROM documents""")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", t.slug(F.col("text")).alias("slug"))


@query("entities_and_letters", """
SELECT page_id, sha1(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>')) AS decoded,
 sha1(regexp_replace(regexp_replace(url, '([0-9])([A-Za-ząćęłńóśźżĄĆĘŁŃÓŚŹŻ])', '\\1 \\2', 'g'), '([A-Za-ząćęłńóśźżĄĆĘŁŃÓŚŹŻ])([0-9])', '\\1 \\2', 'g')) AS apart FROM pages""".replace("\\\\", "\\"))
def entities(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha1(t.decode_entities(F.col("html"))).alias("decoded"), F.sha1(t.split_letters_digits(F.col("url"))).alias("apart"))


@query("fingerprint_keys", r"""
SELECT doc_id, pos, sha1(trim(regexp_replace(lower(line), '[\p{P}\p{S}\s\x{00A0}]+', ' ', 'g'))) AS fingerprint, sha1(trim(regexp_replace(lower(line), '[ \t\r]+', ' ', 'g'))) AS exact_key FROM (
 SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""")
def fingerprints(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.sha1(t.fingerprint(F.col("line"))).alias("fingerprint"), F.sha1(t.exact_key(F.col("line"))).alias("exact_key"))


@query("head_tail_tags", r"""
SELECT doc_id, CASE WHEN length(text) <= 320 THEN [sha1(text)] ELSE [sha1(left(text, 180)), sha1(right(text, 180))] END AS parts,
 '[P' || lpad(doc_id::VARCHAR, greatest(3, length(doc_id::VARCHAR))::INTEGER, '0') || ']' AS tag FROM documents""")
def head_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.transform(t.head_tail(F.col("text")), F.sha1).alias("parts"), t.para_tag(F.col("doc_id")).alias("tag"))


@query("token_sets", rf"""
WITH s AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM conversations)
SELECT conv_id, turn, len(w)::BIGINT AS words, len(list_distinct(w))::BIGINT AS distinct_words,
 (CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END)::BIGINT AS shingles FROM s""")
def token_sets(spark, d):
    c = table(spark, d, "conversations")
    w = sets.words(F.col("text"))
    return c.select("conv_id", "turn", F.size(w).cast("bigint").alias("words"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct_words"), F.size(sets.shingles(F.col("text"), 3)).cast("bigint").alias("shingles"))


@query("shingle_jaccard", rf"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
s AS (SELECT conv_id, turn, {_words('prev')} AS a, {_words('text')} AS b, list_distinct(regexp_extract_all(prev, '[0-9]+[0-9.,]*')) AS na, list_distinct(regexp_extract_all(text, '[0-9]+[0-9.,]*')) AS nb FROM p WHERE prev IS NOT NULL)
SELECT conv_id, turn, round({JAC}, 6) AS jaccard, round(1 - ({JAC.replace('(a', '(na').replace('b)', 'nb)').replace('len(a)', 'len(na)')}), 6) AS numeric_delta FROM s""")
def jaccards(spark, d):
    p = diffs.previous(table(spark, d, "conversations"), "conv_id", "turn", "text").where("prev_text is not null")
    words = lambda c: F.array_distinct(sets.words(F.col(c)))
    return rounded(p.select("conv_id", "turn", sets.jaccard(words("prev_text"), words("text")).alias("jaccard"), sets.numeric_ratio_delta(F.col("prev_text"), F.col("text")).alias("numeric_delta")), "jaccard", "numeric_delta")


@query("char_chunks", """
WITH n AS (SELECT doc_id, text, least(60, greatest(1, CAST(ceil((length(text) - 120) / 780.0) AS INTEGER))) AS n FROM documents WHERE length(text) > 0)
SELECT doc_id, i AS chunk, sha1(substr(text, i * 780 + 1, 900)) AS chunk_sha1 FROM (SELECT doc_id, text, unnest(range(n)) AS i FROM n)""")
def char_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(sets.char_chunks(F.col("text"))).alias("chunk", "x"))
    return c.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.sha1("x").alias("chunk_sha1"))


#: What documents are asked for by queries that need a prompt.
PROMPTS = ("price changes only", "opinie i oceny", "new products on the list", "top 5 ranking list of products", "news articles, new entries", "delivery and availability", "headline and password", "paragraphs from 1 to 3", "how many results, filters")

BAND = rf"""
n AS (SELECT k, text, prev, least(60, greatest(1, CAST(ceil((length(text) - 120) / 780.0) AS INTEGER))) AS nn, least(60, greatest(1, CAST(ceil((length(prev) - 120) / 780.0) AS INTEGER))) AS np FROM p WHERE length(text) > 0 AND length(prev) > 0),
new AS (SELECT k, i, substr(text, i * 780 + 1, 900) AS c FROM (SELECT k, text, unnest(range(nn)) AS i FROM n)),
old AS (SELECT k, j, substr(prev, j * 780 + 1, 900) AS c FROM (SELECT k, prev, unnest(range(np)) AS j FROM n)),
s AS (SELECT new.k, i, j, new.c, {_words('new.c')} AS a, {_words('old.c')} AS b FROM new LEFT JOIN old ON old.k = new.k AND j BETWEEN i - 2 AND i + 2),
band AS (SELECT k, i, max(CASE WHEN j IS NULL THEN 0.0 ELSE {JAC} END) AS best, bool_or(regexp_matches(c, '[0-9]')) AS digits FROM s GROUP BY k, i),
m AS (SELECT k, count(*) AS chunks, count(*) FILTER (1 - best >= CASE WHEN digits THEN 0.08 ELSE 0.12 END) AS changed,
 count(*) FILTER (digits AND 1 - best >= 0.08) AS changed_digits, max(1 - best) AS max_diff, avg(best) AS avg_similarity FROM band GROUP BY k)"""
TURNS = "p AS (SELECT conv_id * 1000 + turn AS k, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)"
SIGNIFICANT = "changed > 0 AND (max_diff >= CASE WHEN changed_digits > 0 THEN 0.14 ELSE 0.18 END OR changed / chunks >= 0.08 OR changed >= 2)"


def _turn_pairs(spark, d):
    p = diffs.previous(table(spark, d, "conversations"), "conv_id", "turn", "text").where((F.length("text") > 0) & (F.length("prev_text") > 0))
    return p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text", "prev_text")


@query("chunk_band_best_match", f"WITH {TURNS}, {BAND} SELECT k, i, round(best, 6) AS best, digits FROM band")
def band(spark, d):
    return rounded(diffs.chunk_band(_turn_pairs(spark, d), "k", "prev_text", "text").select("k", F.col("i").cast("bigint").alias("i"), "best", "digits"), "best")


@query("text_chunk_metrics", f"""
WITH {TURNS}, {BAND}
SELECT k, chunks, changed, round(max_diff, 6) AS max_diff, round(avg_similarity, 6) AS avg_similarity, {SIGNIFICANT} AS significant FROM m""")
def metrics(spark, d):
    p = _turn_pairs(spark, d).select("k", diffs.chunk_sets(F.col("prev_text")).alias("b"), diffs.chunk_sets(F.col("text")).alias("a"))
    m = p.select("k", diffs.chunk_metrics(diffs.band_best(F.col("b"), F.col("a"))).alias("m"))
    return rounded(m.select("k", *[f"m.{c}" for c in ("chunks", "changed", "max_diff", "avg_similarity", "significant")]), "max_diff", "avg_similarity")


@query("sentences_added_removed", r"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g')), '[.!?]+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 6 AND 220) AS a,
 list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(prev, '[ \n\t\r]+', ' ', 'g')), '[.!?]+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 6 AND 220) AS b FROM p WHERE prev IS NOT NULL),
e AS (SELECT conv_id, turn, unnest(range(len(a))) AS i, unnest(a) AS x, list_transform(b, lambda y: lower(y)) AS lb FROM s),
u AS (SELECT conv_id, turn, lower(x) AS x, min(i) AS i FROM e WHERE NOT list_contains(lb, lower(x)) GROUP BY ALL)
SELECT s.conv_id, s.turn, least(5, count(u.x))::BIGINT AS added, coalesce(min_by(u.x, u.i), '') AS first_added FROM s LEFT JOIN u USING (conv_id, turn) GROUP BY s.conv_id, s.turn""")
def added_removed(spark, d):
    p = diffs.previous(table(spark, d, "conversations"), "conv_id", "turn", "text").where("prev_text is not null")
    return diffs.added_removed(p, "prev_text", "text").select("conv_id", "turn", F.size("added").cast("bigint").alias("added"), F.coalesce(F.lower(F.get("added", F.lit(0))), F.lit("")).alias("first_added"))


@query("chunk_full_outer_diff")
def full_outer(spark, d):
    """Packed chunks of every document against those of the version before, by chunk id.

    The first version of a source has all its chunks added.
    """
    doc = table(spark, d, "documents")
    later = doc.select("source", "doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("next_id"))
    segs = ln.merged_segments(ln.segments(F.split("text", "\n")))
    c = doc.select("source", "doc_id", F.explode(ln.packed_chunks(segs)).alias("c")).select("source", "doc_id", F.col("c.id").alias("chunk_id"), "c.text")
    before = c.join(later.where("next_id is not null"), ["source", "doc_id"]).select("source", F.col("next_id").alias("doc_id"), "chunk_id", "text")
    return diffs.chunk_full_outer(before, c, ["source", "doc_id", "chunk_id"]).select("source", "doc_id", "chunk_id", "change")


@query("map_diff", """
WITH g AS (SELECT user_id, ts < TIMESTAMP '2024-01-15' AS early, event_type, count(*) % 3 AS v FROM events GROUP BY ALL),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS k, a.v AS x, b.v AS y FROM (SELECT * FROM g WHERE early) a FULL JOIN (SELECT * FROM g WHERE NOT early) b ON a.user_id = b.user_id AND a.event_type = b.event_type)
SELECT user_id, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS removed, count(*) FILTER (x <> y) AS changed FROM j GROUP BY user_id""")
def map_diff(spark, d):
    g = table(spark, d, "events").groupBy("user_id", (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("early"), "event_type").agg((F.count("*") % 3).alias("v"))
    kv = F.struct("event_type", "v")
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("early"), kv))).alias("a"), F.map_from_entries(F.collect_list(F.when(~F.col("early"), kv))).alias("b"))
    x = sets.map_diff(F.col("a"), F.col("b"))
    return m.select("user_id", *[F.size(x[k]).cast("bigint").alias(k) for k in ("added", "removed", "changed")])


@query("price_parse", r"""
WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice || ' zł' WHEN 1 THEN '$' || p_retailprice WHEN 2 THEN '1 ' || replace(p_retailprice::VARCHAR, '.', ',') || ' EUR' WHEN 3 THEN p_size || ' usd' ELSE p_name END AS raw FROM part),
y AS (SELECT *, regexp_replace(regexp_extract(raw, '([0-9\s,.]+)\s*([żł€£$A-Za-z]{0,4})', 1), '\s', '', 'g') AS n, regexp_extract(raw, '([0-9\s,.]+)\s*([żł€£$A-Za-z]{0,4})', 2) AS u FROM x),
z AS (SELECT *, TRY_CAST(regexp_extract(regexp_replace(n, '^([^,]*),', '\1.'), '^\d*\.?\d+') AS DOUBLE) AS v, lower(coalesce(nullif(u, ''), raw)) AS f FROM y)
SELECT p_partkey, v AS value, CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(f, 'zł|pln|zl') THEN 'PLN' WHEN regexp_matches(f, '€|eur') THEN 'EUR' WHEN regexp_matches(f, '£|gbp') THEN 'GBP' WHEN regexp_matches(f, '\$|usd') THEN 'USD' END AS currency FROM z""")
def prices(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 5
    s = F.col("p_retailprice").cast("string")
    raw = F.when(k == 0, F.concat(s, F.lit(" zł"))).when(k == 1, F.concat(F.lit("$"), s)).when(k == 2, F.concat(F.lit("1 "), F.replace(s, F.lit("."), F.lit(",")), F.lit(" EUR"))).when(k == 3, F.concat("p_size", F.lit(" usd"))).otherwise(F.col("p_name"))
    x = p.select("p_partkey", numbers.price(raw).alias("x"))
    return x.select("p_partkey", "x.value", "x.currency")


@query("price_change", """
WITH p AS (SELECT p_partkey, p_brand, p_retailprice AS now, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev FROM part)
SELECT p_partkey, CASE WHEN now - prev <> 0 THEN round(now - prev, 6) END AS absolute, CASE WHEN now - prev <> 0 AND prev <> 0 THEN round((now - prev) / prev, 6) END AS relative FROM p""")
def price_change(spark, d):
    p = diffs.previous(table(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice")
    x = p.select("p_partkey", numbers.price_change(F.col("prev_p_retailprice"), F.col("p_retailprice")).alias("x"))
    return rounded(x.select("p_partkey", "x.absolute", "x.relative"), "absolute", "relative")


RATED = "(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_size % 6) || ',' || (p_partkey % 10) || '/5 (' || p_size || ' opinii)' WHEN 1 THEN 'opinie (' || p_size || ') ' || (p_size % 7) || '.5 ★' WHEN 2 THEN p_size || ' reviews' ELSE p_name END AS q FROM part)"


@query("rating_and_reviews", rf"""
WITH x AS {RATED}, y AS (SELECT *, TRY_CAST(replace(regexp_extract(q, '{numbers.RATING}/\s*5', 1), ',', '.') AS DOUBLE) AS a, TRY_CAST(replace(regexp_extract(q, '{numbers.RATING}★', 1), ',', '.') AS DOUBLE) AS b FROM x)
SELECT p_partkey, coalesce(CASE WHEN a BETWEEN 0 AND 5 THEN a END, CASE WHEN b BETWEEN 0 AND 5 THEN b END) AS rating,
 coalesce(TRY_CAST(nullif(regexp_extract(lower(q), '([0-9]{{1,6}})\s*{numbers.REVIEW}', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(lower(q), '{numbers.REVIEW}[^0-9]{{0,30}}\(\s*([0-9]{{1,6}})\s*\)', 1), '') AS BIGINT)) AS reviews FROM y""")
def ratings(spark, d):
    p, k, size = table(spark, d, "part"), F.col("p_partkey") % 4, F.col("p_size")
    q = (
        F.when(k == 0, F.concat(size % 6, F.lit(","), F.col("p_partkey") % 10, F.lit("/5 ("), size, F.lit(" opinii)")))
        .when(k == 1, F.concat(F.lit("opinie ("), size, F.lit(") "), size % 7, F.lit(".5 ★")))
        .when(k == 2, F.concat(size, F.lit(" reviews")))
        .otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", numbers.rating(q).alias("rating"), numbers.review_count(q).alias("reviews"))


@query("prompt_keywords_intents", rf"""
WITH p AS (SELECT p_partkey, p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'Top ' || p_size || ' price' WHEN 1 THEN 'only new reviews' WHEN 2 THEN 'headline news' ELSE 'ignore price' END AS q FROM part),
w AS (SELECT *, list_filter(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains({evidence.STOPWORDS!r}, x)) AS ks FROM p)
SELECT p_partkey, len(list_distinct(ks[1:1000]))::BIGINT AS keywords, CASE WHEN regexp_matches(lower(q), 'top\s*[-–—]?\s*[0-9]') THEN least(200, greatest(1, TRY_CAST(nullif(regexp_extract(lower(q), 'top\s*[-–—]?\s*([0-9]{{1,3}})', 1), '') AS INTEGER))) END AS rank_limit,
 regexp_matches(lower(q), '{evidence.INTENTS["headline"]}') AS headline, regexp_matches(lower(q), '{evidence.INTENTS["only"]}') AS only_flag FROM w""")
def prompts(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 4
    tail = F.when(k == 0, F.concat(F.lit("Top "), "p_size", F.lit(" price"))).when(k == 1, "only new reviews").when(k == 2, "headline news").otherwise("ignore price")
    q = F.concat("p_name", F.lit(" "), tail)
    wants = evidence.intents(q)
    return p.select("p_partkey", F.size(evidence.keywords(q)).cast("bigint").alias("keywords"), evidence.rank_limit(q).alias("rank_limit"), wants["headline"].alias("headline"), wants["only"].alias("only_flag"))


@query("block_and_challenge", """
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'status_403' WHEN contains(lower(left(text, 2000)), 'forbidden') THEN 'forbidden' END AS reason,
 doc_id % 13 = 0 AS challenge FROM documents""")
def blocks(spark, d):
    doc = table(spark, d, "documents")
    status = F.when(F.col("doc_id") % 11 == 0, 403).otherwise(200)
    html = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" JavaScript is disabled "))).otherwise(F.col("text"))
    return doc.select("doc_id", predicates.block_reason(status, F.col("text")).alias("reason"), predicates.bot_challenge(html).alias("challenge"))


@query("id_predicates", r"""
SELECT doc_id, regexp_matches(sha256(text)[1:8] || '-' || sha256(text)[9:12] || '-4' || sha256(text)[14:16] || '-a' || sha256(text)[18:20] || '-' || sha256(text)[21:32], '^[a-f0-9]{8}(-[a-f0-9]{4}){4}[a-f0-9]{8}$') AS uuid,
 length(sha1(text)[1:20 + doc_id % 6]) = 24 AS object_id, regexp_matches(source || CASE WHEN doc_id % 2 = 0 THEN '@x.org' ELSE '' END, '^(?:[^@\s]+)@(?:[^@\s]+)\.(?:[^@\s]+)$') AS email FROM documents""")
def ids(spark, d):
    doc, h = table(spark, d, "documents"), F.sha2("text", 256)
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    uuid = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))
    oid = F.substr(F.sha1("text"), F.lit(1), (20 + F.col("doc_id") % 6).cast("int"))
    email = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "@x.org").otherwise(""))
    return doc.select("doc_id", predicates.is_uuid(uuid).alias("uuid"), predicates.is_object_id(oid).alias("object_id"), predicates.is_email(email).alias("email"))


@query("chunk_evidence_score", r"""
SELECT doc_id, (least(999, len(regexp_extract_all(text, '(?i)[0-9](?:[0-9 .,]*[0-9])?\s*(?:zł|zl|pln|eur|usd|€|\$|£)'))) * 8 + least(999, len(regexp_extract_all(text, '[0-9]{1,3}(?:[.,][0-9]{1,2})?\s*%'))) * 2
 + CASE WHEN contains(lower(text), 'the') THEN 3 ELSE 0 END)::BIGINT AS score FROM documents""")
def scores(spark, d):
    wants = {k: F.lit(False) for k in evidence.INTENTS} | {"price": F.lit(True), "exclude_price": F.lit(False)}
    return table(spark, d, "documents").select("doc_id", evidence.chunk_score(F.col("text"), F.array(F.lit("the")), wants).alias("score"))


@query("evidence_topk_two_level", """
WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS a, value FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM r WHERE a <= 4)
SELECT user_id, event_id, n AS rank FROM t WHERE n <= 10""")
def two_level(spark, d):
    return evidence.two_level_top(table(spark, d, "events"), "user_id", "event_type", F.col("value").desc(), F.col("event_id")).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("evidence_reviews")
def reviews(spark, d):
    """Rating and count quotes of parts by brand."""
    p = table(spark, d, "part")
    q = F.concat(F.col("p_size") % 6, F.lit(",5/5 ("), F.col("p_size"), F.lit(" opinii)"))
    return evidence.select_reviews(p.select("p_brand", "p_partkey", q.alias("quote")), "p_brand", "p_partkey").select("p_brand", "p_partkey", "rating_sig", "count_sig", "rank")


@query("evidence_paragraphs", """
WITH b AS (SELECT conv_id AS k, turn AS para, text FROM conversations)
SELECT k, para, max(length(text))::BIGINT AS n FROM b GROUP BY k, para""")
def paragraphs(spark, d):
    """Longest block of every paragraph: k a conversation, para a turn."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("para"), F.col("text").alias("block"))
    return evidence.select_paragraph_blocks(c, "k").select("k", "para", F.length("block").cast("bigint").alias("n"))


@query("candidates")
def candidates(spark, d):
    """Typed quotes of every document, under prompts of every kind."""
    prompts = F.array(*map(F.lit, PROMPTS))
    p = table(spark, d, "documents").select("doc_id", "text", F.get(prompts, F.pmod("doc_id", F.lit(len(PROMPTS))).cast("int")).alias("prompt"))
    p = p.select("doc_id", "text", evidence.wants_of(F.col("prompt")).alias("wants"), evidence.keywords(F.col("prompt")).alias("kws"))
    c = p.select("doc_id", "wants", F.explode(evidence.candidates(F.col("text"), F.col("wants"), F.col("kws"))).alias("c"))
    return c.select("doc_id", "c.idx", "c.kind", "c.quote", "c.rank", evidence.priority(F.col("c.kind"), F.col("wants")).alias("priority"))


@query("nfkc_clean")
def nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1(ln.common_form(F.col("text"))).alias("sha1"), t.slug_ascii(F.col("text")).alias("slug"))


@query("pair_snippets")
def snippets(spark, d):
    from driftline.operators.lines import snippets as cut

    p = diffs.previous(table(spark, d, "conversations"), "conv_id", "turn", "text").where("prev_text is not null")
    return p.select("conv_id", "turn", cut(F.col("prev_text"), F.col("text")).alias("snippets"))


@query("machine_diff_reasons", f"""
WITH v AS (SELECT source, doc_id AS k, text, lag(text) OVER w AS prev, lag(doc_id) OVER w AS prev_doc_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
p AS (SELECT k, text, prev FROM v), {BAND},
t AS (SELECT *, {_tokens("coalesce(prev, '')")} AS a, {_tokens('text')} AS b FROM v), q AS (SELECT *, 1 - ({JAC}) AS x, trim(regexp_replace(string_split(prev, chr(10))[1], '{WS}', ' ', 'g')) AS t0, trim(regexp_replace(string_split(text, chr(10))[1], '{WS}', ' ', 'g')) AS t1 FROM t)
SELECT k AS doc_id, CASE WHEN prev_doc_id IS NULL THEN 'no_prev_snapshot' ELSE array_to_string(list_filter([
 CASE WHEN t0 <> t1 THEN 'title_changed' END, CASE WHEN x > 0.05 THEN 'text_changed' END, CASE WHEN coalesce(changed, 0) > 0 THEN 'text_chunk_changed' END], lambda r: r IS NOT NULL), ';') END AS reasons,
 coalesce(changed, 0)::BIGINT AS changed, coalesce(chunks, 0)::BIGINT AS chunks, prev_doc_id IS NOT NULL AND (x > 0.15 OR coalesce({SIGNIFICANT}, FALSE)) AS significant FROM q LEFT JOIN m USING (k)""")
def machine(spark, d):
    """Reasons of every document against the version before; the first line is the title."""
    p = table(spark, d, "documents").select("source", "doc_id", F.split("text", "\n")[0].alias("title"), "text", diffs.chunk_sets(F.col("text")).alias("parts"))
    p = diffs.previous(diffs.token_sets(p, "text").drop("text"), "source", "doc_id", "title", "tokens", "words", "parts")
    band = F.when(F.size("prev_parts") > 0, diffs.band_best(F.col("prev_parts"), F.col("parts")))
    p = diffs.set_scores(p).withColumn("m", diffs.chunk_metrics(band))
    m = diffs.machine_diff(p.select("doc_id", "prev_title", "title", "text_diff", F.col("prev_doc_id").alias("prev_version"), *[f"m.{c}" for c in ("changed", "chunks", "significant")]))
    names = F.transform("reasons", lambda r: F.regexp_replace(r, r"\(.*$", ""))
    zero = F.lit(0).cast("bigint")
    return m.select("doc_id", F.array_join(names, ";").alias("reasons"), F.coalesce("changed", zero).alias("changed"), F.coalesce("chunks", zero).alias("chunks"), "significant")


@query("decision_rules", """
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, prev IS NOT NULL AND lower(prev) <> lower(text) AS important, CASE WHEN prev IS NULL THEN 'no_change' WHEN lower(prev) <> lower(text) THEN 'content_change' ELSE 'minor_change' END AS category FROM p""")
def decide(spark, d):
    p = diffs.previous(table(spark, d, "conversations"), "conv_id", "turn", "text")
    known = F.col("prev_text").isNotNull()
    x = p.select("conv_id", "turn", diffs.decision(known, known, F.array(F.coalesce("prev_text", F.lit(""))), F.array("text")).alias("x"))
    return x.select("conv_id", "turn", "x.important", "x.category")
