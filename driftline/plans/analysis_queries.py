"""Recognised text, analysis helpers and the change pipeline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import sets
from driftline.functions import text as t
from driftline.operators import analysis as an
from driftline.operators import diffs, evidence, ocr
from driftline.sources import sinks
from driftline.sources.tables import table

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("ocr_slices", """
WITH h AS (SELECT p_partkey, p_partkey % 9000 AS h FROM part), s AS (SELECT p_partkey, h, unnest(range(CAST(ceil(greatest(0, h - 1800) / 1580.0) AS INTEGER) + 1)) AS i FROM h)
SELECT p_partkey, greatest(0, least(i * 1580, h - 1800))::BIGINT AS top, least(greatest(0, least(i * 1580, h - 1800)) + 1800, h)::BIGINT AS bottom FROM s""")
def slices(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(ocr.slices(F.col("p_partkey") % 9000)).alias("s"))
    return p.select("p_partkey", "s.top", "s.bottom")


@query("ocr_lines", """
WITH t AS (SELECT o_custkey AS k, (l_linenumber * 97 + l_partkey % 60)::DOUBLE AS x, (l_orderkey % 400)::DOUBLE AS y, 20.0::DOUBLE AS w, (8 + l_suppkey % 10)::DOUBLE AS h, l_discount AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT *, quantile_cont(h, 0.5) OVER (PARTITION BY k) AS med FROM t),
j AS (SELECT *, CASE WHEN coalesce(y - lag(y) OVER (PARTITION BY k ORDER BY y, x) > greatest(10.0, 0.6 * med), TRUE) THEN 1 ELSE 0 END AS jump FROM m),
r AS (SELECT *, sum(jump) OVER (PARTITION BY k ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS row FROM j),
g AS (SELECT *, CASE WHEN coalesce(x - lag(x + w) OVER (PARTITION BY k, row ORDER BY x, y) > greatest(80.0, 3 * med), FALSE) THEN 1 ELSE 0 END AS gap FROM r),
p AS (SELECT *, sum(gap) OVER (PARTITION BY k, row ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT k, row::BIGINT AS row, part::BIGINT AS part, count(*) AS tokens, round(avg(score), 6) AS score FROM p GROUP BY ALL""")
def ocr_lines(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    x = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    tok = x.select("k", (F.col("l_linenumber") * 97 + F.col("l_partkey") % 60).cast("double").alias("x"), (F.col("l_orderkey") % 400).cast("double").alias("y"), F.lit(20.0).alias("w"), (8 + F.col("l_suppkey") % 10).cast("double").alias("h"), F.lit("t").alias("text"), F.col("l_discount").alias("score"))
    return ocr.lines(tok, "k").select("k", "row", "part", "tokens", F.round("score", 6).alias("score"))


@query("ocr_language_bounds", """
SELECT doc_id, CASE lang WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'es' ELSE 'en' END AS code, least(doc_id % 7, doc_id % 5) AS xmin, greatest(doc_id % 7, doc_id % 5) AS xmax FROM documents""")
def codes(spark, d):
    pt = lambda n: F.struct((F.col("doc_id") % n).alias("x"), F.lit(1).alias("y"))
    b = ocr.bounds(F.array(pt(7), pt(5)))
    return table(spark, d, "documents").select("doc_id", ocr.language(F.col("lang")).alias("code"), b["xmin"].alias("xmin"), b["xmax"].alias("xmax"))


@query("cache_left_anti", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 3 = 0 AND c.doc_id = d.doc_id AND sha1(c.text) = sha1(d.text))""")
def cache(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("snapshot_id"), F.sha1("text").alias("source_hash"))
    return ocr.not_cached(s, s.where("snapshot_id % 3 = 0")).select(F.col("snapshot_id").alias("doc_id"))


@query("chunk_source", r"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN 'dom_clean' WHEN doc_id % 3 = 0 THEN 'ocr_clean' WHEN trim(source) <> '' THEN 'dom_raw' END AS source,
 sha1(regexp_replace(CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN text WHEN doc_id % 3 = 0 THEN lang ELSE source END, '\s+$', '')) AS text_sha1 FROM documents""")
def source(spark, d):
    k = F.col("doc_id")
    s = an.chunk_source(F.when(k % 2 == 0, F.col("text")), F.when(k % 3 == 0, F.col("lang")).otherwise(" "), F.col("source"), F.lit(None).cast("string"))
    x = table(spark, d, "documents").select("doc_id", s.alias("s"))
    return x.select("doc_id", "s.source", F.sha1("s.text").alias("text_sha1"))


@query("template_reuse", """
SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size / 50.0 >= 0.6 THEN 'base' ELSE 'fresh' END AS template FROM part""")
def reuse(spark, d):
    base = F.when(F.col("p_size") % 3 > 0, F.lit("base"))
    return table(spark, d, "part").select("p_partkey", an.reuse_template(F.col("p_size") / 50.0, base, F.lit("fresh")).alias("template"))


@query("focus_discovery", """
WITH c AS (SELECT user_id, 'C_' || event_type || event_id % 3 AS id FROM events), f AS (SELECT DISTINCT user_id, 'c_' || event_type || '1' AS chunk_id FROM events WHERE user_id % 2 = 0)
SELECT c.user_id, count(*) AS chunks, count(f.chunk_id) AS focused, count(f.chunk_id) = 0 AS discovery FROM c LEFT JOIN f ON f.user_id = c.user_id AND lower(f.chunk_id) = lower(c.id) GROUP BY c.user_id""")
def focus(spark, d):
    e = table(spark, d, "events")
    c = e.select("user_id", F.concat(F.lit("C_"), "event_type", F.col("event_id") % 3).alias("id"))
    f = e.where("user_id % 2 = 0").select("user_id", F.concat("event_type", F.lit("1")).alias("chunk_id"))
    return an.focus(c, f, "user_id")


@query("derived_metrics", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 5 + 0.5)::DOUBLE END AS rating, CASE WHEN p_partkey % 3 = 0 THEN p_size::BIGINT END AS reviews FROM part""")
def metrics(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    qs = F.array(F.lit("none"), F.when(k % 2 == 0, F.concat(n % 5, F.lit(",5/5"))).otherwise("x"), F.when(k % 3 == 0, F.concat(n, F.lit(" opinii"))).otherwise("y"))
    x = table(spark, d, "part").select("p_partkey", an.derived_metrics(qs).alias("m"))
    return x.select("p_partkey", "m.rating", "m.reviews")


@query("quotes_to_ids", """
WITH p AS (SELECT user_id, event_id AS id, lower(event_type) AS q FROM events),
u AS (SELECT DISTINCT user_id, lower(event_type) AS q FROM events)
SELECT u.user_id, count(DISTINCT p.id) AS ids FROM u JOIN p ON p.user_id = u.user_id AND p.q = u.q GROUP BY u.user_id""")
def ids(spark, d):
    """Every event is evidence and every user's event types are used."""
    e = table(spark, d, "events")
    pool = e.select("user_id", F.col("event_id").alias("id"), F.concat(F.lit('"'), F.upper("event_type"), F.lit('"')).alias("quote"))
    used = e.groupBy("user_id").agg(F.collect_set("event_type").alias("quotes"))
    return evidence.quotes_to_ids(used, pool, "user_id").select("user_id", F.size("ids").cast("bigint").alias("ids"))


@query("evidence_new_items", """
WITH l AS (SELECT p_brand, p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part)
SELECT p_brand, least(60, count(DISTINCT k)) AS items FROM l GROUP BY p_brand""")
def new_items(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.concat(F.lit("- "), "p_name").alias("quote"))
    return evidence.select_new_items(p, "p_brand", "p_partkey").groupBy("p_brand").agg(F.count("*").alias("items"))


@query("evidence_news", """
WITH w AS (SELECT user_id, event_id % 10 AS chunk, sum(CASE WHEN event_type = 'view' THEN 0.6 ELSE 1.0 END) AS w FROM events GROUP BY ALL),
d AS (SELECT user_id, chunk FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(w, 3) DESC, chunk) AS n FROM w) WHERE n <= 2)
SELECT user_id, event_id FROM (SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY chunk, event_id) AS r FROM events e JOIN d ON d.user_id = e.user_id AND d.chunk = e.event_id % 10) WHERE r <= 8""")
def news(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 10).alias("chunk"), "event_id", F.when(F.col("event_type") == "view", "headline").otherwise("line").alias("kind"))
    return evidence.select_news(e, "user_id", "chunk", "event_id").select("user_id", "event_id")


@query("unique_chunk_keys", """
WITH s AS (SELECT user_id, event_id, event_type AS slug, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT user_id, event_id, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS chunk_key FROM s""")
def keys(spark, d):
    from driftline.operators.lines import unique_keys

    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("title"))
    return unique_keys(e, "user_id", "event_id").select("user_id", "event_id", "chunk_key")


@query("last_n_export", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_n(spark, d):
    return sinks.last_n(table(spark, d, "events"), 50, "ts", "event_id").select("event_id")


@query("details_text", """
SELECT n_nationkey, '{"name":"' || n_name || '"}' || chr(10) || '{"region":' || n_regionkey || '}' AS details FROM nation""")
def details(spark, d):
    from driftline.operators.workflow import details_text

    return table(spark, d, "nation").select("n_nationkey", details_text(F.struct(F.col("n_name").alias("name")), F.struct(F.col("n_regionkey").alias("region"))).alias("details"))


@query("key_value_map", """
WITH e AS (SELECT user_id, event_type AS k, arg_max(coalesce(nullif(trim(CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_id::VARCHAR END), ''), 'unknown'), event_id) AS v FROM events GROUP BY ALL)
SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS kv FROM e GROUP BY user_id""")
def kv(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("event_id").cast("string"))
    g = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit(" "), "event_type").alias("key"), v.alias("value")))).alias("es"))
    m = g.select("user_id", F.map_entries(sets.key_values(F.transform("es", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.array_sort("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kv"))


@query("change_pipeline")
def pipeline(spark, d):
    """Decisions over documents: a source is a monitor, a document a version."""
    s = table(spark, d, "documents").select(F.col("source").alias("monitor_id"), F.col("doc_id").alias("version"), t.excerpt(F.col("text"), 40).alias("title"), "text")
    x = an.change_pipeline(s)
    return x.select("monitor_id", "version", "prev_version", F.size("reasons").alias("reasons"), "significant", "important", "category", "metrics.rating", "metrics.reviews")


@query("template_diff_metrics")
def template_diff(spark, d):
    """Chunk changes of every conversation between its first and second half of turns.

    A turn's chunk id is its place in its half; a middle turn is in the second.
    """
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    half = F.floor(F.count("*").over(Window.partitionBy("conv_id")) / 2)
    v = c.withColumns({"n": n, "half": half})
    v = v.select("conv_id", (F.col("n") >= F.col("half")).alias("later"), F.when(F.col("n") < F.col("half"), F.col("n")).otherwise(F.col("n") - F.col("half")).alias("id"), "text")
    j = diffs.chunk_full_outer(v.where("not later"), v.where("later"), ["conv_id", "id"])
    return diffs.template_diff_metrics(j, "conv_id")


@query("json_lenient", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def lenient(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), "props", F.lit(" .")))
    return table(spark, d, "events").select("event_id", F.try_variant_get(t.json_lenient(raw), "$.k", "bigint").alias("k"))


@query("judge_answer", """
SELECT event_id, event_id % 2 = 0 AS important, event_type AS category FROM events""")
def judge(spark, d):
    raw = F.concat(F.lit('Answer: {"important":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(',"category":"'), "event_type", F.lit('"}'))
    x = table(spark, d, "events").select("event_id", t.parse_decision(raw).alias("x"))
    return x.select("event_id", "x.important", "x.category")


@query("numbers_and_times", """
SELECT event_id, replace(replace(value::VARCHAR, ' ', ''), '.', '') AS token, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, ts + INTERVAL 60 MINUTE > TIMESTAMP '2024-01-15' AND event_id % 2 = 0 AS valid FROM events""")
def times(spark, d):
    from driftline.functions import numbers

    e = table(spark, d, "events")
    used = F.when(F.col("event_id") % 2 == 1, F.col("ts"))
    valid = numbers.still_valid(F.col("ts") + F.expr("interval 60 minutes"), used, F.lit("2024-01-15").cast("timestamp_ntz"))
    return e.select("event_id", numbers.token_norm(F.col("value").cast("string")).alias("token"), numbers.iso(F.col("ts").cast("string")).alias("iso"), valid.alias("valid"))


@query("clean_lines_ocr")
def clean_ocr(spark, d):
    from driftline.operators.lines import clean_ocr as run

    return run(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.sha1("line").alias("line_sha1"))


@query("render_marked", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM l)
SELECT doc_id, sha1(string_agg(CASE WHEN i % 3 = 0 THEN '[P' || lpad((i // 3 + 1)::VARCHAR, greatest(3, length((i // 3 + 1)::VARCHAR))::INTEGER, '0') || '] ' ELSE '' END || line, chr(10) ORDER BY i)) AS text_sha1 FROM x GROUP BY doc_id""")
def marked(spark, d):
    ls = F.split("text", "\n")
    paras = F.transform(ls, lambda x, i: (F.floor(i / 3) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.sha1(t.render_marked(ls, paras)).alias("text_sha1"))


@query("html_visible_walk")
def walk(spark, d):
    from driftline.operators import html

    p = table(spark, d, "pages")
    return p.select("page_id", F.sha1(html.walker(F.col("html"))).alias("text_sha1"), F.size(html.images(F.col("html"))).alias("images"), html.meta_price(F.col("html")).alias("price"), F.length(html.plain_text(F.col("html"))).alias("plain"))


@query("extract_or_blocked")
def extracted(spark, d):
    from driftline.operators import html

    x = html.extract_any(table(spark, d, "pages"), F.when(F.col("page_id") % 10 == 0, 403).otherwise(200))
    return x.select("page_id", "extractor", "block_reason", F.size("clean_lines").alias("lines"))


@query("evidence_extract")
def evidence_extract(spark, d):
    """Evidence of conversations under prompts of every kind."""
    c = table(spark, d, "conversations")
    chunks = c.select("conv_id", F.col("turn").cast("int").alias("chunk"), F.concat(F.lit("[P001] "), "text", F.lit("\n- #1 first\n- #2 second\n4,5/5 (12 opinii) 10 zł")).alias("text"))
    k = F.col("conv_id") % 4
    prompts = c.select("conv_id").distinct().select("conv_id", F.when(k == 0, "paragraph 1").when(k == 1, "top 1 ranking").when(k == 2, "reviews only").otherwise("price changes").alias("prompt"))
    return evidence.extract(chunks, prompts, "conv_id")


@query("split_and_wrap")
def wrap(spark, d):
    from driftline.operators import lines as ln

    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(ln.soft_lines(x)).alias("soft"), F.size(ln.wrap_single(F.replace(x, F.lit("\n"), F.lit(" ")))).alias("wrapped"), F.size(ln.cut_long_lines(F.split("text", "\n"))).alias("cut"), F.length(ln.without_json_blobs(F.col("text"))).alias("chars"), F.size(ln.candidate_lines(x)).alias("candidates"), F.length(ln.sanitised(x)).alias("raw"))
