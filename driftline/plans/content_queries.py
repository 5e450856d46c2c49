"""HTML queries over pages, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import predicates
from driftline.functions import text as t
from driftline.operators import html as h
from driftline.sources.tables import table

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def _strip(x: str) -> str:
    for tag in ("script", "style", "noscript", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"


@query("html_strip", f"SELECT page_id, sha1({_strip('html')}) AS text_sha1 FROM pages")
def strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha1(t.strip_tags(F.col("html"))).alias("text_sha1"))


@query("html_title_h1", f"""
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(trim({_strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}), '') AS h1,
 len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']*)["'']', 1))::BIGINT AS n_links FROM pages""")
def titles(spark, d):
    x = F.col("html")
    return table(spark, d, "pages").select("page_id", h.title(x).alias("title"), h.heading(x).alias("h1"), F.size(h.links(x)).cast("bigint").alias("n_links"))


@query("html_paragraph_blocks", r"""
WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?is)<p[^>]*>(.*?)</p>', 1) AS ps FROM pages),
l AS (SELECT page_id, list_filter(list_transform(ps, lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]+>', ' ', 'g'), '[ \n\t\r]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM b)
SELECT page_id, len(ps)::BIGINT AS n, sha1(array_to_string(ps[1:6], chr(10))) AS first_sha1 FROM l""")
def paragraphs(spark, d):
    p = table(spark, d, "pages").select("page_id", h.paragraphs(F.col("html")).alias("ps"))
    return p.select("page_id", F.size("ps").cast("bigint").alias("n"), F.sha1(F.array_join(F.slice("ps", 1, 6), "\n")).alias("first_sha1"))


@query("html_fallback_extract", r"""
WITH b AS (SELECT page_id, html, regexp_extract_all(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?is)<p[^>]*>(.*?)</p>', 1) AS ps FROM pages)
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, CASE WHEN len(ls) > 0 THEN 0.35 ELSE 0.2 END::DOUBLE AS confidence, sha1(array_to_string(ls, chr(10))) AS text_sha1
FROM (SELECT *, list_filter(list_transform(ps[1:6], lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]+>', ' ', 'g'), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM b)""")
def fallback(spark, d):
    x = table(spark, d, "pages").select("page_id", h.fallback_candidate(F.col("html")).alias("f"))
    return x.select("page_id", "f.title", "f.confidence", F.sha1("f.text").alias("text_sha1"))


@query("url_normalize", r"""
WITH b AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS u, regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS hd FROM pages)
SELECT page_id, CASE WHEN hd <> '' THEN lower(hd) || substr(u, length(hd) + 1) ELSE url END AS url FROM b""")
def urls(spark, d):
    return table(spark, d, "pages").select("page_id", h.url_norm(F.col("url")).alias("url"))


@query("content_type_infer", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'product' WHEN doc_id % 5 = 1 THEN 'article' WHEN regexp_matches(lower(text), 'produkt|cena') THEN 'product' WHEN regexp_matches(lower(text), 'autor|data publikacji') THEN 'article' ELSE 'page' END AS content_type FROM documents""")
def kinds(spark, d):
    k = F.when(F.col("doc_id") % 5 == 0, "Product").when(F.col("doc_id") % 5 == 1, "BlogPosting")
    return table(spark, d, "documents").select("doc_id", predicates.content_type(k, F.col("text")).alias("content_type"))


@query("extractor_choose")
def choose(spark, d):
    x = h.extract(table(spark, d, "pages"))
    return x.select("page_id", "extractor", "title", "content_type", F.round("confidence", 6).alias("confidence"), F.sha1("text").alias("text_sha1"), "block_reason")


@query("html_dom_text")
def dom(spark, d):
    x = table(spark, d, "pages").select("page_id", F.posexplode(h.dom_lines(F.col("html"))).alias("pos", "b"))
    return x.select("page_id", "pos", "b.kind", F.sha1("b.line").alias("line_sha1"))


@query("page_meta", f"""
SELECT page_id, length(trim(regexp_replace({_strip('html')}, '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')))::BIGINT AS text_length FROM pages""")
def meta(spark, d):
    return h.page_meta(table(spark, d, "pages")).select("page_id", "text_length")


@query("stream_status_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def stream_counts(spark, d):
    from driftline.streaming import jobs

    return jobs.status_counts(spark, f"{d}/events.parquet").select("event_type", "n", F.round("value", 4).alias("value"))


@query("stream_window_counts", "SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    from driftline.streaming import jobs

    return jobs.windowed_counts(spark, f"{d}/events.parquet")


@query("stream_dedupe_equiv", """
SELECT event_id FROM (SELECT event_id, event_type AS h, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE h IS DISTINCT FROM p""")
def stream_dedupe(spark, d):
    from driftline.streaming import jobs

    return jobs.changed_only(spark, f"{d}/events.parquet").select("event_id")
