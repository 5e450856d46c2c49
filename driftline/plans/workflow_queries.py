"""Relational queries: scheduling, listing, statistics, notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import workflow as w
from driftline.sources.tables import MONITORS, TASKS, monitors, table, tasks

def now():
    return F.lit("1998-06-01").cast("timestamp_ntz")

SQL_NOW = "TIMESTAMP '1998-06-01'"
Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("task_due_schedule", f"""
SELECT m.id, m.name FROM {MONITORS} m
LEFT JOIN (SELECT monitor_id, max(planned_at) AS p FROM {TASKS} GROUP BY 1) t ON t.monitor_id = m.id
WHERE m.active AND NOT EXISTS (SELECT 1 FROM {TASKS} busy WHERE m.id = busy.monitor_id AND busy.status IN ('pending', 'running'))
 AND coalesce(t.p, m.created_at) + to_seconds(m.interval_sec) <= {SQL_NOW}
ORDER BY m.created_at, m.id LIMIT 200""")
def due(spark, d):
    return w.due(monitors(spark, d), tasks(spark, d), now()).select("id", "name")


@query("tasks_without_active", f"""
SELECT id FROM {MONITORS} m WHERE NOT EXISTS (SELECT 1 FROM {TASKS} busy WHERE m.id = busy.monitor_id AND busy.status IN ('pending', 'running'))""")
def without_active(spark, d):
    return w.without_active(monitors(spark, d), tasks(spark, d), "id").select("id")


@query("claim_oldest_tasks", f"""
SELECT id, monitor_id, 'running' AS status FROM {TASKS} WHERE status = 'pending' ORDER BY planned_at, id LIMIT 200""")
def claim(spark, d):
    return w.claim(tasks(spark, d), 200, now()).select("id", "monitor_id", "status")


@query("tasks_by_status", f"""
SELECT coalesce(status, 'all') AS status, count(*) AS tasks FROM {TASKS} GROUP BY ROLLUP (status)""")
def by_status(spark, d):
    return tasks(spark, d).rollup("status").agg(F.count("*").alias("tasks")).select(F.coalesce("status", F.lit("all")).alias("status"), "tasks")


@query("tasks_in_progress_topk", f"""
SELECT id, monitor_id FROM {TASKS} WHERE status = 'running' ORDER BY started_at, id LIMIT 200""")
def in_progress(spark, d):
    return tasks(spark, d).where("status = 'running'").orderBy("started_at", "id").limit(200).select("id", "monitor_id")


@query("max_planned_fallback", f"""
SELECT m.id, CAST(epoch(coalesce(max(t.planned_at), any_value(m.created_at))) AS BIGINT) AS planned
FROM {MONITORS} m LEFT JOIN {TASKS} t ON t.monitor_id = m.id GROUP BY m.id""")
def max_planned(spark, d):
    return w.last_planned(monitors(spark, d), tasks(spark, d)).select("id", F.unix_seconds(F.col("last_planned").cast("timestamp")).alias("planned"))


@query("history_page", f"""
SELECT t.id, m.name AS monitor_name, CAST(round(epoch_us(t.finished_at) / 1e6 - epoch_us(t.started_at) / 1e6) AS BIGINT) AS seconds
FROM {TASKS} t JOIN {MONITORS} m ON m.id = t.monitor_id
WHERE t.status IN ('ok', 'error', 'cancelled') AND t.finished_at IS NOT NULL AND m.url ILIKE '%build%'
ORDER BY t.finished_at DESC, t.id LIMIT 20 OFFSET 20""")
def history_page(spark, d):
    from driftline.functions.numbers import duration_rounded

    h = w.history(tasks(spark, d), monitors(spark, d), search="build")
    return w.page(h.orderBy(F.col("finished_at").desc(), "id"), 2).select("id", "monitor_name", duration_rounded(F.col("started_at"), F.col("finished_at")).alias("seconds"))


@query("history_count", f"""
SELECT count(*) AS total, CAST(sum(greatest(0, floor((epoch_us(t.finished_at) - epoch_us(t.started_at)) / 1e6))) AS BIGINT) AS floored
FROM {TASKS} t JOIN {MONITORS} m ON m.id = t.monitor_id WHERE t.status = 'ok' AND t.finished_at >= TIMESTAMP '1995-01-01'""")
def history_count(spark, d):
    from driftline.functions.numbers import duration_floored

    h = w.history(tasks(spark, d), monitors(spark, d), start=F.lit("1995-01-01").cast("timestamp_ntz"))
    return h.agg(F.count("*").alias("total"), F.sum(duration_floored(F.col("started_at"), F.col("finished_at"))).alias("floored"))


@query("monitor_list_page", f"""
SELECT id, name, CASE WHEN active THEN 'active' ELSE 'paused' END AS state, count(*) OVER () AS total FROM {MONITORS}
WHERE user_id = 7 AND (name ILIKE '%customer%' OR url ILIKE '%customer%') ORDER BY created_at DESC, id LIMIT 20""")
def monitor_list(spark, d):
    m = monitors(spark, d).where((F.col("user_id") == 7) & (F.col("name").ilike("%customer%") | F.col("url").ilike("%customer%")))
    total = m.groupBy().agg(F.count("*").alias("total"))
    return w.page(m.orderBy(F.col("created_at").desc(), "id"), 1).select("id", "name", F.when(F.col("active"), "active").otherwise("paused").alias("state")).crossJoin(total)


@query("task_owner_access", f"""
SELECT t.id, n.n_name AS owner FROM {TASKS} t JOIN {MONITORS} m ON m.id = t.monitor_id JOIN nation n ON n.n_nationkey = m.user_id WHERE m.user_id = 3""")
def access(spark, d):
    m = monitors(spark, d).where("user_id = 3")
    return tasks(spark, d).join(m.select(F.col("id").alias("m_id"), "user_id"), F.col("monitor_id") == F.col("m_id")).join(table(spark, d, "nation"), F.col("user_id") == F.col("n_nationkey")).select("id", F.col("n_name").alias("owner"))


@query("owner_semi_join", f"""
SELECT t.id FROM {TASKS} t WHERE EXISTS (SELECT 1 FROM {MONITORS} m WHERE m.id = t.monitor_id AND m.user_id < 5)""")
def semi(spark, d):
    m = monitors(spark, d).where("user_id < 5").select(F.col("id").alias("m_id"))
    return tasks(spark, d).join(m, F.col("monitor_id") == F.col("m_id"), "left_semi").select("id")


@query("cancel_owned_tasks", f"""
SELECT t.id, CASE WHEN m.id IS NOT NULL AND t.status IN ('pending', 'running') THEN 'cancelled' ELSE t.status END AS status,
 epoch_us(CASE WHEN m.id IS NOT NULL AND t.status IN ('pending', 'running') THEN coalesce(t.finished_at, {SQL_NOW}) ELSE t.finished_at END) // 1000000 AS finished
FROM {TASKS} t LEFT JOIN (SELECT id FROM {MONITORS} WHERE user_id = 3) m ON m.id = t.monitor_id""")
def cancel(spark, d):
    t = w.cancel(tasks(spark, d), monitors(spark, d).where("user_id = 3"), now())
    return t.select("id", "status", F.unix_seconds(F.col("finished_at").cast("timestamp")).alias("finished"))


@query("linked_counts", f"""
SELECT m.user_id, count(t.finished_at) AS linked, count(DISTINCT m.id) AS monitors, count(t.id) AS tasks
FROM {MONITORS} m LEFT JOIN {TASKS} t ON t.monitor_id = m.id GROUP BY m.user_id""")
def linked(spark, d):
    t = tasks(spark, d).select(F.col("id").alias("t_id"), "monitor_id", "finished_at").groupBy("monitor_id").agg(F.count("finished_at").alias("linked"), F.count("*").alias("tasks"))
    j = monitors(spark, d).join(t, F.col("id") == F.col("monitor_id"), "left")  # counted before the join, so that it is one row a monitor
    return j.groupBy("user_id").agg(F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"), F.count("*").alias("monitors"), F.coalesce(F.sum("tasks"), F.lit(0)).alias("tasks"))


@query("notification_outbox", f"""
SELECT o.o_orderkey AS id, c.c_name AS email, l.l_returnflag AS detection_title FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus = 'O' ORDER BY o.o_orderdate, o.o_orderkey LIMIT 20""")
def outbox(spark, d):
    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("detection_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("sent").alias("status"), F.col("o_orderdate").alias("created_at"))
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    det = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("url"))
    return w.outbox(n, u, det).select("id", "email", "detection_title")


@query("status_state_machine", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS transitions FROM events GROUP BY user_id""")
def state(spark, d):
    return w.latest_status(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "status", "transitions")


@query("latest_per_key", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1""")
def latest(spark, d):
    return w.latest_per_key(table(spark, d, "events"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "event_id")


@query("sha1_dedupe_consecutive", """
SELECT event_id FROM (SELECT event_id, sha1(event_type) AS h, lag(sha1(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE h IS DISTINCT FROM p""")
def consecutive(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("h", F.sha1("event_type"))
    return e.withColumn("p", F.lag("h").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("not (h <=> p)").select("event_id")


@query("detections_and_notifications", """
SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS detection_id, o_custkey AS user_id,
 coalesce(nullif(trim(CASE WHEN l_linenumber = 1 THEN l_returnflag ELSE ' ' END), ''), 'reason ' || l_linestatus) AS body, 'pending' AS status
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount >= 0.05""")
def notifications(spark, d):
    dec = table(spark, d, "lineitem").select(
        (F.col("l_orderkey").cast("bigint") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("monitor_id"), F.lit("u").alias("url"), F.col("l_returnflag").alias("title"), F.lit("c").alias("category"),
        (F.col("l_discount") >= 0.05).alias("important"), F.concat(F.lit("reason "), "l_linestatus").alias("reason"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).otherwise(" ").alias("short_description"),
    )
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    return w.detections_and_notifications(dec, m)[1].select("detection_id", "user_id", "body", "status")


@query("mark_sent", f"""
SELECT t.id, CASE WHEN t.id % 7 = 0 THEN 'sent' ELSE t.status END AS status FROM {TASKS} t""")
def mark_sent(spark, d):
    t = tasks(spark, d).select("id", "status", F.col("finished_at").alias("sent_at"))
    return w.mark_sent(t, t.where("id % 7 = 0").select("id"), now()).select("id", "status")


@query("monitor_patch", f"""
SELECT id, CASE WHEN id % 5 = 0 THEN 'patched' ELSE name END AS name, CASE WHEN id % 5 = 0 THEN 60 ELSE interval_sec END AS interval_sec FROM {MONITORS}""")
def patch(spark, d):
    m = monitors(spark, d)
    p = m.where("id % 5 = 0").select("id", F.lit("patched").alias("name"), F.lit(60).alias("interval_sec"), F.lit(None).cast("boolean").alias("active"))
    return w.patch_monitors(m, p).select("id", "name", "interval_sec")


@query("monitor_delete_cascade", f"""
SELECT id FROM {TASKS} WHERE monitor_id NOT IN (SELECT id FROM {MONITORS} WHERE user_id = 1)""")
def cascade(spark, d):
    return w.delete_monitors(tasks(spark, d), monitors(spark, d).where("user_id = 1"), "monitor_id").select("id")


@query("baseline_compare_and_set", f"""
SELECT id, CASE WHEN id % 3 = 0 AND (CASE WHEN id % 2 = 0 THEN id END) IS NOT DISTINCT FROM (CASE WHEN id % 4 = 0 THEN id END) THEN -1 ELSE CASE WHEN id % 2 = 0 THEN id END END AS baseline FROM {MONITORS}""")
def baseline(spark, d):
    m = monitors(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("last_good_analysis_id"))
    want = m.where("id % 3 = 0").select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("expected"), F.lit(-1).cast("bigint").alias("analysis_id"))
    return w.set_baseline(m, want).select("id", F.col("last_good_analysis_id").alias("baseline"))


@query("monitor_meta", """
SELECT c_custkey AS id, c_name AS name, coalesce(nullif(trim(CASE WHEN n_nationkey % 2 = 0 THEN n_name END), ''), 'mail' || n_nationkey, 'unknown') AS user_label
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def meta(spark, d):
    u = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("full_name"), F.concat(F.lit("mail"), "n_nationkey").alias("email"))
    return w.monitor_meta(monitors(spark, d), u)


@query("two_step_lookup", """
SELECT o_orderkey AS id, coalesce(a.p_partkey, b.p_partkey) AS part FROM orders
LEFT JOIN part a ON a.p_size = 1 AND a.p_partkey = o_orderkey LEFT JOIN part b ON b.p_partkey = o_custkey""")
def lookup(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 1, F.col("p_partkey")).alias("task_id"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("snapshot_id"))
    return w.two_step_lookup(t, docs).select("id", F.col("doc.id").alias("part"))


@query("create_monitors", """
SELECT s_suppkey AS id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 60 END, 3600) AS interval_sec, TRUE AS active FROM supplier WHERE s_suppkey % 3 <> 0""")
def create(spark, d):
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise("https://x").alias("url"), F.when(F.col("s_suppkey") % 2 == 0, 60).alias("interval_sec"), F.lit(None).cast("boolean").alias("active"))
    return w.create_monitors(r, now()).select("id", "interval_sec", "active")


@query("plugin_upgrade_or_insert", """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'pending' ELSE 'done' END AS status FROM events WHERE user_id % 2 = 0),
 n AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY ts DESC) AS rn FROM e)
SELECT user_id AS monitor_id, CASE WHEN status = 'pending' AND rn = 1 AND user_id % 3 = 0 THEN 'screenshot' ELSE 'static' END AS mode, status, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT user_id, 'screenshot', 'pending', 1 FROM n WHERE user_id NOT IN (SELECT user_id FROM e WHERE status = 'pending')""")
def upgrade(spark, d):
    e = table(spark, d, "events")
    have = e.where("user_id % 2 = 0").select(F.col("user_id").alias("monitor_id"), F.lit("u").alias("url"), F.lit("static").alias("mode"), F.when(F.col("event_type").isin("view", "click"), "pending").otherwise("done").alias("status"), F.col("ts").alias("created_at"))
    want = e.where("user_id % 3 = 0").groupBy(F.col("user_id").alias("monitor_id")).agg(F.max("ts").alias("created_at")).withColumn("url", F.lit("u"))
    return w.upgrade_or_insert(have, want).groupBy("monitor_id", "mode", "status").agg(F.count("*").alias("n"))


@query("json_props_extract", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def props(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
