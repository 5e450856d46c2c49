"""Tasks, monitors, notifications: scheduling, claiming, listing and statistics.

Column contracts
  monitors: id, user_id, name, url, prompt, interval_sec, active, scan_mode, created_at
  tasks:    id, monitor_id, status, planned_at, started_at, finished_at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT

ACTIVE = ("pending", "running")
TERMINAL = ("ok", "error", "cancelled")


def without_active(keys: DataFrame, tasks: DataFrame, key: str, active: tuple[str, ...] = ACTIVE) -> DataFrame:
    """Rows of ``keys`` that have no active task (NOT EXISTS)."""
    busy = tasks.where(F.col("status").isin(*active)).select(F.col("monitor_id").alias("__m"))
    return keys.join(busy, F.col(key) == F.col("__m"), "left_anti")


def last_planned(monitors: DataFrame, tasks: DataFrame) -> DataFrame:
    """Monitors with ``last_planned``: the latest plan, or else their creation."""
    latest = tasks.groupBy(F.col("monitor_id").alias("__m")).agg(F.max("planned_at").alias("__p"))
    j = monitors.join(latest, F.col("id") == F.col("__m"), "left")
    return j.withColumn("last_planned", F.coalesce("__p", "created_at")).drop("__m", "__p")


def due(monitors: DataFrame, tasks: DataFrame, now: Column, limit: int = DEFAULT.schedule_batch) -> DataFrame:
    """Active monitors whose interval has passed, without an active task, oldest first."""
    m = last_planned(without_active(monitors.where("active"), tasks, "id"), tasks)
    ready = m.where(F.col("last_planned") + F.make_dt_interval(secs=F.col("interval_sec")) <= now)
    return ready.orderBy("created_at", "id").limit(limit)


def claim(tasks: DataFrame, n: int, now: Column, monitor_id: Column | None = None, pending: str = "pending", taken: str = "running") -> DataFrame:
    """The oldest ``n`` pending tasks, as they are once taken."""
    waiting = tasks.where(F.col("status") == pending)
    if monitor_id is not None:
        waiting = waiting.where(F.col("monitor_id") == monitor_id)
    return waiting.orderBy("planned_at", "id").limit(n).withColumns({"status": F.lit(taken), "started_at": now})


def cancel(tasks: DataFrame, owned: DataFrame, now: Column, active: tuple[str, ...] = ACTIVE) -> DataFrame:
    """All tasks, the active ones of ``owned`` monitors cancelled (an update with a join)."""
    own = owned.select(F.col("id").alias("__m"), F.lit(True).alias("__own"))
    j = tasks.join(own, F.col("monitor_id") == F.col("__m"), "left")
    hit = F.coalesce("__own", F.lit(False)) & F.col("status").isin(*active)
    return j.withColumns({"finished_at": F.when(hit, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")), "status": F.when(hit, "cancelled").otherwise(F.col("status"))}).drop("__m", "__own")


def latest_status(events: DataFrame, key: str, status: str, ts: str, tie: str) -> DataFrame:
    """The state machine folded: each key's last status."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(ts, tie)).alias("status"), F.max(ts).alias("since"), F.count("*").alias("transitions"))


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def page(df: DataFrame, number: int, size: int = DEFAULT.page_size) -> DataFrame:
    """A page of an ordered result; sizes are held within 1 to 100."""
    size = max(1, min(DEFAULT.page_size_most, size))
    return df.offset((max(1, number) - 1) * size).limit(size)


def history(tasks: DataFrame, monitors: DataFrame, search: str | None = None, statuses: tuple[str, ...] = TERMINAL, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Ended tasks with their monitors, filtered; not ordered."""
    t = tasks.where(F.col("status").isin(*statuses) & F.col("finished_at").isNotNull())
    if start is not None:
        t = t.where(F.col("finished_at") >= start)
    if end is not None:
        t = t.where(F.col("finished_at") < end)
    m = monitors.select(F.col("id").alias("m_id"), F.col("name").alias("monitor_name"), F.col("url").alias("monitor_url"))
    j = t.join(m, F.col("monitor_id") == F.col("m_id")).drop("m_id")
    return j.where(F.col("monitor_name").ilike(f"%{search}%") | F.col("monitor_url").ilike(f"%{search}%")) if search else j


def outbox(notifications: DataFrame, users: DataFrame, detections: DataFrame, n: int = DEFAULT.notification_batch) -> DataFrame:
    """The oldest unsent notifications, with whom they go to and what they are about."""
    u = users.select(F.col("id").alias("__u"), F.col("email").alias("email"))
    d = detections.select(F.col("id").alias("__d"), F.col("title").alias("detection_title"), F.col("url").alias("detection_url"))
    j = notifications.where(F.col("status") == "pending").join(u, F.col("user_id") == F.col("__u")).join(d, F.col("detection_id") == F.col("__d"), "left")
    return j.orderBy("created_at", "id").limit(n).drop("__u", "__d")


def detections_and_notifications(decisions: DataFrame, monitors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the sink writes: a detection of each decision, a notification of the important ones with a known user."""
    text = F.coalesce(F.nullif(F.trim("short_description"), F.lit("")), F.nullif(F.trim("reason"), F.lit("")), F.lit("A change was detected"))
    detections = decisions.select("id", "monitor_id", "url", "title", "category", "important", "reason")
    m = monitors.select(F.col("id").alias("__m"), "user_id")
    notes = decisions.where("important").join(m, F.col("monitor_id") == F.col("__m")).where("user_id is not null")
    return detections, notes.select(F.col("id").alias("detection_id"), "monitor_id", "user_id", "title", text.alias("body"), F.lit("pending").alias("status"))


def mark_sent(notifications: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    s = sent.select(F.col("id").alias("__s"))
    j = notifications.join(s, F.col("id") == F.col("__s"), "left")
    hit = F.col("__s").isNotNull()
    return j.withColumns({"status": F.when(hit, "sent").otherwise(F.col("status")), "sent_at": F.when(hit, now).otherwise(F.col("sent_at"))}).drop("__s")


def upgrade_or_insert(existing: DataFrame, wanted: DataFrame, mode: str = "screenshot") -> DataFrame:
    """Plugin tasks after a request: the newest active one of a monitor gets the mode, else a new one is made.

    existing and wanted: monitor_id, url, mode, status, created_at.
    """
    w = Window.partitionBy("monitor_id").orderBy(F.col("created_at").desc())
    active = F.col("status").isin("pending", "in_progress")
    newest = existing.withColumn("__rn", F.when(active, F.row_number().over(w.partitionBy("monitor_id", active))))
    asked = wanted.select(F.col("monitor_id").alias("__m")).distinct()
    changed = newest.join(asked.withColumn("__ask", F.lit(True)), F.col("monitor_id") == F.col("__m"), "left")
    changed = changed.withColumn("mode", F.when(F.col("__ask") & (F.col("__rn") == 1), mode).otherwise(F.col("mode"))).drop("__rn", "__m", "__ask")
    made = wanted.join(existing.where(active).select(F.col("monitor_id").alias("__m")), F.col("monitor_id") == F.col("__m"), "left_anti")
    return changed.unionByName(made.select("monitor_id", "url", F.lit(mode).alias("mode"), F.lit("pending").alias("status"), "created_at"))


# --- monitors


def create_monitors(requests: DataFrame, now: Column, interval_sec: int = 3600) -> DataFrame:
    """New monitors of the requests that name a url, with defaults."""
    r = requests.where(F.nullif(F.trim("url"), F.lit("")).isNotNull() & F.nullif(F.trim("name"), F.lit("")).isNotNull())
    return r.withColumns({"interval_sec": F.coalesce("interval_sec", F.lit(interval_sec)), "active": F.coalesce("active", F.lit(True)), "created_at": now})


def patch_monitors(monitors: DataFrame, patches: DataFrame) -> DataFrame:
    """Monitors with the non-null fields of their patch."""
    fields = [c for c in patches.columns if c != "id"]
    p = patches.select(F.col("id").alias("__p"), *[F.col(c).alias(f"__{c}") for c in fields])
    j = monitors.join(p, F.col("id") == F.col("__p"), "left")
    return j.withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).select(*monitors.columns)


def delete_monitors(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows of deleted monitors (for the cascade, table by table)."""
    return table.join(gone.select(F.col("id").alias("__g")), F.col(key) == F.col("__g"), "left_anti")


def require_intervention(monitors: DataFrame, blocked: DataFrame) -> DataFrame:
    b = blocked.select(F.col("id").alias("__b"), F.lit(True).alias("__hit"))
    return monitors.join(b, F.col("id") == F.col("__b"), "left").withColumn("active", F.col("active") & F.col("__hit").isNull()).drop("__b", "__hit")


def set_baseline(monitors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Compare and set: the pointer changes only where it is still the one expected (null-safe).

    wanted: id, expected, analysis_id.
    """
    w = wanted.select(F.col("id").alias("__w"), F.col("expected").alias("__e"), F.col("analysis_id").alias("__a"))
    j = monitors.join(w, F.col("id") == F.col("__w"), "left")
    hit = F.col("__w").isNotNull() & F.col("last_good_analysis_id").eqNullSafe(F.col("__e"))
    return j.withColumn("last_good_analysis_id", F.when(hit, F.col("__a")).otherwise(F.col("last_good_analysis_id"))).drop("__w", "__e", "__a")


def monitor_meta(monitors: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("__u"), "full_name", "email")
    j = monitors.join(u, F.col("user_id") == F.col("__u"), "left")
    return j.select("id", "name", F.coalesce(F.nullif(F.trim("full_name"), F.lit("")), "email", F.lit("unknown")).alias("user_label"))


def details_text(*parts: Column) -> Column:
    """Structs one after the other as JSON lines."""
    return F.concat_ws("\n", *[F.to_json(p) for p in parts])


def two_step_lookup(tasks: DataFrame, docs: DataFrame, key: str = "task_id", fallback: str = "snapshot_id") -> DataFrame:
    """tasks with ``doc``: by task id, else by the id the task row names."""
    row = F.struct(*docs.columns)
    a = docs.select(F.col(key).alias("__k"), row.alias("__a"))
    b = docs.select(F.col("id").alias("__i"), row.alias("__b"))
    j = tasks.join(a, F.col("id") == F.col("__k"), "left").join(b, F.col(fallback) == F.col("__i"), "left")
    return j.withColumn("doc", F.coalesce("__a", "__b")).drop("__k", "__a", "__i", "__b")
