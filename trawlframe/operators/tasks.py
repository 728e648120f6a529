"""Task and result tables: look-ups, listings, transitions, reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlframe.functions.outcomes import is_success

# Task states, the scheduler's other name for success, and which
# action is allowed from which state.
STATUSES = ("pending", "running", "success", "failed", "cancelled")
STATUS_ALIASES = {"completed": "success"}
TRANSITIONS = {
    "start": (("pending",), "running"),
    "stop": (("running",), "cancelled"),
    "cancel": (("pending", "running"), "cancelled"),
}
RESPONSE_COLUMNS = ("task_id", "name", "description", "urls", "status", "progress", "total_count",
                    "success_count", "failed_count", "created_at", "updated_at", "started_at", "completed_at")


def canonical_status(status: Column) -> Column:
    for alias, name in STATUS_ALIASES.items():
        status = F.when(status == alias, name).otherwise(status)
    return status


def url_list(tasks: DataFrame) -> DataFrame:
    """One row per URL of a task, in list order."""
    return tasks.select("task_id", F.posexplode("urls").alias("pos", "url"))


def by_id(tasks: DataFrame, task_id) -> DataFrame:
    return tasks.where(F.col("task_id") == task_id)


def newest_first(tasks: DataFrame, status: str | None = None) -> DataFrame:
    kept = tasks if status is None else tasks.where(F.col("status") == status)
    return kept.orderBy(F.col("created_at").desc(), F.col("task_id"))


def page(tasks: DataFrame, limit: int = 100, offset: int = 0, status: str | None = None) -> DataFrame:
    """A slice of the listing with the total on every row. The total is a
    scalar subquery: a window over everything would run in one task."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset not negative")
    kept = tasks if status is None else tasks.where(F.col("status") == status)
    total = kept.agg(F.count(F.lit(1))).scalar()
    return newest_first(kept).offset(offset).limit(limit).withColumn("total", total)


def numbered_page(tasks: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    return page(tasks, limit=size, offset=(number - 1) * size)


def first_and_rest(tasks: DataFrame, shown: int = 20) -> DataFrame:
    """The listing's first rows, each with how many more there are."""
    listed = page(tasks, limit=shown)
    return listed.withColumn("more", F.greatest(F.col("total") - shown, F.lit(0))).drop("total")


def latest_results(results: DataFrame, task_id, limit: int = 100) -> DataFrame:
    return (results.where(F.col("task_id") == task_id)
            .orderBy(F.col("created_at").desc(), F.col("result_id")).limit(limit))


def latest_results_per_task(results: DataFrame, limit: int = 100) -> DataFrame:
    """Newest ``limit`` results of every task; each map task hands on at most
    ``limit`` rows of a task."""
    w = Window.partitionBy("task_id").orderBy(F.col("created_at").desc(), F.col("result_id"))
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def response(tasks: DataFrame) -> DataFrame:
    """The columns shown to a client; configuration stays inside."""
    return tasks.select(*[c for c in RESPONSE_COLUMNS if c in tasks.columns])


def apply_actions(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands(task_id, action)`` checked against the task's state: the new
    status, whether it was accepted, and the reason when not."""
    state = tasks.select("task_id", F.col("status").alias("_status"))
    joined = commands.join(state, "task_id", "left")
    allowed, target = F.lit(False), F.lit(None).cast("string")
    for action, (sources, result) in TRANSITIONS.items():
        hit = (F.col("action") == action) & F.col("_status").isin(*sources)
        allowed = allowed | F.coalesce(hit, F.lit(False))
        target = F.when(hit, result).otherwise(target)
    return joined.select(
        *commands.columns, F.col("_status").alias("old_status"),
        F.coalesce(target, F.col("_status")).alias("new_status"), allowed.alias("accepted"),
        F.when(F.col("_status").isNull(), "not_found").when(~allowed, "conflict").alias("error"))


def update_progress(tasks: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """``updates(task_id, progress)`` written over the stored progress."""
    fresh = updates.select("task_id", F.col("progress").alias("_p"))
    return (tasks.join(fresh, "task_id", "left")
            .withColumns({"progress": F.coalesce("_p", "progress"),
                          "updated_at": F.when(F.col("_p").isNotNull(), now).otherwise(F.col("updated_at"))})
            .drop("_p"))


def delete_tasks(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Tasks, or their results, without the deleted ones."""
    return rows.join(deleted.select("task_id").distinct(), "task_id", "left_anti")


def status_view(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks with their number of results; counted before joining, so a task
    with very many results joins as one row."""
    counts = results.groupBy("task_id").agg(F.count(F.lit(1)).alias("results_count"))
    columns = [c for c in ("task_id", "name", "status", "progress") if c in tasks.columns]
    return (tasks.select(*columns).join(counts, "task_id", "left")
            .withColumn("results_count", F.coalesce("results_count", F.lit(0).cast("long"))))


def task_progress(results: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Totals per task; progress against ``expected(task_id, total_count)``, or
    the share that succeeded where nothing is expected."""
    ok = is_success(F.col("status_code"))
    done = results.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("done_count"), F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failed_count"))
    if expected is None:
        return done.withColumn("progress", F.col("success_count") / F.col("done_count"))
    return (expected.select("task_id", "total_count").join(done, "task_id", "left")
            .na.fill(0, ["done_count", "success_count", "failed_count"])
            .withColumn("progress", F.coalesce(F.try_divide("done_count", "total_count"), F.lit(0.0))))


def status_distribution(tasks: DataFrame, now: Column, statuses: Iterable[str] = STATUSES) -> DataFrame:
    """``metric, value`` rows: a count per status (also zero), the total and the
    tasks of the last 24 hours, all in one pass."""
    names = list(statuses)
    row = tasks.agg(
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in names],
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")).alias("recent_24h_tasks"))
    return row.unpivot([], row.columns, "metric", "value")


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


def remaining(frontier: DataFrame, crawled: DataFrame, errors: DataFrame, key: str = "fp") -> DataFrame:
    """What is left after a stop: frontier rows not crawled, with the number of
    errors each has had."""
    counts = errors.groupBy(key).agg(F.count(F.lit(1)).alias("errors"))
    return (frontier.join(crawled.select(key).distinct(), key, "left_anti")
            .join(counts, key, "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("long"))))


def run_history(results: DataFrame, run: list[str]) -> DataFrame:
    """Per run: start, end, duration, success rate, and the metrics as JSON."""
    ok = is_success(F.col("status_code"))
    agg = results.groupBy(*run).agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"),
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("successes"))
    seconds = F.unix_seconds(F.col("ended_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return agg.withColumns({
        "duration_seconds": seconds, "success_rate": F.col("successes") / F.col("requests"),
        "metrics": F.to_json(F.struct("requests", "successes"))})


def schedule_listing(schedule: DataFrame) -> DataFrame:
    """All schedule entries for display: times as ISO text, the configuration as JSON text, null where a run has not been or is not planned."""
    def iso(c: str) -> Column:
        # As ISO 8601 is usually written: a fraction only where there is one.
        at = F.col(c).cast("timestamp_ntz")
        whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(at, "SSSSSS") == "000000", whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias(c)

    return schedule.select("task_id", "name", "schedule_type", F.to_json("schedule_config").alias("schedule_config"), "status",
                           iso("created_at"), iso("last_run"), iso("next_run"))


def due(schedule: DataFrame, now: Column) -> DataFrame:
    """Schedule entries to run at ``now``, with the next run of interval ones."""
    kind = F.col("schedule_type")
    step = F.make_dt_interval(secs=F.col("interval_seconds"))
    first = F.col("last_run").isNull()
    ready = (F.when(kind == "one_time", F.coalesce(now >= F.col("next_run"), F.lit(False)))
             .when(kind == "interval", first | (now >= F.col("last_run") + step))
             .when(kind == "cron", first).otherwise(False))
    return (schedule.where((F.col("status") == "pending") & ready)
            .withColumn("next_run", F.when(kind == "interval", now + step).otherwise(F.col("next_run"))))
