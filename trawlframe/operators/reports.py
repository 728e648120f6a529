"""Management reports: storage, retention, logs, exports, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days files are kept.
KEEP_DAYS = {"files": 30, "exports": 7, "cookies": 7, "proxies": 30}


def megabytes(size: Column) -> Column:
    return F.round(size / (1024 * 1024), 2)


def storage_stats(files: DataFrame) -> DataFrame:
    """``files(category, path, length, modified)`` -> per category and overall
    (category null): number, bytes, MB."""
    per_category = files.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"))
    return per_category.rollup("category").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_size"),
        megabytes(F.coalesce(F.sum("b"), F.lit(0))).alias("total_size_mb"))


def newest_files(files: DataFrame, n: int = 10) -> DataFrame:
    return files.orderBy(F.col("modified").desc(), F.col("path")).limit(n)


def with_expiry(rows: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """Marks rows older than ``days``."""
    return rows.withColumn("expired", F.col(ts) < now - F.make_dt_interval(days=F.lit(days)))


def retention_report(rows: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    marked = with_expiry(rows, ts, days, now)
    return marked.agg(F.count_if("expired").alias("removed"), F.count_if(~F.col("expired")).alias("kept"))


def search_log(log: DataFrame, *, task_id: str | None = None, level: str | None = None,
               since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Log lines by task, level and time."""
    if task_id is not None:
        log = log.where(F.col("task_id") == task_id)
    if level is not None:
        log = log.where(F.col("level") == level)
    if since is not None:
        log = log.where(F.col("ts") >= since)
    if until is not None:
        log = log.where(F.col("ts") < until)
    return log


def log_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("level", "module", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("lines"))


def top_errors(log: DataFrame, k: int = 10) -> DataFrame:
    errors = log.where(F.col("level") == "ERROR").groupBy("message").agg(F.count(F.lit(1)).alias("lines"))
    return errors.orderBy(F.col("lines").desc(), F.col("message")).limit(k)


def export_stats(manifest: DataFrame) -> DataFrame:
    """Totals over the export manifest ``(export_id, format, path, records, ok, exported_at)``.
    Records count once per export."""
    per_export = manifest.groupBy("export_id").agg(
        F.count_if("ok").alias("files"), F.max("records").alias("records"), F.max("exported_at").alias("at"))
    formats = manifest.where("ok").agg(F.array_sort(F.collect_set("format")).alias("formats_used"))
    totals = per_export.agg(
        F.count(F.lit(1)).alias("total_exports"), F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"), F.max("at").alias("last_export"))
    return totals.withColumn("formats_used", formats.scalar())


def metric_rows(component: str, row: DataFrame) -> DataFrame:
    """A one-row metrics table as ``component, metric, value`` rows."""
    numbers = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return numbers.unpivot([], numbers.columns, "metric", "value").select(F.lit(component).alias("component"), "metric", "value")


def system_report(components: dict[str, DataFrame]) -> DataFrame:
    """All components' one-row metrics under one another."""
    rows = [metric_rows(name, row) for name, row in components.items()]
    report = rows[0]
    for more in rows[1:]:
        report = report.unionByName(more)
    return report


def health(components: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Status per component and overall.

    A component is a one-row metrics table, the column shown as its detail, and
    a status expression over its metrics. Overall it is unhealthy as soon as one
    component is.
    """
    rows = None
    for name, (metrics, detail, status) in components.items():
        row = metrics.select(F.lit(name).alias("component"), status.alias("status"), F.col(detail).cast("double").alias("detail"))
        rows = row if rows is None else rows.unionByName(row)
    bad = F.bool_or(F.col("status").isin("unhealthy", "error"))
    overall = rows.agg(F.when(bad, "unhealthy").otherwise("healthy").alias("status"))
    return rows.unionByName(overall.select(F.lit("overall").alias("component"), "status", F.lit(None).cast("double").alias("detail")))
