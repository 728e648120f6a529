"""Crawl metrics per time window, on a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.functions.outcomes import is_success


def windowed_metrics(log: DataFrame, width: str = "60 seconds", lateness: str | None = None) -> DataFrame:
    """Requests, success rate and mean response time per host and window.

    On a stream give ``lateness``: a window closes that long after its end and
    rows arriving later are dropped. Sums per host and window are combined on
    the map side, so a hot host does not hurt.
    """
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness is not None:
        log = log.withWatermark("ts", lateness)
    ok = is_success(F.col("status_code"))
    return (log.groupBy("host", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"),
        F.avg("response_time").alias("average_response_time"))
        .select("host", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "requests", "success_rate", "average_response_time"))
