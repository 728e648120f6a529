"""Streaming jobs, each run over a whole table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.functions.urls import domain_of
from trawlframe.operators.requests import fingerprint
from trawlframe.plans.bindings import FETCH_LOG_SQL, RESULTS_SQL, fetches, sql_normalized, sql_url_part, table
from trawlframe.plans.crawl import _TTL_SQL
from trawlframe.plans.fetching import _BREAKER_SQL, rounded
from trawlframe.plans.registry import query
from trawlframe.plans.texts import _WEB_ERRORS, _WEB_SQL, as_webpages
from trawlframe.session import scratch_path
from trawlframe.streaming import breaker, dedup, ingest, metrics


def _stream(spark, sf_dir, name):
    """The table as a file stream. As a pattern the path may name one file or a
    folder of files; a plain path would have to be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _span(events):
    return events.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def _lateness(spark, sf_dir):
    """Seconds that no event is late by: a tenth of the range that ``_run`` deals out, and one more."""
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("last", "first")]
    span = _span(table(spark, sf_dir, "events")).select((micros[0] - micros[1]).alias("us")).first()["us"] or 0
    return span // 10_000_000 + 2


def _run(spark, sf_dir, label, build, finish=False, beyond_us=None):
    """The table of ``build(stream)`` after all events have come: in four runs, quarters of the time range that overlap, as every third event
    is a tenth of the range late. A quarter is written by parallel tasks and is one micro-batch; each run goes on where the last one stopped.
    ``finish`` gives out what still waits after the last; with ``beyond_us`` a closing row that much later comes in a run of its own."""
    files, base = scratch_path(spark, "event-files"), scratch_path(spark, label)
    events = table(spark, sf_dir, "events")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    share = (micros("ts") - micros("first")) / (micros("last") - micros("first") + 1) + F.when(F.col("event_id") % 3 == 0, 0.1).otherwise(0.0)
    dealt = events.join(F.broadcast(_span(events))).withColumn("_file", F.least(F.floor(share * 4), F.lit(3)))  # the span is one row
    arrivals = [dealt.where(F.col("_file") == k).select(events.columns) for k in range(4)]
    if beyond_us is not None:
        arrivals.append(ingest.closing_row(events, "ts", beyond_us))
    for k, rows in enumerate(arrivals):
        rows.write.mode("append").parquet(files)
        if not k:
            job = build(spark.readStream.schema(events.schema).parquet(files))
        out = ingest.to_table(job, f"{base}/out", f"{base}/state", "append", finish and k + 1 == len(arrivals))
    return out


@query("stream_dedup", """
SELECT DISTINCT md5('METHOD:GET|URL:http://h' || user_id || '.example.com/' || event_type) AS fp, time_bucket(INTERVAL 1 DAY, ts) AS period FROM events""")
def stream_dedup(spark, sf_dir):
    """First request of each fingerprint on each day."""
    url = F.concat(F.lit("http://h"), F.col("user_id"), F.lit(".example.com/"), F.col("event_type"))
    late = f"{_lateness(spark, sf_dir)} seconds"
    once = _run(spark, sf_dir, "stream-dedup", lambda events: dedup.first_within(
        events.select("ts", fingerprint(url).alias("fp")), "fp", "ts", "1 day", late))
    return once.select("fp", F.col("period").cast("timestamp_ntz").alias("period"))


def _accepted(spark, sf_dir, ttl):
    late = f"{_lateness(spark, sf_dir)} seconds"
    out = _run(spark, sf_dir, "stream-ttl", lambda events: dedup.accept_with_ttl(events, "user_id", "ts", "event_id", ttl, late), finish=True)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_accept_with_ttl", _TTL_SQL)
def stream_accept_with_ttl(spark, sf_dir):
    """The whole table: what still waits at the end of the stream comes out too."""
    return _accepted(spark, sf_dir, 36_000)


@query("stream_accept_with_ttl_finished", _TTL_SQL)
def stream_accept_with_ttl_finished(spark, sf_dir):
    return _accepted(spark, sf_dir, 36_000)


_METRICS_SQL = f"""
SELECT host, time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, count(*) AS requests,
  round(count(*) FILTER (status_code = 200) / count(*), 6) AS success_rate, round(avg(response_time), 6) AS average_response_time
FROM {FETCH_LOG_SQL} GROUP BY ALL"""


def _measured(spark, sf_dir):
    """A closing row, a day beyond the lateness, closes the last windows."""
    late = _lateness(spark, sf_dir)
    out = _run(spark, sf_dir, "stream-metrics", lambda events: metrics.windowed_metrics(fetches(events), "60 seconds", f"{late} seconds"),
               beyond_us=(late + 86_400) * 1_000_000)
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "success_rate", "average_response_time").drop("window_end")


@query("stream_metrics", _METRICS_SQL)
def stream_metrics(spark, sf_dir):
    """All windows, the last ones too."""
    return _measured(spark, sf_dir)


@query("stream_metrics_finished", _METRICS_SQL)
def stream_metrics_finished(spark, sf_dir):
    return _measured(spark, sf_dir)


def _broken(spark, sf_dir):
    late = f"{_lateness(spark, sf_dir)} seconds"
    out = _run(spark, sf_dir, "stream-breaker", lambda events: breaker.breaker_states(
        fetches(events), threshold=3, recovery_seconds=86_400, lateness=late), finish=True)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_breaker", _BREAKER_SQL.format(wait=86_400 * 1_000_000, threshold=3))
def stream_breaker(spark, sf_dir):
    """The whole table: what still waits at the end of the stream comes out too."""
    return _broken(spark, sf_dir)


@query("stream_breaker_finished", _BREAKER_SQL.format(wait=86_400 * 1_000_000, threshold=3))
def stream_breaker_finished(spark, sf_dir):
    return _broken(spark, sf_dir)


@query("stream_ingest_pages", f"""
SELECT task_id, count(*) AS records FROM (SELECT DISTINCT {sql_url_part('url', 'authority')} AS task_id, {sql_normalized('url')} AS u FROM pages) GROUP BY 1""")
def stream_ingest_pages(spark, sf_dir):
    """Pages arriving twice: the second run adds nothing."""
    base = scratch_path(spark, "stream-ingest")
    for run in ("first", "second"):
        ingest.available_now(_stream(spark, sf_dir, "pages"), f"{base}/{run}",
                             ingest.ingest_pages({"title": "title"}, domain_of("url"), f"{base}/out"))
    return spark.read.parquet(f"{base}/out").groupBy("task_id").agg(F.count(F.lit(1)).alias("records"))


@query("stream_progress", f"""
SELECT task_id, count(*) AS done_count, count(*) FILTER (status_code = 200) AS success_count, count(*) FILTER (status_code IS DISTINCT FROM 200) AS failed_count FROM {RESULTS_SQL} GROUP BY 1""")
def stream_progress(spark, sf_dir):
    base = scratch_path(spark, "stream-progress")
    done = _stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.when(F.col("l_returnflag") == "R", 503).otherwise(200).alias("status_code"))
    return ingest.run_progress(done, f"{base}/out", f"{base}/state")


@query("stream_validation", f"SELECT len({_WEB_ERRORS}) = 0 AS valid, count(*) AS pages FROM {_WEB_SQL} GROUP BY 1")
def stream_validation(spark, sf_dir):
    base = scratch_path(spark, "stream-validation")

    def on_batch(batch, batch_id):
        ingest.validate_by_outcome("basic_webpage", f"{base}/checked")(as_webpages(batch), batch_id)

    ingest.available_now(_stream(spark, sf_dir, "pages"), f"{base}/state", on_batch)
    return spark.read.parquet(f"{base}/checked").groupBy((F.col("outcome") == "valid").alias("valid")).agg(F.count(F.lit(1)).alias("pages"))
