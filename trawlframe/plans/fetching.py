"""Fetch-log analytics over events read as fetch outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.functions import outcomes as O
from trawlframe.operators import fetchlog as L
from trawlframe.plans.bindings import FETCH_LOG_SQL, fetch_log
from trawlframe.plans.registry import query


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("usable_pages", f"""
SELECT event_id, host, status_code, response_time, 'task-' || host AS task_id, ts AS crawl_time FROM {FETCH_LOG_SQL} WHERE status_code = 200""")
def usable_pages(spark, sf_dir):
    log = fetch_log(spark, sf_dir)
    return L.usable_pages(log, F.concat(F.lit("task-"), F.col("host")), F.col("ts")).drop("ts")


_STATS = """count(*) AS total_requests, count(*) FILTER (status_code = 200) AS successful_requests,
  count(*) FILTER (status_code IS DISTINCT FROM 200) AS failed_requests,
  round(count(*) FILTER (status_code = 200) / count(*), 6) AS success_rate, round(avg(response_time), 6) AS average_response_time"""


@query("download_stats", f"SELECT {_STATS} FROM {FETCH_LOG_SQL}")
def download_stats(spark, sf_dir):
    return rounded(L.download_stats(fetch_log(spark, sf_dir)), "success_rate", "average_response_time")


@query("download_stats_by_host", f"SELECT host, {_STATS} FROM {FETCH_LOG_SQL} GROUP BY host")
def download_stats_by_host(spark, sf_dir):
    return rounded(L.download_stats(fetch_log(spark, sf_dir), ["host"]), "success_rate", "average_response_time")


@query("daily_crawl_stats", f"""
SELECT host, CAST(ts AS DATE) AS date, count(*) AS requests_count, count(*) FILTER (status_code = 200) AS success_count,
  count(*) FILTER (status_code IS DISTINCT FROM 200) AS failed_count, round(sum(response_time), 6) AS total_response_time
FROM {FETCH_LOG_SQL} GROUP BY ALL""")
def daily_crawl_stats(spark, sf_dir):
    return rounded(L.daily_stats(fetch_log(spark, sf_dir), "host"), "total_response_time")


def _adapted(rate: str, n: str) -> str:
    return (f"CASE WHEN {n} < 10 THEN 3 WHEN {rate} < 0.8 THEN 5 ELSE 2 END AS max_retries, "
            f"CASE WHEN {n} < 10 THEN 1.0::DOUBLE WHEN {rate} < 0.8 THEN 1.5::DOUBLE ELSE 0.8::DOUBLE END AS base_delay")


@query("retry_stats", f"""
SELECT host, n AS total_requests, ok AS success_count, n - ok AS failure_count, round(ok / n, 6) AS success_rate, {_adapted('ok / n', 'n')}
FROM (SELECT host, count(*) AS n, count(*) FILTER (status_code = 200) AS ok FROM {FETCH_LOG_SQL} GROUP BY host)""")
def retry_stats(spark, sf_dir):
    return rounded(L.retry_stats(fetch_log(spark, sf_dir), ["host"]), "success_rate")


@query("adaptive_retry", f"""
SELECT host, ts, event_id, status_code, n AS requests, ok AS successes, round(ok / n, 6) AS success_rate, {_adapted('ok / n', 'n')}
FROM (SELECT *, count(*) OVER w AS n, CAST(sum(CASE WHEN status_code = 200 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS ok FROM {FETCH_LOG_SQL}
      WINDOW w AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def adaptive_retry(spark, sf_dir):
    return rounded(L.adaptive_retry(fetch_log(spark, sf_dir)), "success_rate")


@query("failure_streaks", f"""
WITH r AS (SELECT host, status_code IS NOT DISTINCT FROM 200 AS ok, sum(CASE WHEN status_code = 200 THEN 1 ELSE 0 END)
             OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM {FETCH_LOG_SQL}),
s AS (SELECT host, run, count(*) FILTER (NOT ok) AS n FROM r GROUP BY host, run)
SELECT host, max(n) AS longest_streak, max_by(n, run) AS current_streak, max(n) >= 5 AS alarm FROM s GROUP BY host""")
def failure_streaks(spark, sf_dir):
    return L.failure_streaks(fetch_log(spark, sf_dir))


@query("retry_plan", f"""
SELECT event_id, ts, host, status_code, response_time, k AS attempt, least(power(2.0, k), 60.0)::DOUBLE AS delay,
  least(0.5 * power(2.0, k), 60.0)::DOUBLE AS delay_low, least(1.5 * power(2.0, k), 60.0)::DOUBLE AS delay_high
FROM {FETCH_LOG_SQL}, (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS k) WHERE status_code IN (429, 503) OR status_code IS NULL""")
def retry_plan(spark, sf_dir):
    return L.retry_plan(fetch_log(spark, sf_dir), max_retries=7)


_BREAKER_SQL = f"""
WITH RECURSIVE c AS (
  SELECT host, ts, event_id, epoch_us(ts) AS us, status_code IS NOT DISTINCT FROM 200 AS ok,
         row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn FROM {FETCH_LOG_SQL}),
walk AS (
  SELECT host, 0::BIGINT AS rn, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, 'closed' AS state, 'accepted' AS decision,
         0 AS fails, 0::BIGINT AS last_fail FROM (SELECT DISTINCT host FROM c)
  UNION ALL
  SELECT c.host, c.rn, c.ts, c.event_id,
    CASE WHEN w.state = 'open' AND c.us - w.last_fail < {{wait}} THEN 'open' WHEN c.ok THEN 'closed'
         WHEN w.fails + 1 >= {{threshold}} THEN 'open' ELSE 'closed' END,
    CASE WHEN w.state = 'open' AND c.us - w.last_fail < {{wait}} THEN 'rejected' WHEN w.state = 'open' THEN 'trial' ELSE 'accepted' END,
    CASE WHEN w.state = 'open' AND c.us - w.last_fail < {{wait}} THEN w.fails WHEN c.ok THEN 0 ELSE w.fails + 1 END,
    CASE WHEN w.state = 'open' AND c.us - w.last_fail < {{wait}} THEN w.last_fail WHEN c.ok THEN w.last_fail ELSE c.us END
  FROM walk w JOIN c ON c.host = w.host AND c.rn = w.rn + 1)
SELECT host, ts, event_id, decision, state FROM walk WHERE rn > 0"""


@query("breaker_replay", _BREAKER_SQL.format(wait=60 * 1_000_000, threshold=5))
def breaker_replay(spark, sf_dir):
    return L.breaker_replay(fetch_log(spark, sf_dir))


@query("breaker_replay_long_recovery", _BREAKER_SQL.format(wait=86_400 * 1_000_000, threshold=3))
def breaker_replay_long_recovery(spark, sf_dir):
    """Threshold 3 and a day's recovery, so that calls are really rejected."""
    return L.breaker_replay(fetch_log(spark, sf_dir), threshold=3, recovery_seconds=86_400)


@query("outcome_classes", f"""
SELECT event_id, CASE WHEN status_code IS NULL THEN 'network' WHEN status_code = 200 THEN 'ok' WHEN status_code = 429 THEN 'rate_limit'
    WHEN status_code = 503 THEN 'server' ELSE 'http_error' END AS outcome,
  coalesce(status_code, 503) IN (429, 503) AS retryable, coalesce(status_code, 503) IN (404, 429, 503) AS retryable_custom,
  coalesce(status_code, 503) IN (429, 503) AS retryable_by_class FROM {FETCH_LOG_SQL}""")
def outcome_classes(spark, sf_dir):
    log = fetch_log(spark, sf_dir)
    status = F.col("status_code")
    outcome = O.outcome_class(status)
    return log.select("event_id", outcome.alias("outcome"), O.retryable_status(status).alias("retryable"),
                      O.retryable_status(status, extra=[404]).alias("retryable_custom"),
                      O.retryable_class(outcome).alias("retryable_by_class"))


@query("outcome_classes_by_route", """
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network'
  WHEN 2 THEN CASE WHEN c_acctbal > 0 THEN 'proxy' ELSE 'http_error' END
  WHEN 3 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'cookie' ELSE 'http_error' END
  WHEN 4 THEN 'server' WHEN 5 THEN 'ok' ELSE 'http_error' END AS outcome FROM customer""")
def outcome_classes_by_route(spark, sf_dir):
    """customers as fetches with and without proxy and cookies."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 7
    failure = F.when(k == 0, "timeout").when(k == 1, "connection")
    status = F.when(k == 2, 407).when(k == 3, 403).when(k == 4, 502).when(k == 5, 200).otherwise(501)
    return c.select("c_custkey", O.outcome_class(
        status, F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING", failure).alias("outcome"))


@query("error_dimension_join", f"""
SELECT outcome, any_value(CASE outcome WHEN 'rate_limit' THEN 'RateLimitException' WHEN 'server' THEN 'ServerException' WHEN 'network' THEN 'NetworkException' ELSE 'Exception' END) AS error_class,
  any_value(CASE outcome WHEN 'rate_limit' THEN 429 ELSE 500 END) AS code, count(*) AS failures
FROM (SELECT CASE WHEN status_code IS NULL THEN 'network' WHEN status_code = 429 THEN 'rate_limit' WHEN status_code = 503 THEN 'server'
        ELSE 'http_error' END AS outcome
      FROM {FETCH_LOG_SQL} WHERE status_code IS DISTINCT FROM 200) GROUP BY outcome""")
def error_dimension_join(spark, sf_dir):
    log = fetch_log(spark, sf_dir).where("status_code IS DISTINCT FROM 200")
    counted = log.groupBy(O.outcome_class(F.col("status_code")).alias("outcome")).agg(F.count(F.lit(1)).alias("failures"))
    return O.with_error_class(counted, "outcome").select("outcome", "error_class", "code", "failures")


@query("error_retryable", f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'false' ELSE 'true' END = 'true' AND event_id % 3 <> 0 AND status_code IS DISTINCT FROM 404 AS retryable
FROM {FETCH_LOG_SQL} WHERE status_code IS DISTINCT FROM 200""")
def error_retryable(spark, sf_dir):
    """Failed fetches as errors whose details carry the two flags."""
    log = fetch_log(spark, sf_dir).where("status_code IS DISTINCT FROM 200")
    details = F.create_map(
        F.lit("retryable"), F.when(F.col("event_id") % 5 == 0, "false").otherwise("true"),
        F.lit("recoverable"), F.when(F.col("event_id") % 3 == 0, "0").otherwise("1"))
    return log.select("event_id", O.retryable_error(F.col("status_code"), details).alias("retryable"))


@query("error_contexts", f"""
SELECT event_id, '[' || coalesce(status_code, 500) || '] fetch failed' AS message, coalesce(status_code, 500) AS code, ts AS at,
  status_code IS DISTINCT FROM 404 AS retryable
FROM {FETCH_LOG_SQL} WHERE status_code IS DISTINCT FROM 200""")
def error_contexts(spark, sf_dir):
    log = fetch_log(spark, sf_dir).where("status_code IS DISTINCT FROM 200")
    context = O.error_context(F.lit("NetworkException"), F.lit("fetch failed"), F.col("status_code"),
                              F.create_map(F.lit("url"), F.col("host").cast("string")), F.col("ts"))
    return log.select("event_id", context.alias("c")).select(
        "event_id", "c.message", "c.code", F.col("c.timestamp").alias("at"), "c.retryable")


@query("crawl_metrics_per_minute", f"""
SELECT host, time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, count(*) AS requests,
  round(count(*) FILTER (status_code = 200) / count(*), 6) AS success_rate, round(avg(response_time), 6) AS average_response_time
FROM {FETCH_LOG_SQL} GROUP BY ALL""")
def crawl_metrics_per_minute(spark, sf_dir):
    """Batch twin of the streaming metrics."""
    from trawlframe.streaming.metrics import windowed_metrics
    per_window = windowed_metrics(fetch_log(spark, sf_dir), "60 seconds")
    return rounded(per_window.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")),
                   "success_rate", "average_response_time").drop("window_end")
