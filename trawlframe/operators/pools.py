"""Proxy pools, cookie sets and leases as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions.outcomes import is_success, rate

# Proxy states and the share of successes a usable proxy has.
PROXY_STATUSES = ("active", "inactive", "banned", "timeout", "testing")
USABLE_RATE = 0.8

COOKIE_SCHEMA = ("domain string, source string, cookies map<string,string>, created_at timestamp, "
                 "expires_at timestamp, _corrupt_record string")


def pool_from_outcomes(log: DataFrame, proxy: str = "proxy", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Pool table from a fetch log: counts, last response time, state after the
    last outcome. Plain aggregates, so a busy proxy is combined on the map side."""
    ok = is_success(F.col("status_code"))
    last = F.max_by(F.struct("status_code", "response_time"), F.struct(*order))
    return log.groupBy(F.col(proxy).alias("url")).agg(
        F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count"),
        last.alias("_last"), F.max(order[0]).alias("last_tested")
    ).select(
        "url", F.when(is_success(F.col("_last.status_code")), "active").otherwise("inactive").alias("status"),
        F.col("_last.response_time").alias("response_time"), "success_count", "failure_count", "last_tested")


def success_rate() -> Column:
    return rate(F.col("success_count"), F.col("success_count") + F.col("failure_count"))


def is_usable() -> Column:
    return (success_rate() >= USABLE_RATE) & (F.col("status") != "banned")


def usable(pool: DataFrame) -> DataFrame:
    return pool.withColumn("success_rate", success_rate()).where(is_usable())


def first_usable(pool: DataFrame, order: list) -> DataFrame:
    return usable(pool).orderBy(*order).limit(1)


def without(pool: DataFrame, url: str) -> DataFrame:
    return pool.where(F.col("url") != url)


def cleanup_report(pool: DataFrame) -> DataFrame:
    """One row: how many stay and how many a clean-up removes."""
    return pool.agg(F.count_if(is_usable()).alias("kept"), F.count_if(~is_usable()).alias("removed"))


def pool_stats(pool: DataFrame) -> DataFrame:
    return pool.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in PROXY_STATUSES[:4]],
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("average_response_time"))


def parse_cookie_sets(files: DataFrame, text: str = "value") -> DataFrame:
    """Adds the cookie set of a JSON file's text and whether it is readable."""
    options = {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}
    parsed = files.withColumn("_set", F.from_json(text, COOKIE_SCHEMA, options)).drop(text)
    return parsed.select(
        *[c for c in parsed.columns if c != "_set"], "_set.domain", "_set.source", "_set.cookies",
        "_set.created_at", "_set.expires_at",
        (F.col("_set._corrupt_record").isNull() & F.col("_set.expires_at").isNotNull()).alias("readable"))


def read_cookie_sets(spark, path: str) -> DataFrame:
    """Cookie files of a folder with their path and modification time."""
    files = spark.read.option("wholetext", True).text(path)
    return parse_cookie_sets(files.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")))


def valid_sets(sets: DataFrame, now: Column, domain: str | None = None) -> DataFrame:
    """Readable sets not expired at ``now``, newest file first."""
    kept = sets.where(F.col("readable") & (F.col("expires_at") >= now.cast("timestamp")))
    if domain is not None:
        kept = kept.where(F.col("domain") == domain)
    return kept.orderBy(F.col("modified").desc(), F.col("path"))


def discarded_sets(sets: DataFrame, now: Column) -> DataFrame:
    """Expired or unreadable sets, the ones a clean-up deletes."""
    return sets.where(~F.col("readable") | (F.col("expires_at") < now.cast("timestamp")))


def newest_valid_set(sets: DataFrame, now: Column) -> DataFrame:
    """The newest valid set of each domain."""
    kept = sets.where(F.col("readable") & (F.col("expires_at") >= now.cast("timestamp")))
    return kept.groupBy("domain").agg(
        F.max_by(F.struct("path", "cookies", "expires_at"), F.struct("modified", "path")).alias("_s")
    ).select("domain", "_s.*")


def with_cookies(requests: DataFrame, newest: DataFrame, domain: str = "domain") -> DataFrame:
    """Requests with the cookies of their domain, null without a valid set.
    There is one set per domain, so a hot domain is split by the skew join."""
    return requests.join(newest.select(F.col("domain").alias(domain), "cookies"), domain, "left")


def cookie_stats(sets: DataFrame, now: Column) -> DataFrame:
    current = F.col("expires_at") >= now.cast("timestamp")
    return sets.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("readable").alias("total_cookies"),
        F.count_if(F.col("readable") & current).alias("valid_cookies"),
        F.count_if(F.col("readable") & ~current).alias("expired_cookies"))


def lease_report(leases: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Per resource of ``leases(resource, lease_id, leased_at, released_at)``: state, last use,
    number of uses, leases that ran out without a release."""
    now = now.cast("timestamp")
    ends = F.col("leased_at").cast("timestamp") + F.make_dt_interval(secs=F.lit(lease_seconds))
    open_lease = F.col("released_at").isNull() & (ends > now)
    ran_out = F.col("released_at").isNull() & (ends <= now)
    return leases.groupBy("resource").agg(
        F.when(F.count_if(open_lease) > 0, "in_use").otherwise("idle").alias("status"),
        F.max("leased_at").alias("last_used"), F.count(F.lit(1)).alias("usage_count"),
        F.count_if(ran_out).alias("expired_leases"))
