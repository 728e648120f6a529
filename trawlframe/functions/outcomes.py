"""Fetch outcomes and errors: classes and whether a retry makes sense."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Status lists, the error dimension (type, class, code, sub-types
# that allow a retry) and the codes that never do.
RETRY_STATUS = (408, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524)
SERVER_STATUS = (500, 502, 503, 504)
NEVER_RETRY_CODES = (400, 401, 403, 404, 422)
ERROR_TYPES = (
    ("network", "NetworkException", 500, None),
    ("timeout", "TimeoutException", 408, None),
    ("rate_limit", "RateLimitException", 429, None),
    ("proxy", "ProxyException", 500, ("connection_failed", "timeout", "banned")),
    ("cookie", "CookieException", 500, None),
    ("parser", "ParserException", 500, ("selector_not_found", "empty_content", "encoding_error")),
    ("storage", "StorageException", 500, ("io_error", "temporary_failure", "quota_exceeded")),
    ("validation", "ValidationException", 400, None),
    ("database", "DatabaseException", 500, ("connection_error", "timeout_error", "lock_timeout")),
    ("configuration", "ConfigurationException", 400, ()),
    ("task_conflict", "TaskConflictException", 409, ()),
    ("task_not_found", "TaskNotFoundException", 404, None),
    ("server", "ServerException", 500, None),
    ("crawler", "CrawlerException", 500,
     ("network_error", "timeout_error", "server_error", "rate_limit", "proxy_error", "dns_error")),
)


def is_success(status: Column) -> Column:
    """Never null: a fetch without a status (timeout, lost connection) failed."""
    return status.eqNullSafe(F.lit(200))


def outcome_class(
    status: Column,
    used_proxy: Column | None = None,
    used_cookies: Column | None = None,
    failure: Column | None = None,
) -> Column:
    """ok, rate_limit, server, proxy, cookie, timeout, network or http_error.
    ``failure`` ('timeout' / 'connection') tells of a fetch without a response; neither
    that nor a status: network."""
    no = F.lit(False)
    proxy = used_proxy if used_proxy is not None else no
    cookies = used_cookies if used_cookies is not None else no
    kind = failure if failure is not None else F.lit(None).cast("string")
    return (F.when(kind == "timeout", "timeout").when(kind.isNotNull() | status.isNull(), "network")
            .when(status == 200, "ok").when(status == 429, "rate_limit")
            .when(status.isin(*SERVER_STATUS), "server")
            .when((status == 407) & proxy, "proxy")
            .when(status.isin(401, 403) & cookies, "cookie")
            .otherwise("http_error"))


def retryable_status(status: Column, extra: Iterable[int] = ()) -> Column:
    """Listed statuses and fetches without one; of the others, client errors are final and server errors not."""
    return status.isNull() | status.isin(*RETRY_STATUS, *extra) | (status >= 500)


def retryable_class(
    kind: Column,
    retry_on_timeout: bool = True,
    retry_on_rate_limit: bool = True,
    overrides: dict[str, bool] | None = None,
) -> Column:
    """By outcome class; ``overrides`` decides classes without a rule of their own."""
    rule = (F.when(kind.isin("network", "timeout"), F.lit(retry_on_timeout))
            .when(kind == "rate_limit", F.lit(retry_on_rate_limit))
            .when(kind.isin("proxy", "server"), F.lit(True)))
    for name, verdict in (overrides or {}).items():
        rule = rule.when(kind == name, F.lit(verdict))
    return rule.otherwise(False)


def retryable_error(code: Column, details: Column) -> Column:
    """By code and the flags ``retryable`` / ``recoverable`` of a details map,
    both true when absent."""
    def flag(name: str) -> Column:
        return ~F.coalesce(F.lower(details[name]).isin("false", "0", "", "none", "null"), F.lit(False))
    return flag("retryable") & flag("recoverable") & ~F.coalesce(code.isin(*NEVER_RETRY_CODES), F.lit(False))


def error_dimension(spark: SparkSession) -> DataFrame:
    """error_type, error_class, code, retryable_subtypes: 14 fixed rows."""
    return spark.createDataFrame(
        [(t, c, code, None if subs is None else list(subs)) for t, c, code, subs in ERROR_TYPES],
        "error_type string, error_class string, code int, retryable_subtypes array<string>")


def with_error_class(df: DataFrame, error_type: str = "error_type") -> DataFrame:
    """Joins the error dimension; its 14 rows are safe to broadcast. An unknown
    type gets the base class and code 500."""
    dim = error_dimension(df.sparkSession).withColumnRenamed("error_type", "_type")
    return (df.join(F.broadcast(dim), F.col(error_type) == F.col("_type"), "left").drop("_type")
            .withColumns({"error_class": F.coalesce("error_class", F.lit("Exception")),
                          "code": F.coalesce("code", F.lit(500))}))


def error_context(error_class: Column, message: Column, code: Column, details: Column, ts: Column) -> Column:
    """Error as a struct for logs; without a code it is 500."""
    code = F.coalesce(code, F.lit(500))
    return F.struct(
        error_class.alias("exception_type"), F.concat(F.lit("["), code.cast("string"), F.lit("] "), message).alias("message"),
        ts.alias("timestamp"), code.alias("code"), details.alias("details"),
        retryable_error(code, details).alias("retryable"))


def rate(part: Column, whole: Column) -> Column:
    """Share, 0 when there is nothing to share."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
