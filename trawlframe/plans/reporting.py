"""Pools, link graph, logs, stores and management reports over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.functions import ids as I
from trawlframe.functions.urls import domain_of, normalize_url
from trawlframe.operators import extraction as X
from trawlframe.operators import fetchlog as L
from trawlframe.operators import linkgraph as LG
from trawlframe.operators import pools as PO
from trawlframe.operators import reports as RP
from trawlframe.operators import requests as R
from trawlframe.operators import tasks as Q
from trawlframe.operators import validation as VAL
from trawlframe.operators.ordered import running
from trawlframe.operators.steps import run_steps
from trawlframe.plans.bindings import (
    EDGES_SQL, FETCH_LOG_SQL, RESULTS_SQL, TASKS_SQL, edges, fetch_log, pages, results, sql_normalized, sql_url_part,
    table, tasks)
from trawlframe.plans.fetching import rounded
from trawlframe.plans.registry import query
from trawlframe.session import scratch_path
from trawlframe.sources import exports as EX
from trawlframe.sources import logs as LO
from trawlframe.sources import store as ST


# Pools.
def _pool(spark, sf_dir):
    """suppliers as proxies; each line they shipped is an outcome."""
    li = table(spark, sf_dir, "lineitem")
    ok = (F.col("l_returnflag") != "R") | (F.col("l_quantity") > 20 + F.col("l_suppkey") % 20)
    counts = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.concat(F.lit("http://"), F.col("s_suppkey"), F.lit(".proxy.example.com")).alias("url"),
        F.element_at(F.array(*[F.lit(x) for x in PO.PROXY_STATUSES]), F.col("s_nationkey") % 5 + 1).alias("status"),
        (F.abs("s_acctbal") / 1000).alias("response_time"))
    return s.join(counts, "k", "left").na.fill(0, ["success_count", "failure_count"])


_POOL_SQL = """(SELECT s_suppkey AS k, 'http://' || s_suppkey || '.proxy.example.com' AS url,
  (['active', 'inactive', 'banned', 'timeout', 'testing'])[s_nationkey % 5 + 1] AS status, abs(s_acctbal) / 1000 AS response_time,
  count(*) FILTER (l_returnflag <> 'R' OR l_quantity > 20 + l_suppkey % 20) AS success_count,
  count(*) FILTER (NOT (l_returnflag <> 'R' OR l_quantity > 20 + l_suppkey % 20)) AS failure_count
  FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)"""
_RATE = "CASE WHEN success_count + failure_count = 0 THEN 0.0 ELSE success_count / (success_count + failure_count) END"


@query("proxies_usable", f"SELECT url, status, round({_RATE}, 6)::DOUBLE AS success_rate FROM {_POOL_SQL} WHERE {_RATE} >= 0.8 AND status <> 'banned'")
def proxies_usable(spark, sf_dir):
    return rounded(PO.usable(_pool(spark, sf_dir)).select("url", "status", "success_rate"), "success_rate")


@query("proxy_first_usable", f"SELECT url FROM {_POOL_SQL} WHERE {_RATE} >= 0.8 AND status <> 'banned' ORDER BY k LIMIT 1")
def proxy_first_usable(spark, sf_dir):
    return PO.first_usable(_pool(spark, sf_dir), ["k"]).select("url")


@query("proxy_cleanup", f"""
SELECT count(*) FILTER ({_RATE} >= 0.8 AND status <> 'banned') AS kept, count(*) FILTER (NOT ({_RATE} >= 0.8 AND status <> 'banned')) AS removed FROM {_POOL_SQL}""")
def proxy_cleanup(spark, sf_dir):
    return PO.cleanup_report(_pool(spark, sf_dir))


@query("proxy_removed", f"SELECT url FROM {_POOL_SQL} WHERE k <> 3")
def proxy_removed(spark, sf_dir):
    return PO.without(_pool(spark, sf_dir), "http://3.proxy.example.com").select("url")


@query("proxy_pool_stats", f"""
SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'inactive') AS inactive,
  count(*) FILTER (status = 'banned') AS banned, count(*) FILTER (status = 'timeout') AS timeout, round(avg(response_time), 6) AS average_response_time FROM {_POOL_SQL}""")
def proxy_pool_stats(spark, sf_dir):
    return rounded(PO.pool_stats(_pool(spark, sf_dir)), "average_response_time")


@query("proxy_pool_from_log", f"""
SELECT host AS url, CASE WHEN max_by(coalesce(status_code, 0), {{'t': ts, 'i': event_id}}) = 200 THEN 'active' ELSE 'inactive' END AS status,
  max_by(response_time, {{'t': ts, 'i': event_id}}) AS response_time, count(*) FILTER (status_code = 200) AS success_count,
  count(*) FILTER (status_code IS DISTINCT FROM 200) AS failure_count, max(ts) AS last_tested FROM {FETCH_LOG_SQL} GROUP BY host""")
def proxy_pool_from_log(spark, sf_dir):
    return PO.pool_from_outcomes(fetch_log(spark, sf_dir), "host")


# Cookie sets: one JSON text per customer, some cut off, some long expired.
def _cookie_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    expires = F.concat(F.lit(2020), F.lit("-0"), 1 + k % 9, F.lit("-15T00:00:00"))
    text = F.concat(F.lit('{"domain": "n'), F.col("c_nationkey"), F.lit('.example.com", "source": "login", "cookies": {"sid": "'), k,
                    F.lit('"}, "created_at": "2020-01-01T00:00:00", "expires_at": "'), expires, F.lit('"}'))
    return c.select(F.when(k % 11 == 0, F.left(text, F.lit(40))).otherwise(text).alias("value"),
                    F.concat(F.lit("c"), k, F.lit(".json")).alias("path"), (k * 7919 % 100003).alias("modified"))


_COOKIES_SQL = """(SELECT 'c' || c_custkey || '.json' AS path, c_custkey * 7919 % 100003 AS modified, c_custkey % 11 <> 0 AS readable,
  CASE WHEN c_custkey % 11 <> 0 THEN 'n' || c_nationkey || '.example.com' END AS domain, c_custkey AS sid, make_timestamp(2020, 1 + c_custkey % 9, 15, 0, 0, 0) AS expires_at FROM customer)"""


def _cookie_now():
    return F.lit("2020-05-01").cast("timestamp")


_VALID = "readable AND expires_at >= TIMESTAMP '2020-05-01'"


@query("cookie_sets_valid", f"SELECT path, domain, CAST(sid AS VARCHAR) AS sid FROM {_COOKIES_SQL} WHERE {_VALID}")
def cookie_sets_valid(spark, sf_dir):
    sets = PO.parse_cookie_sets(_cookie_files(spark, sf_dir))
    return PO.valid_sets(sets, _cookie_now()).select("path", "domain", F.col("cookies")["sid"].alias("sid"))


@query("cookie_sets_discarded", f"SELECT path, readable FROM {_COOKIES_SQL} WHERE NOT ({_VALID})")
def cookie_sets_discarded(spark, sf_dir):
    return PO.discarded_sets(PO.parse_cookie_sets(_cookie_files(spark, sf_dir)), _cookie_now()).select("path", "readable")


_NEWEST_SQL = f"(SELECT domain, max_by(path, {{'m': modified, 'p': path}}) AS path, max_by(sid, {{'m': modified, 'p': path}}) AS sid FROM {_COOKIES_SQL} WHERE {_VALID} GROUP BY domain)"


@query("cookie_set_newest", f"SELECT domain, path FROM {_NEWEST_SQL}")
def cookie_set_newest(spark, sf_dir):
    return PO.newest_valid_set(PO.parse_cookie_sets(_cookie_files(spark, sf_dir)), _cookie_now()).select("domain", "path")


@query("cookie_stats", f"""
SELECT count(*) AS total_files, count(*) FILTER (readable) AS total_cookies, count(*) FILTER ({_VALID}) AS valid_cookies,
  count(*) FILTER (readable AND NOT ({_VALID})) AS expired_cookies FROM {_COOKIES_SQL}""")
def cookie_stats(spark, sf_dir):
    return PO.cookie_stats(PO.parse_cookie_sets(_cookie_files(spark, sf_dir)), _cookie_now())


@query("requests_with_cookies", f"""
SELECT o_orderkey, 'n' || (o_custkey % 30) || '.example.com' AS domain, CAST(sid AS VARCHAR) AS sid
FROM orders LEFT JOIN {_NEWEST_SQL} n ON n.domain = 'n' || (o_custkey % 30) || '.example.com'""")
def requests_with_cookies(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("n"), F.col("o_custkey") % 30, F.lit(".example.com")).alias("domain"))
    newest = PO.newest_valid_set(PO.parse_cookie_sets(_cookie_files(spark, sf_dir)), _cookie_now())
    return PO.with_cookies(requests, newest).select("o_orderkey", "domain", F.col("cookies")["sid"].alias("sid"))


@query("lease_report", """
SELECT l_suppkey AS resource, CASE WHEN count(*) FILTER (l_returnflag = 'N' AND l_shipdate + INTERVAL 30 DAY > TIMESTAMP '2001-06-01') > 0 THEN 'in_use' ELSE 'idle' END AS status,
  max(l_shipdate) AS last_used, count(*) AS usage_count, count(*) FILTER (l_returnflag = 'N' AND l_shipdate + INTERVAL 30 DAY <= TIMESTAMP '2001-06-01') AS expired_leases
FROM lineitem GROUP BY l_suppkey""")
def lease_report(spark, sf_dir):
    """lineitem as leases of 30 days per supplier; unreturned lines are open."""
    leases = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("resource"), F.col("l_shipdate").alias("leased_at"),
        F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("released_at"))
    return PO.lease_report(leases, F.lit("2001-06-01").cast("timestamp"), 30 * 86_400)


# Link graph.
@query("link_out_degrees", f"SELECT src_url, count(*) AS out_degree FROM {EDGES_SQL} GROUP BY 1")
def link_out_degrees(spark, sf_dir):
    return LG.out_degrees(edges(spark, sf_dir))


@query("link_in_degrees", f"SELECT {sql_normalized('dst_url')} AS url, count(*) AS in_degree FROM {EDGES_SQL} GROUP BY 1")
def link_in_degrees(spark, sf_dir):
    return LG.in_degrees(edges(spark, sf_dir))


# Links by themselves lead outside the given pages; each page's own address
# without its last letter, and its full address, are added as link targets.
def _graph(spark, sf_dir):
    own = pages(spark, sf_dir).select("page_id", F.col("url").alias("src_url"), F.lit(-1).alias("pos"),
                                      F.explode(F.array(F.col("url"), F.concat("url", F.lit("x")))).alias("dst_url"))
    return edges(spark, sf_dir).unionByName(own)


_GRAPH_SQL = f"(SELECT src_url, dst_url FROM {EDGES_SQL} UNION ALL SELECT url, url FROM pages UNION ALL SELECT url, url || 'x' FROM pages)"
_TARGETS_SQL = f"(SELECT {sql_normalized('dst_url')} AS url, count(*) AS in_degree FROM {_GRAPH_SQL} GROUP BY 1)"


@query("link_targets", f"""
SELECT url, in_degree, url IN (SELECT {sql_normalized('url')} FROM pages) AS crawled FROM {_TARGETS_SQL}""")
def link_targets(spark, sf_dir):
    return LG.targets(_graph(spark, sf_dir), pages(spark, sf_dir))


@query("link_targets_uncrawled", f"SELECT url, in_degree FROM {_TARGETS_SQL} WHERE url NOT IN (SELECT {sql_normalized('url')} FROM pages)")
def link_targets_uncrawled(spark, sf_dir):
    return LG.uncrawled(_graph(spark, sf_dir), pages(spark, sf_dir))


@query("link_domain_counts", f"""
SELECT domain, CAST(sum(p) AS BIGINT) AS pages, CAST(sum(o) AS BIGINT) AS links_from, CAST(sum(i) AS BIGINT) AS links_to FROM (
  SELECT {sql_url_part('url', 'authority')} AS domain, 1 AS p, 0 AS o, 0 AS i FROM pages
  UNION ALL SELECT {sql_url_part('src_url', 'authority')}, 0, 1, 0 FROM {EDGES_SQL}
  UNION ALL SELECT {sql_url_part('dst_url', 'authority')}, 0, 0, 1 FROM {EDGES_SQL}) GROUP BY domain""")
def link_domain_counts(spark, sf_dir):
    return LG.domain_counts(pages(spark, sf_dir), edges(spark, sf_dir))


@query("crawl_remaining", f"""
WITH t AS (SELECT url, in_degree FROM {_TARGETS_SQL}),
e AS (SELECT {sql_normalized('dst_url')} AS url, count(*) AS errors FROM {EDGES_SQL} WHERE pos % 3 = 1 GROUP BY 1)
SELECT url, in_degree, coalesce(errors, 0) AS errors FROM t LEFT JOIN e USING (url) WHERE url NOT IN (SELECT {sql_normalized('url')} FROM pages)""")
def crawl_remaining(spark, sf_dir):
    """Targets not crawled yet with their errors; every third link of a page stands for a failed attempt at its target."""
    crawled = pages(spark, sf_dir).select(normalize_url("url").alias("url"))
    failed = edges(spark, sf_dir).where("pos % 3 = 1").select(normalize_url("dst_url").alias("url"))
    return Q.remaining(LG.in_degrees(_graph(spark, sf_dir)), crawled, failed, key="url")


@query("next_page_links", f"""
SELECT page_id, src_url, dst_url FROM (SELECT page_id, src_url, pos, dst_url FROM {EDGES_SQL}) WHERE dst_url NOT IN (SELECT url FROM pages)""")
def next_page_links(spark, sf_dir):
    return X.next_pages(pages(spark, sf_dir), "a::attr(href)", pages(spark, sf_dir))


# Logs, as lines written from events.
def _json_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(
        F.concat(F.lit("fetch "), F.col("event_type"), F.lit(" host "), F.col("user_id") % 7).alias("message"), I.iso_time(F.col("ts")).alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("module"),
        F.col("user_id").cast("string").alias("task_id"), (F.col("value") / 100).alias("response_time")))
    return e.select("event_id", F.when(F.col("event_id") % 50 == 0, F.left(line, F.lit(30))).otherwise(line).alias("value"))


_LOG_SQL = """(SELECT event_id, 'fetch ' || event_type || ' host ' || (user_id % 7) AS message, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  event_type AS module, CAST(user_id AS VARCHAR) AS task_id, value / 100 AS response_time FROM events WHERE event_id % 50 <> 0)"""


def _log(spark, sf_dir):
    log = LO.parse_json_log(_json_lines(spark, sf_dir))
    return log.where("readable").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("json_log_lines", f"SELECT event_id, message, ts, level, module, task_id, response_time FROM {_LOG_SQL}")
def json_log_lines(spark, sf_dir):
    return _log(spark, sf_dir).select("event_id", "message", "ts", "level", "module", "task_id", "response_time")


@query("text_log_lines", """
SELECT event_id, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level,
  'crawl.host' || user_id AS logger, '[' || event_type || '] value: ' || value AS message FROM events""")
def text_log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" ["), F.when(F.col("event_type") == "error", "WARNING").otherwise("INFO"),
                    F.lit("] crawl.host"), F.col("user_id"), F.lit(": ["), F.col("event_type"), F.lit("] value: "), F.col("value"))
    parsed = LO.parse_text_log(e.select("event_id", line.alias("value")))
    return parsed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("log_search", f"SELECT event_id, ts FROM {_LOG_SQL} WHERE task_id = '8' AND level = 'ERROR' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25'")
def log_search(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return RP.search_log(_log(spark, sf_dir), task_id="8", level="ERROR", since=day("2024-01-10"), until=day("2024-01-25")).select("event_id", "ts")


@query("log_counts", f"SELECT level, module, CAST(ts AS DATE) AS day, count(*) AS lines FROM {_LOG_SQL} GROUP BY ALL")
def log_counts(spark, sf_dir):
    return RP.log_counts(_log(spark, sf_dir))


@query("log_top_errors", f"SELECT message, count(*) AS lines FROM {_LOG_SQL} WHERE level = 'ERROR' GROUP BY 1 ORDER BY lines DESC, message LIMIT 5")
def log_top_errors(spark, sf_dir):
    return RP.top_errors(_log(spark, sf_dir), 5)


# Ids.
@query("task_ids", """
SELECT event_id, ((epoch_us(ts) // 1000 - 1600000000000) << 22) | (1 << 12) | (event_id & 4095) AS id, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS id_time,
  1 AS worker, CAST(event_id & 4095 AS INTEGER) AS sequence, substr(sha256(CAST(event_id AS VARCHAR)), 1, 32) AS row_id,
  event_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS file_name, 'task_results_' || strftime(ts, '%Y%m%d_%H%M%S') AS export_name,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso_time FROM events""")
def task_ids(spark, sf_dir):
    made = I.snowflake(F.col("ts"), F.col("event_id"))
    with_id = table(spark, sf_dir, "events").select("event_id", "ts", made.alias("id"))
    return with_id.select(
        "event_id", "id", I.snowflake_time(F.col("id")).cast("timestamp_ntz").alias("id_time"), I.snowflake_worker(F.col("id")).alias("worker"),
        I.snowflake_sequence(F.col("id")).alias("sequence"), I.row_uuid(F.col("event_id").cast("string")).alias("row_id"),
        I.file_name(F.col("event_id"), F.col("ts")).alias("file_name"), I.export_name(F.col("ts")).alias("export_name"), I.iso_time(F.col("ts")).alias("iso_time"))


# Stores and exports: written below the checkpoint folder and read back.
@query("result_envelopes_roundtrip", f"SELECT task_id, result_id, url, status_code, response_time FROM {RESULTS_SQL}")
def result_envelopes_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "envelopes")
    rows = results(spark, sf_dir).select("task_id", "result_id", "url", "status_code", "response_time")
    ST.save_results(rows, path, ["result_id", "url", "status_code", "response_time"], F.lit("2024-01-01T00:00:00"), max_rows=3)
    return ST.load_results(spark, path, "result_id string, url string, status_code int, response_time double")


@query("result_store_roundtrip", f"SELECT task_id, result_id, '' AS url, status_code, 0.0::DOUBLE AS response_time, '{{}}' AS data FROM {RESULTS_SQL} WHERE task_id = 42")
def result_store_roundtrip(spark, sf_dir):
    """Rows without URL and time appended with their defaults, one task read back."""
    path = scratch_path(spark, "results")
    ST.append_results(results(spark, sf_dir).select("task_id", "result_id", "status_code"), path)
    return ST.read_results(spark, path, 42)


@query("task_configs_latest", """
SELECT o_custkey AS task_id, max_by(CAST(o_orderkey AS VARCHAR), {'t': o_orderdate, 'c': CAST(o_orderkey AS VARCHAR)}) AS config, max(o_orderdate) AS created_at FROM orders GROUP BY 1""")
def task_configs_latest(spark, sf_dir):
    """orders as versions of a customer's configuration, stored as JSON."""
    path = scratch_path(spark, "configs")
    versions = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderkey").alias("config"))
    ST.save_configs(versions, path)
    return ST.load_configs(spark, path).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("export_manifest", "SELECT f AS format, (SELECT count(*) FROM customer) AS records, true AS ok FROM (SELECT unnest(['json', 'csv', 'parquet']) AS f)")
def export_manifest(spark, sf_dir):
    written = EX.export(table(spark, sf_dir, "customer"), scratch_path(spark, "export"), ["json", "csv", "xlsx", "parquet"])
    return written.select("format", "records", "ok")


@query("export_csv_roundtrip", "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_acctbal, NULL, NULL, NULL, s_nationkey, s_name FROM supplier")
def export_csv_roundtrip(spark, sf_dir):
    """Records of two shapes in one CSV, columns sorted, gaps empty."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey"), "s_name")
    path = scratch_path(spark, "csv")
    EX.write_csv(c.unionByName(s, allowMissingColumns=True), path)
    return EX.read_csv(spark, path, "c_acctbal double, c_custkey long, c_mktsegment string, c_name string, c_nationkey int, s_name string")


@query("export_statistics", "SELECT 2 AS total_exports, 4 AS total_files, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS total_records, 'csv json parquet' AS formats_used")
def export_statistics(spark, sf_dir):
    base = scratch_path(spark, "exports")
    first = EX.export(table(spark, sf_dir, "customer"), f"{base}/customer", ["json", "csv", "parquet"])
    second = EX.export(table(spark, sf_dir, "supplier"), f"{base}/supplier", ["parquet"])
    stats = RP.export_stats(first.unionByName(second))
    return stats.select(F.col("total_exports").cast("int"), F.col("total_files").cast("int"), "total_records",
                        F.array_join("formats_used", " ").alias("formats_used"))


@query("task_log_roundtrip", """
SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, 'task ' || user_id || ': ' || event_type AS value FROM events
UNION ALL SELECT -1, row_number() OVER (ORDER BY event_id), 'task 8: ' || event_type FROM events WHERE user_id = 8""")
def task_log_roundtrip(spark, sf_dir):
    """Log lines per task written and read back; the log of task 8 once more by its id, as task -1."""
    path = scratch_path(spark, "task-logs")
    lines = running(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", F.concat(
        F.lit("task "), F.col("user_id"), F.lit(": "), F.col("event_type")).alias("value")), ["task_id"], ["event_id"], count="line")
    LO.write_task_log(lines, path, buckets=4)
    one = LO.read_task_log(spark, path, task_id=8)
    return LO.read_task_log(spark, path).unionByName(one.withColumn("task_id", F.lit(-1).cast("long")))


# Files whose bytes are known: a text file for each part, each line with its line end.
_PARTS_SQL = """(SELECT 'logs' AS category, event_id % 4 AS part, sum(strlen('task ' || user_id || ': ' || event_type) + 1)::BIGINT AS length FROM events GROUP BY 2
  UNION ALL SELECT 'results', c_custkey % 5, sum(strlen(c_name || ' ' || c_mktsegment) + 1)::BIGINT FROM customer GROUP BY 2)"""


def _stored_files(spark, sf_dir):
    base = scratch_path(spark, "files")
    lines = {
        "logs": table(spark, sf_dir, "events").select(
            (F.col("event_id") % 4).alias("part"), F.concat(F.lit("task "), F.col("user_id"), F.lit(": "), F.col("event_type")).alias("value")),
        "results": table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("part"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("value"))}
    for category, df in lines.items():
        # One file a part needs one task a part: at this many rows a file may hold them.
        df.repartition(5, "part").write.partitionBy("part").text(f"{base}/{category}")
    return ST.file_inventory(spark, {c: f"{base}/{c}" for c in lines})


@query("storage_statistics", f"""
SELECT category, count(*) AS file_count, sum(length)::BIGINT AS total_size, round(sum(length) / 1048576, 2) AS total_size_mb
FROM {_PARTS_SQL} GROUP BY ROLLUP (category)""")
def storage_statistics(spark, sf_dir):
    return RP.storage_stats(_stored_files(spark, sf_dir))


@query("storage_newest_files", f"SELECT category, length FROM {_PARTS_SQL} WHERE category = 'results'")
def storage_newest_files(spark, sf_dir):
    """The five files of the category written last."""
    return RP.newest_files(_stored_files(spark, sf_dir), 5).select("category", "length")


@query("retention", "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS removed, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS kept FROM events")
def retention(spark, sf_dir):
    return RP.retention_report(table(spark, sf_dir, "events"), "ts", RP.KEEP_DAYS["exports"], F.lit("2024-01-27").cast("timestamp_ntz"))


_SYSTEM = f"""
SELECT 'proxy_pool' AS component, 'total' AS metric, count(*)::DOUBLE AS value FROM {_POOL_SQL}
UNION ALL SELECT 'proxy_pool', s, (SELECT count(*) FROM {_POOL_SQL} WHERE status = s)::DOUBLE FROM (SELECT unnest(['active', 'inactive', 'banned', 'timeout']) AS s)
UNION ALL SELECT 'proxy_pool', 'average_response_time', round(avg(response_time), 6) FROM {_POOL_SQL}
UNION ALL SELECT 'downloads', 'total_requests', count(*) FROM events
UNION ALL SELECT 'downloads', 'successful_requests', count(*) FROM {FETCH_LOG_SQL} WHERE status_code = 200
UNION ALL SELECT 'downloads', 'failed_requests', count(*) FROM {FETCH_LOG_SQL} WHERE status_code IS DISTINCT FROM 200
UNION ALL SELECT 'downloads', 'success_rate', round(avg(CASE WHEN status_code = 200 THEN 1 ELSE 0 END), 6) FROM {FETCH_LOG_SQL}
UNION ALL SELECT 'downloads', 'average_response_time', round(avg(response_time), 6) FROM {FETCH_LOG_SQL}
UNION ALL SELECT 'tasks', 'total_tasks', count(*) FROM orders
UNION ALL SELECT 'tasks', 'running', count(*) FROM {TASKS_SQL} WHERE status = 'running'"""


@query("system_statistics", _SYSTEM)
def system_statistics(spark, sf_dir):
    task_row = tasks(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_tasks"), F.count_if(F.col("status") == "running").alias("running"))
    return rounded(RP.system_report({
        "proxy_pool": PO.pool_stats(_pool(spark, sf_dir)), "downloads": L.download_stats(fetch_log(spark, sf_dir)), "tasks": task_row}), "value")


_RATE_SQL = f"(SELECT avg(CASE WHEN status_code = 200 THEN 1 ELSE 0 END) AS r FROM {FETCH_LOG_SQL})"


@query("system_health", f"""
SELECT 'proxy_pool' AS component, CASE WHEN a > 0 THEN 'healthy' ELSE 'warning' END AS status, a::DOUBLE AS detail FROM (SELECT count(*) FILTER (status = 'active') AS a FROM {_POOL_SQL})
UNION ALL SELECT 'downloads', CASE WHEN r >= 0.5 THEN 'healthy' ELSE 'unhealthy' END, round(r, 6) FROM {_RATE_SQL}
UNION ALL SELECT 'overall', CASE WHEN r >= 0.5 THEN 'healthy' ELSE 'unhealthy' END, NULL FROM {_RATE_SQL}""")
def system_health(spark, sf_dir):
    pool, downloads = PO.pool_stats(_pool(spark, sf_dir)), L.download_stats(fetch_log(spark, sf_dir))
    return rounded(RP.health({
        "proxy_pool": (pool, "active", F.when(F.col("active") > 0, "healthy").otherwise("warning")),
        "downloads": (downloads, "success_rate", F.when(F.col("success_rate") >= 0.5, "healthy").otherwise("unhealthy"))}), "detail")


# The steps above as one job.
_JOB_SQL = rf"""
WITH p AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages),
d AS (SELECT *, row_number() OVER (PARTITION BY {sql_normalized('url')} ORDER BY page_id) AS rn FROM p WHERE title <> '' AND length(title) <= 200)
SELECT {sql_url_part('url', 'authority')} AS domain, count(*) AS records FROM d WHERE rn = 1 GROUP BY 1"""


@query("crawl_job", _JOB_SQL)
def crawl_job(spark, sf_dir):
    """extract -> clean -> validate -> fingerprint -> first seen -> per domain."""
    rules = {n: VAL.SCHEMAS["basic_webpage"][n] for n in ("title", "url")}
    return run_steps(pages(spark, sf_dir), {
        "extract": lambda df: X.extract_fields(df, {"title": "title"}).withColumn("title", F.col("title")[0]),
        "validate": lambda df: VAL.split(VAL.validate(df, rules))[0],
        "fingerprint": R.with_fingerprint,
        "dedup": lambda df: R.first_seen(df, "fp", ["page_id"]),
        "count": lambda df: df.groupBy(domain_of("url").alias("domain")).agg(F.count(F.lit(1)).alias("records")),
    })
