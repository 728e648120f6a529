"""The given tables read as crawl data, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.operators.extraction import page_links
from trawlframe.operators.requests import with_fingerprint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetches(events: DataFrame) -> DataFrame:
    """events as fetch outcomes per host; every third error is a lost connection without a status."""
    kind = F.col("event_type")
    status = (F.when(kind.isin("view", "click"), 200).when(kind == "signup", 404)
              .when(kind == "purchase", 429).when((kind == "error") & (F.col("event_id") % 3 != 0), 503))
    return events.select("event_id", "ts", F.col("user_id").alias("host"), status.alias("status_code"),
                         (F.col("value") / 100).alias("response_time"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches(table(spark, sf_dir, "events"))


FETCH_LOG_SQL = """(SELECT event_id, ts, user_id AS host,
  CASE WHEN event_type IN ('view','click') THEN 200 WHEN event_type='signup' THEN 404
       WHEN event_type='purchase' THEN 429 WHEN event_type='error' AND event_id % 3 <> 0 THEN 503 END AS status_code,
  value/100 AS response_time FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as crawl tasks."""
    o = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running")
              .when(F.col("o_orderstatus") == "F", "success"))
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.concat(F.lit("task-"), F.col("o_orderkey")).alias("name"),
        status.alias("status"), F.col("o_orderdate").alias("created_at"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"),
        F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("budget"))


TASKS_SQL = """(SELECT o_orderkey AS task_id, 'task-' || o_orderkey AS name,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' WHEN 'F' THEN 'success' END AS status,
  o_orderdate AS created_at, CAST(substr(o_orderpriority,1,1) AS INTEGER)-1 AS priority,
  o_custkey AS owner, o_totalprice AS budget FROM orders)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as task results; the line identifies a result within its task."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("task_id"),
        F.format_string("%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("result_id"),
        F.concat(F.lit("/part/"), F.col("l_partkey")).alias("url"),
        F.when(F.col("l_returnflag") == "R", 503).otherwise(200).alias("status_code"),
        F.col("l_quantity").alias("response_time"), F.col("l_shipdate").alias("created_at"))


RESULTS_SQL = """(SELECT l_orderkey AS task_id,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS result_id,
  '/part/' || l_partkey AS url, CASE WHEN l_returnflag='R' THEN 503 ELSE 200 END AS status_code,
  l_quantity AS response_time, l_shipdate AS created_at FROM lineitem)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages: page_id, src_url, pos, dst_url."""
    return page_links(pages(spark, sf_dir))


def sql_url_part(url: str, part: str) -> str:
    index = {"scheme": 1, "authority": 2, "path": 3, "query": 4}[part]
    grammar = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    return f"regexp_extract({url}, '{grammar}', {index})"


def sql_normalized(url: str, ignore: tuple[str, ...] = ()) -> str:
    """SQL text of the canonical form of a URL expression."""
    drop = " AND ".join(f"p.k <> '{name}'" for name in ignore) or "true"
    def decode(x: str) -> str:
        return f"url_decode(replace({x}, '+', ' '))"
    pairs = (f"list_transform(list_filter(string_split({sql_url_part(url, 'query')}, '&'), "
             "lambda x: regexp_matches(x, '^[^=]*=.')), "
             f"lambda x, i: {{'k': {decode('regexp_extract(x, $$^([^=]*)=$$, 1)')}, 'i': i, "
             f"'v': {decode('regexp_extract(x, $$^[^=]*=(.*)$$$$, 1)')}}})").replace("(.*)$$$$", "(.*)$$")
    query = (f"array_to_string(list_transform(list_sort(list_filter({pairs}, lambda p: {drop})), "
             "lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&')")
    path = f"regexp_replace({sql_url_part(url, 'path')}, ';[^/]*$', '')"
    return (f"(lower({sql_url_part(url, 'scheme')}) || '://' || lower({sql_url_part(url, 'authority')}) || "
            f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
            f"CASE WHEN coalesce({query}, '') = '' THEN '' ELSE '?' || {query} END)")


# All references as (page_id, src_url, i, href), then distinct absolute links.
EDGES_SQL = f"""(SELECT page_id, src_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INTEGER) AS pos, dst_url
  FROM (SELECT page_id, src_url, i,
          CASE WHEN href LIKE 'http%' THEN href
               WHEN href LIKE '//%' THEN {sql_url_part('src_url', 'scheme')} || ':' || href
               ELSE {sql_url_part('src_url', 'scheme')} || '://' || {sql_url_part('src_url', 'authority')} || href END AS dst_url
        FROM (SELECT page_id, url AS src_url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i
              FROM (SELECT page_id, url, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1),
                     lambda h: replace(h, '&amp;', '&')) AS hrefs FROM pages))
        WHERE href LIKE 'http%' OR href LIKE '/%')
  GROUP BY page_id, src_url, dst_url)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets as crawl requests with their default fingerprint."""
    e = edges(spark, sf_dir)
    return with_fingerprint(e.select("page_id", "pos", F.col("dst_url").alias("url")))


REQUESTS_SQL = f"""(SELECT page_id, pos, dst_url AS url,
  md5('METHOD:GET|URL:' || {sql_normalized('dst_url')}) AS fp FROM {EDGES_SQL})"""
