"""Links, URLs, fingerprints and duplicates over the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlframe.functions.urls import domain_of, normalize_url, resolve_href, url_part
from trawlframe.operators import extraction as X
from trawlframe.operators import requests as R
from trawlframe.plans.bindings import (
    EDGES_SQL, REQUESTS_SQL, edges, pages, requests, sql_normalized, sql_url_part, table)
from trawlframe.plans.registry import query
from trawlframe.sources.store import read_table


@query("link_edges", f"SELECT page_id, src_url, pos, dst_url FROM {EDGES_SQL}")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query("link_edges_parsed", f"SELECT page_id, src_url, pos, dst_url FROM {EDGES_SQL}")
def link_edges_parsed(spark, sf_dir):
    return X.parsed_references(pages(spark, sf_dir), "a::attr(href)")


@query("url_normalized", f"SELECT page_id, {sql_normalized('url')} AS normal FROM pages")
def url_normalized(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", normalize_url("url").alias("normal"))


@query("url_normalized_ignoring", f"SELECT page_id, {sql_normalized('url', ('ref', 'utm_source'))} AS normal FROM pages")
def url_normalized_ignoring(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", normalize_url("url", ignore_params=("ref", "utm_source")).alias("normal"))


@query("url_domains", f"SELECT {sql_url_part('url', 'authority')} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def url_domains(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(domain_of("url").alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("url_resolved", f"""
SELECT page_id, {sql_url_part('url', 'scheme')} || '://' || {sql_url_part('url', 'authority')} || '/b/c?x=1' AS folded,
       {sql_url_part('url', 'scheme')} || '://h.org/x' AS other_host FROM pages""")
def url_resolved(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", resolve_href("url", F.lit("/a/../b/./c?x=1#")).alias("folded"),
        resolve_href("url", F.lit("//h.org/x")).alias("other_host"))


@query("request_fingerprints", f"SELECT page_id, pos, url, fp FROM {REQUESTS_SQL}")
def request_fingerprints(spark, sf_dir):
    return requests(spark, sf_dir)


def _sql_json(pairs: list[tuple[str, str]]) -> str:
    body = " || ', ' || ".join(f"""'"{k}": "' || {v} || '"'""" for k, v in pairs)
    return f"('{{' || {body} || '}}')"


_EVENT_URL = "'http://api.example.com/v1?timestamp=' || event_id || '&kind=' || event_type"
_PRESET_SQL = f"""
SELECT event_id,
  md5('URL:http://api.example.com/v1?kind=' || event_type || '&timestamp=' || event_id) AS fp_basic,
  md5('METHOD:POST|URL:http://api.example.com/v1?kind=' || event_type || '|DATA:' || {_sql_json([('kind', 'event_type'), ('user', 'user_id')])}
      || '|HEADERS:' || {_sql_json([('accept', "'*/*'"), ('x-user', 'user_id')])}) AS fp_strict,
  md5('METHOD:POST|URL:http://api.example.com/v1?kind=' || event_type || '|DATA:' || {_sql_json([('kind', 'event_type'), ('nonce', 'event_id'), ('user', 'user_id')])}) AS fp_api,
  md5('METHOD:POST|URL:http://api.example.com/v1?kind=' || event_type || '&timestamp=' || event_id || '|DATA:' || {_sql_json([('kind', 'event_type'), ('nonce', 'event_id'), ('user', 'user_id')])}) AS fp_default
FROM events"""


@query("request_fingerprint_presets", _PRESET_SQL)
def request_fingerprint_presets(spark, sf_dir):
    """events as POST requests with payload and headers, under each preset."""
    e = table(spark, sf_dir, "events")
    text = lambda c: F.col(c).cast("string")
    url = F.concat(F.lit("http://api.example.com/v1?timestamp="), text("event_id"), F.lit("&kind="), F.col("event_type"))
    data = F.create_map(F.lit("user"), text("user_id"), F.lit("nonce"), text("event_id"), F.lit("kind"), F.col("event_type"))
    headers = F.create_map(F.lit("X-User"), text("user_id"), F.lit("User-Agent"), F.lit("a"), F.lit("Accept"), F.lit("*/*"))
    made = e.select("event_id", url.alias("url"), F.lit("post").alias("method"), headers.alias("headers"), data.alias("data"))
    return R.with_fingerprints(made, {f"fp_{p}": R.preset(p) for p in ("basic", "strict", "api", "default")}).drop("url", "method", "headers", "data")


@query("first_seen_requests", f"""
SELECT fp, url, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY page_id, pos) AS rn FROM {REQUESTS_SQL}) WHERE rn = 1""")
def first_seen_requests(spark, sf_dir):
    return R.first_seen(requests(spark, sf_dir), "fp", ["page_id", "pos"]).select("fp", "url", "page_id", "pos")


_SEEN_SQL = f"(SELECT DISTINCT fp FROM {REQUESTS_SQL} WHERE pos = 0)"


def _seen(spark, sf_dir):
    """First link of each page as the stored seen-set."""
    return requests(spark, sf_dir).where("pos = 0").select("fp").distinct()


@query("new_requests", f"""
SELECT fp, url FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY page_id, pos) AS rn FROM {REQUESTS_SQL})
WHERE rn = 1 AND fp NOT IN (SELECT fp FROM {_SEEN_SQL})""")
def new_requests(spark, sf_dir):
    return R.admit(requests(spark, sf_dir), _seen(spark, sf_dir), ["page_id", "pos"]).select("fp", "url")


@query("repeated_requests", f"SELECT page_id, pos, url FROM {REQUESTS_SQL} WHERE fp IN (SELECT fp FROM {_SEEN_SQL})")
def repeated_requests(spark, sf_dir):
    return R.already_seen(requests(spark, sf_dir), _seen(spark, sf_dir)).select("page_id", "pos", "url")


@query("seen_set_after_removal", f"""
SELECT DISTINCT fp FROM {REQUESTS_SQL} WHERE fp NOT IN (SELECT fp FROM {_SEEN_SQL})""")
def seen_set_after_removal(spark, sf_dir):
    return R.forget(requests(spark, sf_dir).select("fp").distinct(), _seen(spark, sf_dir))


@query("seen_set_newest", """
SELECT md5('METHOD:GET|URL:http://h' || user_id || '.example.com/') AS fp, max(ts) AS ts FROM events
GROUP BY user_id ORDER BY ts DESC, fp LIMIT 100""")
def seen_set_newest(spark, sf_dir):
    """Bounded seen-set: the 100 fingerprints accepted last."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    url = F.concat(F.lit("http://H"), F.col("user_id").cast("string"), F.lit(".example.com"))
    return R.newest(e.select(R.fingerprint(url).alias("fp"), "ts"), 100)


@query("dedup_statistics", f"""
SELECT 'table' AS backend, count(*) AS requests, count(DISTINCT fp) AS total_fingerprints,
  count(*) - count(DISTINCT fp) AS duplicates, 20000 AS max_size, 3600 AS ttl FROM {REQUESTS_SQL}""")
def dedup_statistics(spark, sf_dir):
    return R.dedup_stats(requests(spark, sf_dir), R.preset("api"))


@query("duplicate_report", f"""
WITH r AS (SELECT md5('URL:' || {sql_normalized('url', ('ref', 'utm_source'))}) AS fp, url FROM {REQUESTS_SQL}),
g AS (SELECT fp, count(*) AS group_size, count(DISTINCT url) AS variants FROM r GROUP BY fp HAVING count(*) > 1)
SELECT r.fp, r.url, count(*) AS n, any_value(group_size) AS group_size, any_value(variants) AS variants
FROM r JOIN g USING (fp) GROUP BY r.fp, r.url""")
def duplicate_report(spark, sf_dir):
    config = R.FingerprintConfig(method=False, data=False, ignore_params=("ref", "utm_source"))
    return R.duplicate_report(R.with_fingerprint(requests(spark, sf_dir).drop("fp"), config))


_TTL_SQL = """
WITH RECURSIVE t AS (
  SELECT user_id, event_id, ts, epoch_us(ts)//1000000 AS s,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000000, ts, event_id) AS rn FROM events),
walk AS (
  SELECT user_id, event_id, ts, rn, s AS last, true AS accepted FROM t WHERE rn = 1
  UNION ALL
  SELECT t.user_id, t.event_id, t.ts, t.rn, CASE WHEN t.s - w.last > 36000 THEN t.s ELSE w.last END, t.s - w.last > 36000
  FROM walk w JOIN t ON t.user_id = w.user_id AND t.rn = w.rn + 1)
SELECT user_id, event_id, ts FROM walk WHERE accepted"""


@query("requests_accepted_with_ttl", _TTL_SQL)
def requests_accepted_with_ttl(spark, sf_dir):
    """events as requests of one fingerprint per user, remembered for ten hours."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return R.accept_with_ttl(e, "user_id", "ts", "event_id", 36_000)


@query("crawl_dedup_by_domain", f"""
SELECT {sql_url_part('url', 'authority')} AS domain, count(*) AS links, count(DISTINCT fp) AS distinct_targets,
  count(*) - count(DISTINCT fp) AS duplicates FROM {REQUESTS_SQL} GROUP BY 1""")
def crawl_dedup_by_domain(spark, sf_dir):
    """pages -> links -> normalised, fingerprinted -> per domain. Links are
    counted per fingerprint first, so a hot target is one row per map task."""
    r = requests(spark, sf_dir)
    per_target = r.groupBy("fp", domain_of("url").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return per_target.groupBy("domain").agg(
        F.sum("n").alias("links"), F.count(F.lit(1)).alias("distinct_targets"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("pages_source", "SELECT page_id, url, length(html) AS html_length FROM pages")
def pages_source(spark, sf_dir):
    stored = read_table(spark, f"{sf_dir}/pages.parquet", ["page_id", "url", "html"])
    return stored.select("page_id", "url", F.length("html").cast("long").alias("html_length"))


@query("distinct_link_targets", f"SELECT DISTINCT dst_url FROM {EDGES_SQL}")
def distinct_link_targets(spark, sf_dir):
    return edges(spark, sf_dir).select("dst_url").distinct()


@query("frontier_minus_seen", f"""
SELECT dst_url AS url FROM {EDGES_SQL} WHERE pos > 0 EXCEPT SELECT dst_url FROM {EDGES_SQL} WHERE pos = 0""")
def frontier_minus_seen(spark, sf_dir):
    """Set difference: later links that are no page's first link."""
    links = edges(spark, sf_dir)
    frontier = links.where("pos > 0").select(F.col("dst_url").alias("url")).distinct()
    return R.unseen(frontier, links.where("pos = 0").select(F.col("dst_url").alias("url")).distinct(), "url")


@query("next_page_chains", """
WITH g AS (SELECT page_id, page_id // 6 AS g, row_number() OVER (PARTITION BY page_id // 6 ORDER BY page_id) AS rn FROM pages)
SELECT 'http://chain.example/' || s.page_id AS start_url, CAST(t.rn AS INTEGER) AS depth, 'http://chain.example/' || t.page_id AS url
FROM g s JOIN g t ON s.g = t.g AND s.rn = 1 WHERE t.rn <= 5""")
def next_page_chains(spark, sf_dir):
    """Chains over the pages, six by six, each with a link to the next one; at most five pages of a chain."""
    six = Window.partitionBy(F.floor(F.col("page_id") / 6)).orderBy("page_id")
    place = F.concat(F.lit("http://chain.example/"), F.col("page_id"))
    linked = pages(spark, sf_dir).select("page_id", place.alias("url"), F.concat(
        F.coalesce(F.concat(F.lit('<a class="next" href="'), F.lead(place).over(six), F.lit('">next</a>')), F.lit("")), "html").alias("html"),
        F.row_number().over(six).alias("n"))
    return X.follow_pages(linked.drop("n"), "a.next::attr(href)", linked.where("n = 1").select("url"), 5)
