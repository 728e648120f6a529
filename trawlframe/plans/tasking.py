"""Frontier and task queries over orders (tasks) and lineitem (results)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.functions.urls import domain_of
from trawlframe.operators import extraction as X
from trawlframe.operators import frontier as W
from trawlframe.operators import tasks as Q
from trawlframe.plans.bindings import (
    EDGES_SQL, RESULTS_SQL, TASKS_SQL, edges, results, sql_url_part, table, tasks)
from trawlframe.plans.fetching import rounded
from trawlframe.plans.registry import query

_NOW = "2001-08-02 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _items(spark, sf_dir):
    """tasks as queue items, one queue per status."""
    return tasks(spark, sf_dir).select(
        F.col("status").alias("queue"), "priority", F.col("created_at").alias("ts"), F.col("task_id").alias("item_id"))


_ITEMS_SQL = f"(SELECT status AS queue, priority, created_at AS ts, task_id AS item_id FROM {TASKS_SQL})"
_RANKED_SQL = f"(SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority, ts, item_id) AS position FROM {_ITEMS_SQL})"


@query("frontier_ranked", f"SELECT * FROM {_RANKED_SQL}")
def frontier_ranked(spark, sf_dir):
    return W.ranked(_items(spark, sf_dir))


@query("frontier_next", f"SELECT * REPLACE (CAST(position AS INTEGER) AS position) FROM {_RANKED_SQL} WHERE position <= 10")
def frontier_next(spark, sf_dir):
    return W.next_items(_items(spark, sf_dir), 10)


@query("frontier_peek", f"SELECT * REPLACE (CAST(position AS INTEGER) AS position) FROM {_RANKED_SQL} WHERE position = 1")
def frontier_peek(spark, sf_dir):
    return W.next_items(_items(spark, sf_dir), 1)


@query("frontier_bounded", f"SELECT *, position > 1000 AS evicted FROM {_RANKED_SQL}")
def frontier_bounded(spark, sf_dir):
    return W.bounded(_items(spark, sf_dir), 1000)


@query("frontier_commands", f"""
WITH c AS (SELECT l_orderkey AS item_id, max_by({{'a': l_returnflag, 'p': l_linenumber % 5}},
             {{'t': l_shipdate, 'i': l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey}}) AS c FROM lineitem GROUP BY 1)
SELECT i.queue, CASE WHEN c.c.a = 'A' THEN c.c.p ELSE i.priority END AS priority, i.ts, i.item_id
FROM {_ITEMS_SQL} i LEFT JOIN c USING (item_id) WHERE c.c.a IS NULL OR c.c.a <> 'R'""")
def frontier_commands(spark, sf_dir):
    """lineitem as commands: returned lines remove, accepted ones re-prioritise."""
    r = table(spark, sf_dir, "lineitem")
    action = F.when(F.col("l_returnflag") == "R", "remove").when(F.col("l_returnflag") == "A", "update").otherwise("none")
    commands = r.select(
        F.col("l_orderkey").alias("item_id"), F.col("l_shipdate").alias("ts"),
        F.format_string("%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("command_id"),
        action.alias("action"), (F.col("l_linenumber") % 5).alias("priority"))
    return W.apply_commands(_items(spark, sf_dir), commands)


_WAIT = f"(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) / 1e6"


@query("queue_stats", f"""
SELECT queue, CAST(grouping(queue) AS INTEGER) AS is_total, count(DISTINCT q) AS queues, count(*) AS queue_size, false AS is_empty, count(*) >= 5000 AS is_full,
  round(avg(w), 3) AS average_wait_time, max(w) AS max_wait_time, min(w) AS min_wait_time, max(w) AS oldest_item_wait_time
FROM (SELECT queue, queue AS q, {_WAIT} AS w FROM {_ITEMS_SQL}) GROUP BY ROLLUP (queue)""")
def queue_stats(spark, sf_dir):
    return rounded(W.queue_stats(_items(spark, sf_dir), _now(), maxsize=5000), "average_wait_time", digits=3)


@query("processed_stats", f"""
SELECT queue, count(*) AS total_processed, count(*) FILTER (priority = 0) AS critical, count(*) FILTER (priority = 1) AS high,
  count(*) FILTER (priority = 2) AS normal, count(*) FILTER (priority = 3) AS low, count(*) FILTER (priority = 4) AS minimal,
  round(avg({_WAIT}), 3) AS average_wait_time, max({_WAIT}) AS max_wait_time, min({_WAIT}) AS min_wait_time FROM {_ITEMS_SQL} GROUP BY queue""")
def processed_stats(spark, sf_dir):
    return rounded(W.processed_stats(_items(spark, sf_dir), _now(), ["queue"]), "average_wait_time", digits=3)


@query("tasks_per_priority", f"""
SELECT CASE priority WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'NORMAL' WHEN 3 THEN 'LOW' ELSE 'MINIMAL' END AS priority_name,
  count(*) AS tasks, CAST(any_value(priority) AS INTEGER) AS priority FROM {TASKS_SQL} GROUP BY 1""")
def tasks_per_priority(spark, sf_dir):
    counted = tasks(spark, sf_dir).groupBy(W.priority_name(F.col("priority")).alias("priority_name")).agg(
        F.count(F.lit(1)).alias("tasks"))
    return counted.withColumn("priority", W.priority_value(F.col("priority_name")))


@query("politeness_plan", f"""
WITH p AS (SELECT page_id, pos, {sql_url_part('dst_url', 'authority')} AS host FROM {EDGES_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, pos) AS host_position FROM p),
w AS (SELECT *, CAST((host_position - 1) // 5 AS BIGINT) AS wave FROM r)
SELECT page_id, pos, host, host_position, wave, (host_position - 1) * 1.5::DOUBLE AS start_after,
  CAST((row_number() OVER (ORDER BY wave, host, page_id, pos) - 1) // 20 AS BIGINT) AS batch FROM w""")
def politeness_plan(spark, sf_dir):
    requests = edges(spark, sf_dir).select("page_id", "pos", domain_of("dst_url").alias("host"))
    return W.politeness_plan(requests, "host", ["page_id", "pos"], per_host=5, overall=20, delay_seconds=1.5)


@query("items_until_limit", f"""
WITH n AS (SELECT page_id, {sql_url_part('src_url', 'authority')} AS task, count(*) AS items FROM {EDGES_SQL} GROUP BY 1, 2)
SELECT page_id, task, items FROM (SELECT *, sum(items) OVER (PARTITION BY task ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS s FROM n)
WHERE s - items < 12""")
def items_until_limit(spark, sf_dir):
    """Per domain, its pages in order until 12 links were found."""
    per_page = edges(spark, sf_dir).groupBy("page_id", domain_of("src_url").alias("task")).agg(F.count(F.lit(1)).alias("items"))
    return X.until_max_items(per_page, "task", ["page_id"], "items", 12)


@query("task_urls", """
SELECT o_orderkey AS task_id, CAST(i - 1 AS INTEGER) AS pos, 'http://h' || o_custkey || '.example.com/' || CASE i WHEN 1 THEN 'a' ELSE 'b' END AS url
FROM orders, (SELECT unnest([1, 2]) AS i)""")
def task_urls(spark, sf_dir):
    host = F.concat(F.lit("http://h"), F.col("o_custkey"), F.lit(".example.com/"))
    with_urls = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.array(F.concat(host, F.lit("a")), F.concat(host, F.lit("b"))).alias("urls"))
    return Q.url_list(with_urls)


@query("task_by_id", f"SELECT * FROM {TASKS_SQL} WHERE task_id = 7")
def task_by_id(spark, sf_dir):
    return Q.by_id(tasks(spark, sf_dir), 7)


@query("tasks_newest_first", f"SELECT * FROM {TASKS_SQL} WHERE status = 'running' ORDER BY created_at DESC, task_id")
def tasks_newest_first(spark, sf_dir):
    return Q.newest_first(tasks(spark, sf_dir), "running")


@query("tasks_page", f"""
SELECT *, (SELECT count(*) FROM {TASKS_SQL} WHERE status = 'pending') AS total FROM {TASKS_SQL} WHERE status = 'pending'
ORDER BY created_at DESC, task_id LIMIT 50 OFFSET 100""")
def tasks_page(spark, sf_dir):
    return Q.page(tasks(spark, sf_dir), limit=50, offset=100, status="pending")


@query("tasks_numbered_page", f"""
SELECT *, (SELECT count(*) FROM {TASKS_SQL}) AS total FROM {TASKS_SQL} ORDER BY created_at DESC, task_id LIMIT 20 OFFSET 40""")
def tasks_numbered_page(spark, sf_dir):
    return Q.numbered_page(tasks(spark, sf_dir), 3, 20)


@query("tasks_first_and_rest", f"""
SELECT *, greatest((SELECT count(*) FROM {TASKS_SQL}) - 20, 0) AS more FROM {TASKS_SQL} ORDER BY created_at DESC, task_id LIMIT 20""")
def tasks_first_and_rest(spark, sf_dir):
    return Q.first_and_rest(tasks(spark, sf_dir), 20)


@query("task_results_latest", f"SELECT * FROM {RESULTS_SQL} WHERE task_id = 42 ORDER BY created_at DESC, result_id LIMIT 3")
def task_results_latest(spark, sf_dir):
    return Q.latest_results(results(spark, sf_dir), 42, 3)


@query("task_results_latest_each", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, result_id) AS INTEGER) AS rank FROM {RESULTS_SQL}) WHERE rank <= 2""")
def task_results_latest_each(spark, sf_dir):
    return Q.latest_results_per_task(results(spark, sf_dir), 2)


@query("task_responses", f"SELECT task_id, name, status, created_at FROM {TASKS_SQL}")
def task_responses(spark, sf_dir):
    return Q.response(tasks(spark, sf_dir))


@query("task_transitions", f"""
WITH c AS (SELECT o_orderkey * 2 AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' ELSE 'cancel' END AS action FROM orders),
j AS (SELECT c.*, t.status, (action = 'start' AND status = 'pending') OR (action = 'stop' AND status = 'running')
        OR (action = 'cancel' AND status IN ('pending', 'running')) AS ok FROM c LEFT JOIN {TASKS_SQL} t USING (task_id))
SELECT task_id, action, status AS old_status, CASE WHEN ok AND action = 'start' THEN 'running' WHEN ok THEN 'cancelled' ELSE status END AS new_status,
  coalesce(ok, false) AS accepted, CASE WHEN status IS NULL THEN 'not_found' WHEN NOT ok THEN 'conflict' END AS error FROM j""")
def task_transitions(spark, sf_dir):
    """A command per task; the even numbering leaves some without a task."""
    t = tasks(spark, sf_dir)
    k = F.col("task_id") % 3
    commands = t.select((F.col("task_id") * 2).alias("task_id"),
                        F.when(k == 0, "start").when(k == 1, "stop").otherwise("cancel").alias("action"))
    return Q.apply_actions(t, commands)


@query("task_progress_updates", f"""
SELECT t.task_id, coalesce(u.p, 0.0)::DOUBLE AS progress, CASE WHEN u.p IS NOT NULL THEN TIMESTAMP '{_NOW}' ELSE created_at END AS updated_at
FROM {TASKS_SQL} t LEFT JOIN (SELECT l_orderkey AS task_id, round(avg(l_discount), 6) AS p FROM lineitem GROUP BY 1) u USING (task_id)""")
def task_progress_updates(spark, sf_dir):
    stored = tasks(spark, sf_dir).select("task_id", F.lit(0.0).alias("progress"), F.col("created_at").alias("updated_at"))
    updates = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.round(F.avg("l_discount"), 6).alias("progress"))
    return Q.update_progress(stored, updates, _now())


_DELETED_SQL = f"(SELECT task_id FROM {TASKS_SQL} WHERE status = 'success')"


@query("tasks_after_delete", f"SELECT task_id, status FROM {TASKS_SQL} WHERE task_id NOT IN (SELECT task_id FROM {_DELETED_SQL})")
def tasks_after_delete(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return Q.delete_tasks(t, t.where("status = 'success'")).select("task_id", "status")


@query("results_after_delete", f"SELECT task_id, result_id FROM {RESULTS_SQL} WHERE task_id NOT IN (SELECT task_id FROM {_DELETED_SQL})")
def results_after_delete(spark, sf_dir):
    return Q.delete_tasks(results(spark, sf_dir), tasks(spark, sf_dir).where("status = 'success'")).select("task_id", "result_id")


@query("task_status_view", f"""
SELECT t.task_id, t.name, t.status, count(r.result_id) AS results_count FROM {TASKS_SQL} t LEFT JOIN {RESULTS_SQL} r USING (task_id) GROUP BY ALL""")
def task_status_view(spark, sf_dir):
    return Q.status_view(tasks(spark, sf_dir), results(spark, sf_dir))


@query("task_progress", f"""
SELECT t.task_id, 8 AS total_count, count(r.result_id) AS done_count, count(*) FILTER (r.status_code = 200) AS success_count,
  count(r.result_id) FILTER (r.status_code IS DISTINCT FROM 200) AS failed_count, round(count(r.result_id) / 8, 6) AS progress
FROM {TASKS_SQL} t LEFT JOIN {RESULTS_SQL} r USING (task_id) GROUP BY t.task_id""")
def task_progress(spark, sf_dir):
    expected = tasks(spark, sf_dir).select("task_id", F.lit(8).alias("total_count"))
    return rounded(Q.task_progress(results(spark, sf_dir), expected), "progress")


@query("task_status_distribution", f"""
WITH t AS (SELECT * FROM {TASKS_SQL})
SELECT 'status_' || s AS metric, (SELECT count(*) FROM t WHERE status = s) AS value
FROM (SELECT unnest(['pending', 'running', 'success', 'failed', 'cancelled']) AS s)
UNION ALL SELECT 'total_tasks', count(*) FROM t
UNION ALL SELECT 'recent_24h_tasks', count(*) FROM t WHERE created_at >= TIMESTAMP '2001-07-31 12:00:00' - INTERVAL 24 HOURS""")
def task_status_distribution(spark, sf_dir):
    return Q.status_distribution(tasks(spark, sf_dir), F.lit("2001-07-31 12:00:00").cast("timestamp_ntz"))


@query("task_status_counts", f"SELECT status, count(*) AS tasks FROM {TASKS_SQL} GROUP BY status")
def task_status_counts(spark, sf_dir):
    return Q.status_counts(tasks(spark, sf_dir))


@query("schedule_due", f"""
WITH s AS (SELECT task_id, status, CASE priority WHEN 0 THEN 'one_time' WHEN 1 THEN 'cron' ELSE 'interval' END AS kind,
  owner * 3600 AS secs, CASE WHEN task_id % 4 <> 0 THEN created_at END AS last_run, created_at + INTERVAL 1 DAY AS next_run FROM {TASKS_SQL})
SELECT task_id, kind AS schedule_type, CASE WHEN kind = 'interval' THEN TIMESTAMP '1998-01-01' + to_seconds(secs) ELSE next_run END AS next_run
FROM s WHERE status = 'pending' AND CASE kind WHEN 'one_time' THEN next_run <= TIMESTAMP '1998-01-01' WHEN 'cron' THEN last_run IS NULL
  ELSE last_run IS NULL OR TIMESTAMP '1998-01-01' >= last_run + to_seconds(secs) END""")
def schedule_due(spark, sf_dir):
    t = tasks(spark, sf_dir)
    kind = F.when(F.col("priority") == 0, "one_time").when(F.col("priority") == 1, "cron").otherwise("interval")
    schedule = t.select("task_id", "status", kind.alias("schedule_type"), (F.col("owner") * 3600).alias("interval_seconds"),
                        F.when(F.col("task_id") % 4 != 0, F.col("created_at")).alias("last_run"),
                        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("next_run"))
    return Q.due(schedule, F.lit("1998-01-01").cast("timestamp_ntz")).select("task_id", "schedule_type", "next_run")


@query("schedule_listing", f"""
WITH s AS (SELECT task_id, status, CASE priority WHEN 0 THEN 'one_time' WHEN 1 THEN 'cron' ELSE 'interval' END AS kind, owner * 3600 AS secs,
  created_at::TIMESTAMP AS created, CASE WHEN task_id % 4 <> 0 THEN created_at::TIMESTAMP + INTERVAL 250 MILLISECONDS END AS last, created_at::TIMESTAMP + INTERVAL 1 DAY AS next FROM {TASKS_SQL})
SELECT task_id, 'task ' || task_id AS name, kind AS schedule_type, '{{"interval_seconds":' || secs || '}}' AS schedule_config, status,
  strftime(created, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(last, '%Y-%m-%dT%H:%M:%S.%f') AS last_run,
  CASE WHEN kind <> 'cron' THEN strftime(next, '%Y-%m-%dT%H:%M:%S') END AS next_run FROM s""")
def schedule_listing(spark, sf_dir):
    """Every schedule entry as it is shown."""
    t = tasks(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    kind = F.when(F.col("priority") == 0, "one_time").when(F.col("priority") == 1, "cron").otherwise("interval")
    return Q.schedule_listing(t.select(
        "task_id", F.concat(F.lit("task "), F.col("task_id")).alias("name"), kind.alias("schedule_type"),
        F.struct((F.col("owner") * 3600).alias("interval_seconds")).alias("schedule_config"), "status", "created_at",
        F.when(F.col("task_id") % 4 != 0, F.col("created_at") + F.expr("INTERVAL '0.250' SECOND")).alias("last_run"),
        F.when(kind != "cron", F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("next_run")))


@query("run_history", f"""
SELECT task_id, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS requests, count(*) FILTER (status_code = 200) AS successes,
  epoch_us(max(created_at))//1000000 - epoch_us(min(created_at))//1000000 AS duration_seconds, round(count(*) FILTER (status_code = 200) / count(*), 6) AS success_rate,
  '{{"requests":' || count(*) || ',"successes":' || count(*) FILTER (status_code = 200) || '}}' AS metrics FROM {RESULTS_SQL} GROUP BY task_id""")
def run_history(spark, sf_dir):
    return rounded(Q.run_history(results(spark, sf_dir), ["task_id"]), "success_rate")
