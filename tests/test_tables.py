"""Tasks, pools, reports, stores and exports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trawlframe.operators import linkgraph as LG
from trawlframe.operators import pools as PO
from trawlframe.operators import reports as RP
from trawlframe.operators import tasks as Q
from trawlframe.operators.steps import StepLog, run_steps
from trawlframe.sources import exports as EX
from trawlframe.sources import logs as LO
from trawlframe.sources import store as ST


def at(text):
    return F.lit(text).cast("timestamp")


def test_due_schedule_entries(spark):
    rows = [(1, "one_time", None, None, "11:59", "pending"), (2, "one_time", None, None, "12:01", "pending"),
            (3, "interval", 600, "11:50", None, "pending"), (4, "interval", 600, "11:51", None, "pending"),
            (5, "interval", 600, None, None, "pending"), (6, "cron", None, None, None, "pending"),
            (7, "cron", None, "11:00", None, "pending"), (8, "interval", 600, None, None, "running"),
            (9, "one_time", None, None, None, "pending")]
    day = lambda t: None if t is None else f"2024-01-01 {t}:00"
    df = spark.createDataFrame([(i, k, s, day(a), day(b), st) for i, k, s, a, b, st in rows],
                               "task_id int, schedule_type string, interval_seconds int, last_run string, next_run string, status string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("last_run", "next_run")})
    due = Q.due(df, at("2024-01-01 12:00:00")).collect()
    assert sorted(r["task_id"] for r in due) == [1, 3, 5, 6]
    assert {r["next_run"] for r in due if r["schedule_type"] == "interval"} == {datetime(2024, 1, 1, 12, 10)}


def test_transitions_and_progress(spark):
    tasks = spark.createDataFrame([(1, "pending"), (2, "running"), (3, "success")], "task_id int, status string")
    commands = spark.createDataFrame([(1, "start"), (1, "stop"), (2, "stop"), (3, "cancel"), (2, "cancel"), (9, "start")], "task_id int, action string")
    got = {(r["task_id"], r["action"]): (r["new_status"], r["accepted"], r["error"]) for r in Q.apply_actions(tasks, commands).collect()}
    assert got == {(1, "start"): ("running", True, None), (1, "stop"): ("pending", False, "conflict"), (2, "stop"): ("cancelled", True, None),
                   (3, "cancel"): ("success", False, "conflict"), (2, "cancel"): ("cancelled", True, None), (9, "start"): (None, False, "not_found")}
    stored = spark.createDataFrame([(1, 0.0), (2, 0.5)], "task_id int, progress double").withColumn("updated_at", at("2024-01-01"))
    rows = Q.update_progress(stored, spark.createDataFrame([(1, 0.7)], "task_id int, progress double"), at("2024-02-01")).orderBy("task_id").collect()
    assert [(r["progress"], r["updated_at"].month) for r in rows] == [(0.7, 2), (0.5, 1)]


def test_listing_page_and_distribution(spark):
    tasks = spark.createDataFrame([(i, "pending" if i % 2 else "failed", i) for i in range(30)], "task_id int, status string, h int").withColumn(
        "created_at", at("2024-01-01") + F.make_dt_interval(hours=F.col("h")))
    rows = Q.page(tasks, limit=3, offset=2, status="pending").collect()
    assert [(r["task_id"], r["total"]) for r in rows] == [(25, 15), (23, 15), (21, 15)]
    assert Q.first_and_rest(tasks, 20).first()["more"] == 10
    with pytest.raises(ValueError):
        Q.page(tasks, limit=0)
    counts = {r["metric"]: r["value"] for r in Q.status_distribution(tasks, at("2024-01-02 05:00:00")).collect()}
    assert counts == {"status_pending": 15, "status_failed": 15, "status_running": 0, "status_success": 0, "status_cancelled": 0,
                      "total_tasks": 30, "recent_24h_tasks": 25}
    one = spark.createDataFrame([("completed",), ("failed",)], "s string").select(Q.canonical_status(F.col("s")).alias("s")).collect()
    assert [r["s"] for r in one] == ["success", "failed"]


def test_remaining_after_stop(spark):
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "fp string")
    left = Q.remaining(key("a", "b", "c"), key("a", "a"), key("b", "b"))
    assert {(r["fp"], r["errors"]) for r in left.collect()} == {("b", 2), ("c", 0)}


def test_proxy_pool(spark):
    pool = spark.createDataFrame([("a", "active", 1.0, 8, 2), ("b", "banned", 2.0, 9, 0), ("c", "timeout", 3.0, 0, 0), ("d", "active", 0.0, 79, 21)],
                                 "url string, status string, response_time double, success_count long, failure_count long")
    assert [r["url"] for r in PO.usable(pool).collect()] == ["a"]
    assert tuple(PO.cleanup_report(pool).first()) == (1, 3)
    assert tuple(PO.pool_stats(pool).first()) == (4, 2, 0, 1, 1, 1.5)
    assert PO.pool_stats(pool.limit(0)).first()["average_response_time"] == 0


def test_cookie_files(spark, tmp_path):
    body = '{"domain": "%s", "source": "s", "cookies": {"k": "%s"}, "created_at": "2024-01-01T00:00:00", "expires_at": "%s"}'
    files = {"x_1.json": body % ("x", 1, "2024-03-01T00:00:00"), "x_2.json": body % ("x", 2, "2024-01-15T00:00:00.5"), "y.json": "{broken",
             "z.json": '{"domain": "z"}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    sets = PO.read_cookie_sets(spark, str(tmp_path))
    now = at("2024-02-01")
    assert tuple(PO.cookie_stats(sets, now).first()) == (4, 2, 1, 1)
    assert [r["cookies"] for r in PO.valid_sets(sets, now, "x").collect()] == [{"k": "1"}]
    assert PO.discarded_sets(sets, now).count() == 3
    requests = spark.createDataFrame([("x",), ("q",)], "domain string")
    joined = {r["domain"]: r["cookies"] for r in PO.with_cookies(requests, PO.newest_valid_set(sets, now)).collect()}
    assert joined == {"x": {"k": "1"}, "q": None}


def test_lease_report(spark):
    df = spark.createDataFrame([("p", 1, 100, None), ("p", 2, 0, None), ("q", 3, 0, 5)], "resource string, lease_id int, a long, r long").select(
        "resource", "lease_id", F.timestamp_seconds("a").alias("leased_at"), F.timestamp_seconds("r").alias("released_at"))
    rows = {r["resource"]: (r["status"], r["usage_count"], r["expired_leases"]) for r in PO.lease_report(df, F.timestamp_seconds(F.lit(120)), 60).collect()}
    assert rows == {"p": ("in_use", 2, 1), "q": ("idle", 1, 0)}


def test_logs(spark, tmp_path):
    (tmp_path / "app.log").write_text('{"message": "done", "timestamp": "2025-09-25T12:56:13.101737", "level": "INFO", "module": "m", "status": 200, '
                                      '"response_time": 1.03, "task_id": "t"}\nnot json\n{"message": "bad", "level": "ERROR", "timestamp": "2025-09-26T00:00:00"}\n')
    (tmp_path / "app.txt").write_text("2025-09-24 11:25:19,862 [INFO] a.b: [S] created task=1\n  continued\n2025-09-24 11:30:22,530 [WARNING] a.b: x: y\n")
    log = LO.read_json_log(spark, str(tmp_path / "app.log"))
    assert log.where("readable").count() == 2 and log.where("not readable").count() == 1
    assert RP.search_log(log, task_id="t", level="INFO").first()["response_time"] == 1.03
    assert tuple(RP.top_errors(log).first()) == ("bad", 1)
    assert RP.log_counts(log.where("readable")).count() == 2
    text = LO.read_text_log(spark, str(tmp_path / "app.txt")).collect()
    assert [(r["level"], r["logger"], r["message"]) for r in text] == [("INFO", "a.b", "[S] created task=1"), ("WARNING", "a.b", "x: y")]
    assert text[0]["ts"] == datetime(2025, 9, 24, 11, 25, 19, 862000)


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([(t, f"/{i}", i) for t in (1, 2) for i in range(25)], "task_id long, url string, n int")
    path = str(tmp_path / "results")
    ST.save_results(rows, path, ["n"], F.lit("2024-01-01T00:00:00"), max_rows=10)
    envelopes = spark.read.json(path)
    assert sorted(r["result_count"] for r in envelopes.where("task_id = 1").collect()) == [5, 10, 10]
    bucket = next((tmp_path / "results").rglob("bucket=*"))
    (bucket / "broken.json").write_text('{"task_id": 1, "results": [')
    schema = "url string, n int"
    assert sorted(map(tuple, ST.load_results(spark, path, schema).collect())) == sorted(map(tuple, rows.collect()))
    assert ST.load_results(spark, path, schema, task_id=2).count() == 25


def test_result_store_and_configs(spark, tmp_path):
    path = str(tmp_path / "store")
    ST.append_results(spark.createDataFrame([(1, "/a", None)], "task_id long, url string, status_code int"), path)
    ST.append_results(spark.createDataFrame([(1, 200), (2, 500)], "task_id long, status_code int"), path)
    rows = ST.read_results(spark, path, 1).select("url", "status_code", "response_time", "data").collect()
    assert sorted(map(tuple, rows)) == [("", 200, 0.0, "{}"), ("/a", 0, 0.0, "{}")]
    assert ST.read_table(spark, path, ["task_id"]).count() == 3
    configs = spark.createDataFrame([(1, "2024-01-01", '{"a":1}'), (1, "2024-01-02", '{"a":2}')], "task_id long, created_at string, config string")
    ST.save_configs(configs.withColumn("created_at", F.col("created_at").cast("timestamp")), str(tmp_path / "configs"))
    assert ST.load_configs(spark, str(tmp_path / "configs")).first()["config"] == '{"a":2}'


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', ["x", "y"]), (2, None, None)], "b int, a string, c array<string>")

    def failing(rows, path):
        raise RuntimeError("disk full")
    EX.register_writer("broken", failing)
    try:
        manifest = EX.export(df, str(tmp_path), ["json", "excel", "broken", "csv", "parquet"])
    finally:
        del EX.WRITERS["broken"]
    got = {r["format"]: (r["records"], r["ok"]) for r in manifest.collect()}
    assert got == {"json": (2, True), "broken": (0, False), "csv": (2, True), "parquet": (2, True)}
    back = EX.read_csv(spark, str(tmp_path / "csv"), "a string, b int, c string").orderBy("b").collect()
    assert [tuple(r) for r in back] == [('say "hi", ok', 1, '["x","y"]'), (None, 2, None)]
    stats = RP.export_stats(manifest).first()
    assert (stats["total_exports"], stats["total_files"], stats["total_records"], stats["formats_used"]) == (1, 3, 2, ["csv", "json", "parquet"])
    empty = EX.export(df.limit(0), str(tmp_path / "empty"), ["csv"]).first()
    assert not empty["ok"] and "no records" in empty["error"]


def test_storage_reports(spark, tmp_path):
    for category, sizes in (("logs", [10, 20]), ("results", [5])):
        (tmp_path / category).mkdir()
        for i, size in enumerate(sizes):
            (tmp_path / category / f"{i}.txt").write_text("x" * size)
    files = ST.file_inventory(spark, {c: str(tmp_path / c) for c in ("logs", "results")})
    stats = {r["category"]: (r["file_count"], r["total_size"]) for r in RP.storage_stats(files).collect()}
    assert stats == {"logs": (2, 30), "results": (1, 5), None: (3, 35)}
    assert RP.newest_files(files, 2).count() == 2
    lines = [(t, n, f"line {n}\nof {t}") for t in (1, 2) for n in range(1, 30)]
    for buckets in (3, 8):  # appends with another number of buckets are found as well
        LO.write_task_log(spark.createDataFrame(lines, "task_id long, line long, value string"), str(tmp_path / "tasklogs"), buckets)
        lines = [(t, n + 100, v) for t, n, v in lines]
    back = LO.read_task_log(spark, str(tmp_path / "tasklogs"), task_id=2).collect()
    assert [r["line"] for r in back] == [*range(1, 30), *range(101, 130)] and back[0]["value"] == "line 1\nof 2"
    assert LO.read_task_log(spark, str(tmp_path / "tasklogs")).count() == 116
    assert tuple(RP.retention_report(files, "modified", 7, F.current_timestamp()).first()) == (0, 3)


def test_health(spark):
    row = spark.createDataFrame([(0, 0.9)], "active long, rate double")
    report = RP.health({"pool": (row, "active", F.when(F.col("active") > 0, "healthy").otherwise("warning")),
                        "net": (row, "rate", F.when(F.col("rate") > 0.5, "healthy").otherwise("unhealthy"))})
    assert {r["component"]: r["status"] for r in report.collect()} == {"pool": "warning", "net": "healthy", "overall": "healthy"}


def test_link_graph(spark):
    edges = spark.createDataFrame([("http://a/", "http://B/x"), ("http://a/", "http://b/x"), ("http://b/x", "http://a")], "src_url string, dst_url string")
    pages = spark.createDataFrame([("http://a/",)], "url string")
    got = {r["url"]: (r["in_degree"], r["crawled"]) for r in LG.targets(edges, pages).collect()}
    assert got == {"http://b/x": (2, False), "http://a/": (1, True)}
    assert [r["url"] for r in LG.uncrawled(edges, pages).collect()] == ["http://b/x"]


def test_steps_are_counted(spark):
    log = StepLog()
    out = run_steps(spark.range(10), {"even": lambda d: d.where("id % 2 = 0"), "big": lambda d: d.where("id > 4")}, log)
    assert out.count() == 2 and log.rows() == {"even": 5, "big": 2}


def test_left_out_log_lines_are_counted(spark):
    lines = spark.createDataFrame([("2024-01-01 00:00:00,123 [INFO] a.b: ok",), ("  File x, line 3",), (None,)], "value string")
    assert tuple(LO.text_log_report(lines).first()) == (3, 1, 2) and LO.parse_text_log(lines).count() == 1


def test_unreadable_results_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "task_id long, url string")
    ST.save_results(rows, str(tmp_path / "r"), ["url"], F.lit("x"))
    (tmp_path / "r" / "buckets=64" / "bucket=1").mkdir(parents=True, exist_ok=True)
    (tmp_path / "r" / "buckets=64" / "bucket=1" / "part.json").write_text("{broken\n")
    assert tuple(ST.unreadable_results(spark, str(tmp_path / "r"), "url string").first()) == (3, 1)
    assert sorted(r["url"] for r in ST.load_results(spark, str(tmp_path / "r"), "url string").collect()) == ["a", "b"]


def test_envelopes_are_stored_compressed(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id % 50 AS task_id", "concat('http://h.example.com/part/', id) AS url", "200 AS status_code")
    ST.save_results(rows, str(tmp_path / "r"), ["url"], F.lit("x"), max_rows=100)
    files = [p for p in (tmp_path / "r").rglob("part-*") if p.is_file()]
    assert files and sum(p.stat().st_size for p in files) < 20_000 * 20
    assert sorted(ST.load_results(spark, str(tmp_path / "r"), "url string, status_code int").collect()) == sorted(rows.collect())
    assert tuple(ST.unreadable_results(spark, str(tmp_path / "r"), "url string").first()) == (200, 0)


def test_export_errors_are_kept_whole(spark, tmp_path):
    def fail(df, path):
        raise ValueError("x" * 2_000)
    EX.register_writer("broken", fail)
    try:
        row = EX.export(spark.range(1), str(tmp_path / "e"), ["broken"]).first()
    finally:
        EX.WRITERS.pop("broken")
    assert len(row["error"]) > 2_000


def test_unreadable_files_are_named(spark, tmp_path):
    import gzip
    (tmp_path / "r" / "a b").mkdir(parents=True)
    with gzip.open(tmp_path / "r" / "good.json.gz", "wt") as f:
        f.write('{"task_id": 1}\n')
    (tmp_path / "r" / "a b" / "bad.json.gz").write_bytes(b"no gzip")
    (tmp_path / "r" / "empty.json").write_bytes(b"")
    rows = ST.unreadable_files(spark, str(tmp_path / "r")).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in rows] == [("bad.json.gz", 7)]


def test_stored_results_are_sorted_by_task(spark, tmp_path):
    import pyarrow.parquet as pq
    spark.range(20_000).selectExpr("(id * 7919) % 5000 AS task_id", "concat('u', id) AS url").write.parquet(str(tmp_path / "in"))
    ST.append_results(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), buckets=2)
    for path in (tmp_path / "out").rglob("*.parquet"):
        ids = pq.ParquetFile(path).read(["task_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and ids
    one = ST.read_results(spark, str(tmp_path / "out"), 77)
    assert "EqualTo(task_id,77)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 4
