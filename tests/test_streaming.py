"""Streams read one file per micro-batch must end in the batch result."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.check_oracle import rows_of
from trawlframe.operators import fetchlog as L
from trawlframe.operators import requests as R
from trawlframe.streaming import breaker, dedup, held, ingest, levels, metrics


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = sorted((0 if rng.random() < 0.5 else rng.randrange(1, 6), rng.randrange(20_000), 503 if rng.random() < 0.6 else 200) for _ in range(900))
    rows = [(h, i, s, c, 0.5) for i, (h, s, c) in enumerate(sorted(rows, key=lambda r: r[1]))]
    df = spark.createDataFrame(rows, "host int, event_id int, s long, status_code int, response_time double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path = str(tmp_path_factory.mktemp("log"))
    # Three files one after the other that overlap in time: every third row comes a file late, none more than two hours.
    late = F.when(F.col("event_id") % 3 == 0, 200).otherwise(0)
    for i in range(4):
        df.where(F.floor((F.col("event_id") + late) / 300) == i).coalesce(1).write.mode("append").parquet(path)
    return df, path


def passed(rows, log, lateness):
    """Rows that a watermark this many seconds behind the last one has passed."""
    last = log.agg(F.max("ts")).first()[0]
    return rows.where(F.col("ts") < F.lit(last) - F.make_dt_interval(secs=F.lit(lateness)))


@pytest.fixture
def stream(spark, log):
    return lambda: spark.readStream.schema(log[0].schema).option("maxFilesPerTrigger", 1).parquet(log[1])


@pytest.fixture
def run(tmp_path):
    return lambda df, mode="append": ingest.to_table(df, str(tmp_path / "out"), str(tmp_path / "state"), mode)


def test_ttl(log, stream, run):
    got = run(dedup.accept_with_ttl(stream(), "host", "ts", "event_id", 500, "2 hours"))
    want = passed(R.accept_with_ttl(log[0], "host", "ts", "event_id", 500), log[0], 7_200)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect()) != []


def test_breaker(log, stream, run):
    got = run(breaker.breaker_states(stream(), threshold=3, recovery_seconds=300, lateness="2 hours"))
    want = passed(L.breaker_replay(log[0], threshold=3, recovery_seconds=300), log[0], 7_200)
    pick = lambda df: sorted((r["event_id"], r["decision"], r["state"]) for r in df.collect())
    assert pick(got) == pick(want) != []


def test_idle_hosts_are_forgotten(spark, tmp_path):
    """Three failures, then a day of nothing: with an idle time the host starts afresh."""
    rows = [[(1, i, i + 10, 503) for i in range(3)] + [(2, 3, 50_000, 200)], [(2, 4, 60_000, 200)], [(1, 5, 90_000, 503), (2, 6, 99_000, 200)]]
    for part in rows:
        spark.createDataFrame(part, "host int, event_id int, s long, status_code int").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    found = {}
    for idle in (None, 3_600):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        states = breaker.breaker_states(source, threshold=3, recovery_seconds=60, idle_seconds=idle)
        out = ingest.to_table(states, str(tmp_path / f"out{idle}"), str(tmp_path / f"state{idle}"))
        found[idle] = {r["event_id"]: (r["decision"], r["state"]) for r in out.collect()}
    assert found[None][5] == ("trial", "open") and found[3_600][5] == ("accepted", "closed")


def test_dedup(log, stream, run):
    got = run(dedup.first_within(stream(), "host", "ts", "1 hour", "2 hours"))
    want = {(r["host"], r["ts"].replace(minute=0, second=0)) for r in log[0].collect()}
    assert sorted((r["host"], r["period"]) for r in got.collect()) == sorted(want)


def test_metrics_drop_nothing_but_open_windows(log, stream, run):
    got = {(r["host"], r["window_start"]): tuple(r)[3:] for r in run(metrics.windowed_metrics(stream(), "60 seconds", "2 hours")).collect()}
    want = {(r["host"], r["window_start"]): tuple(r)[3:] for r in metrics.windowed_metrics(log[0], "60 seconds").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = log[0].agg(F.max("ts")).first()[0]
    closed = {k for k in want if (last - k[1]).total_seconds() >= 7_260}
    assert closed <= set(got)


def test_progress(spark, log, stream, tmp_path):
    results = stream().withColumn("task_id", F.col("host"))
    got = ingest.run_progress(results, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    want = {r["host"]: (r["total_requests"], r["successful_requests"], r["failed_requests"]) for r in L.download_stats(log[0], ["host"]).collect()}
    assert {r["task_id"]: tuple(r)[1:] for r in got} == want


def test_ingest_is_idempotent(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/p{i % 5}?b=1&a={i % 5}", f"<title>t{i}</title>") for i in range(20)], "page_id int, url string, html string")
    for i in range(2):
        pages.coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    ingest.available_now(source, str(tmp_path / "state"), ingest.ingest_pages({"title": "title"}, F.lit("t"), str(tmp_path / "out")))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["title"][0] for r in rows) == [f"t{i}" for i in range(5)]


def test_validation_split(spark, tmp_path):
    pages = spark.createDataFrame([("http://h", "t"), ("nope", "t")], "url string, title string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    source = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages"))
    split = ingest.validate_into("basic_webpage", str(tmp_path / "valid"), str(tmp_path / "rejected"))
    ingest.available_now(source, str(tmp_path / "state"), split)
    assert spark.read.parquet(str(tmp_path / "valid")).first()["url"] == "http://h"
    assert spark.read.parquet(str(tmp_path / "rejected")).first()["report"]["errors"][0]["kind"] == "type"


def test_a_hot_key_is_folded_piece_by_piece(spark, log, stream, run):
    """The rule gets a key's waiting rows in batches of bounded size, not all in one frame."""
    rule = L.breaker_fold(3, 300)

    def fold(values, state):
        if len(values["_us"]) > 40:
            raise MemoryError(f"{len(values['_us'])} rows at once")
        return rule(values, state)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        states = held.held_fold(stream(), "host", "ts", "event_id", {"_ok": F.col("status_code") == 200}, fold, {"decision": "string", "state": "string"},
                                "2 hours", lambda state, last: 1 << 53)
        got = run(states)
        want = passed(L.breaker_replay(log[0], threshold=3, recovery_seconds=300), log[0], 7_200)
        pick = lambda df: sorted((r["event_id"], r["decision"], r["state"]) for r in df.collect())
        assert pick(got) == pick(want) != []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_finished_run_gives_out_every_row(log, stream, tmp_path):
    states = breaker.breaker_states(stream(), threshold=3, recovery_seconds=300, lateness="2 hours")
    pick = lambda df: sorted((r["event_id"], r["decision"], r["state"]) for r in df.collect())
    whole = L.breaker_replay(log[0], threshold=3, recovery_seconds=300)
    at = (str(tmp_path / "out"), str(tmp_path / "state"))
    assert pick(ingest.to_table(states, *at, finish=True)) == pick(whole)
    # What was given out early waits on for a run that goes on.
    assert pick(ingest.to_table(states, *at)) == pick(passed(whole, log[0], 7_200))
    accepted = dedup.accept_with_ttl(stream(), "host", "ts", "event_id", 500, "2 hours")
    got = ingest.to_table(accepted, str(tmp_path / "out2"), str(tmp_path / "state2"), finish=True)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in R.accept_with_ttl(log[0], "host", "ts", "event_id", 500).collect())


@pytest.mark.parametrize("name", ["stream_accept_with_ttl_finished", "stream_breaker_finished", "stream_metrics_finished"])
def test_finished_queries_give_the_whole_table(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_late_rows_are_put_aside_and_counted(log, stream, tmp_path):
    """With no lateness the third that comes a file late cannot be folded in order; none of it is lost."""
    states = breaker.breaker_states(stream(), threshold=3, recovery_seconds=300)
    out = str(tmp_path / "out")
    with pytest.warns(UserWarning, match="rows came after the watermark"):
        got = ingest.to_table(states, out, str(tmp_path / "state"), finish=True)
    on_time = sorted(r["event_id"] for r in got.collect())
    late = sorted(r["_id"] for r in got.sparkSession.read.parquet(held.late_path(out)).collect())
    assert late and sorted(on_time + late) == sorted(r["event_id"] for r in log[0].collect())


def test_lateness_follows_the_range(spark, tmp_path):
    """Over sixty days a tenth is six days: nothing may fall behind the watermark."""
    events = spark.range(2_000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("error").alias("event_type"),
                                       F.timestamp_seconds(F.col("id") * 2_592).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert entry.queries()["stream_breaker_finished"](spark, str(tmp_path)).count() == 2_000


def test_levels_hold_the_newest_row_of_each_key(spark, tmp_path):
    table = levels.Levels(str(tmp_path / "t"), "k long, v long", ("k",), fan=3, buckets=4)
    want, rng = {}, random.Random(3)
    for n in range(11):
        rows = {rng.randrange(12): n for _ in range(4)}
        want |= rows
        for _ in range(1 + (n in (4, 8))):  # a batch that comes again changes nothing
            table.append(spark.createDataFrame(list(rows.items()), "k long, v long"), "s", n)
        if n in (1, 4, 10):
            got = levels.newest(table.read(spark), ("k",))
            assert {r["k"]: (r["v"], r["_seq"]) for r in got.collect()} == {k: (v, v) for k, v in want.items()}
    assert table.committed(spark) == (11, {"s": 10}) and table.live(11) == [(2, 0), (0, 9), (0, 10)]
    # Merged runs are gone but for those of the last merge.
    assert len(list((tmp_path / "t").glob("level=*/first=*"))) <= 7
    assert len(list((tmp_path / "t" / "commits").glob("count=*"))) == 2


def test_a_run_that_failed_before_its_commit_is_written_anew(spark, tmp_path):
    table = levels.Levels(str(tmp_path / "t"), "k long, v long", ("k",), fan=2)
    one = lambda v: spark.createDataFrame([(1, v)], "k long, v long")
    table.append(one(0), "s", 0)
    one(99).withColumn("_seq", F.lit(1).cast("long")).write.parquet(table.folder((1, 0)))
    table.append(one(1), "s", 1)
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, 1, 1)]


def test_levels_keep_several_streams_apart(spark, tmp_path):
    table = levels.Levels(str(tmp_path / "t"), "k long, v long", ("k",), fan=2)
    for n, stream in enumerate("aabab"):
        table.append(spark.createDataFrame([(n, n)], "k long, v long"), stream, "aabab"[:n].count(stream))
    assert table.committed(spark) == (5, {"a": 2, "b": 1}) and table.read(spark).count() == 5


def test_a_reader_with_keys_opens_their_buckets_only(spark, tmp_path):
    table = levels.Levels(str(tmp_path / "t"), "k long, v long", ("k",), fan=2, buckets=16)
    for n in range(2):
        table.append(spark.range(n * 500, n * 500 + 500).select(F.col("id").alias("k"), F.lit(n).cast("long").alias("v")), "s", n)
    wanted = spark.createDataFrame([(7,)], "k long")
    within = table.buckets_of(wanted)
    rows = table.read(spark, within)
    assert len(within) == 1 and "_bucket" in str(rows._jdf.queryExecution().executedPlan().toString()).split("PartitionFilters")[1].split("]")[0]
    files = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"_bucket={within[0]}/" in f for f in files)
    assert rows.where("k = 7").count() == 1


def test_a_batch_writes_the_states_of_its_keys_only(spark, tmp_path):
    """Ten thousand hosts with a failure each, then batches that touch three of them."""
    schema = "host long, event_id long, s long, status_code int"
    files = str(tmp_path / "in")
    write = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(files)
    write(spark.range(10_000).selectExpr("id AS host", "id AS event_id", "id DIV 100 AS s", "503 AS status_code"))
    for n in range(1, 5):
        write(spark.createDataFrame([(h, 10_000 * n + h, 1_000 * n + h, 503) for h in (5, 6, 7)], schema))
    write(spark.createDataFrame([(-1, -1, 9_000, 200)], schema))
    source = spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 1).parquet(files)
    at = (str(tmp_path / "out"), str(tmp_path / "state"))
    got = ingest.to_table(breaker.breaker_states(source, threshold=3, recovery_seconds=60), *at, finish=True)
    want = L.breaker_replay(spark.read.parquet(files), threshold=3, recovery_seconds=60)
    pick = lambda df: sorted((r["event_id"], r["decision"], r["state"]) for r in df.collect())
    assert pick(got) == pick(want)
    table = levels.Levels(at[1] + "-held/states", "_key long, _state string, _last long, _until long", ("_key",))
    written = {r["_seq"]: r["n"] for r in table.read(spark).groupBy("_seq").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(written.values()) <= 10_000 + 4 * 6 and max(n for k, n in written.items() if k > 1) <= 3
    # Landed rows that every later batch has passed are gone, and so are the folded rows of batches.
    assert not list((tmp_path / "state-held" / "folded").glob("batch_id=[0-9]*"))


def test_a_repeated_batch_starts_from_the_states_before_it(spark, log, stream, tmp_path):
    """The last micro-batch runs again, as after a failure behind all its writes: nothing changes."""
    states = breaker.breaker_states(stream(), threshold=3, recovery_seconds=300, lateness="2 hours")
    at = (str(tmp_path / "out"), str(tmp_path / "state"))
    pick = lambda df: sorted((r["event_id"], r["decision"], r["state"]) for r in df.collect())
    first = pick(ingest.to_table(states, *at))
    commits = sorted((p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    assert pick(ingest.to_table(states, *at)) == first != []


def test_ingest_by_several_streams_reads_an_index(spark, tmp_path):
    """Three streams, each from a checkpoint of its own, over pages that come again; the index stays as small as the table."""
    for i in range(3):
        pages = spark.createDataFrame([(j, f"http://h/p{j % (4 + i)}", f"<title>t{j % (4 + i)}</title>") for j in range(12)], "page_id int, url string, html string")
        pages.coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    out = str(tmp_path / "out")
    for run in range(3):
        source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
        ingest.available_now(source, str(tmp_path / f"state{run}"), ingest.ingest_pages({"title": "title"}, F.lit("t"), out))
    rows = spark.read.parquet(out)
    assert sorted(r["title"][0] for r in rows.collect()) == [f"t{i}" for i in range(6)]
    index = ingest.key_index(out, "string")
    assert index.committed(spark)[0] == 9 and index.read(spark).count() == 6


def test_outcomes_of_one_pass(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        calls.add(1)
        return title

    pages = spark.createDataFrame([("http://h", "t"), ("nope", "t"), ("http://i", "t")], "url string, title string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    source = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages"))
    check = ingest.validate_by_outcome("basic_webpage", str(tmp_path / "out"), lambda n, found: seen.append((n, found)))
    seen = []
    ingest.available_now(source, str(tmp_path / "state"), lambda batch, n: check(batch.withColumn("title", counted("title")), n))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {r["url"]: (r["outcome"], r["report"] and r["report"]["errors"][0]["kind"]) for r in rows.collect()} == {
        "http://h": ("valid", None), "http://i": ("valid", None), "nope": ("rejected", "type")}
    assert seen == [(0, {"valid": 2, "rejected": 1})] and calls.value == 3
