"""Segment operators against plain windows and step-by-step restatements, with
one key holding most of the rows and many segments."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trawlframe.operators import fetchlog as L
from trawlframe.operators import frontier as W
from trawlframe.operators import ordered
from trawlframe.operators import requests as R


def rows_with_a_hot_key(seed, n=4000):
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.6 else rng.randrange(1, 60), i, rng.randrange(500)) for i in range(n)]


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 1, 7, 300, 3000])
def test_running_equals_window(spark, rows_per_slice):
    df = spark.createDataFrame(rows_with_a_hot_key(rows_per_slice % 97), "k int, id int, x long")
    w = Window.partitionBy("k").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("k", "id", "x", F.count(F.lit(1)).over(w).alias("n"), F.sum("x").over(w).alias("s"))
    got = ordered.running(df, ["k"], ["x", "id"], count="n", sums={"s": F.col("x")}, rows_per_slice=rows_per_slice)
    assert got.columns == ["k", "id", "x", "s", "n"]
    assert sorted(map(tuple, got.select("k", "id", "x", "n", "s").collect())) == sorted(map(tuple, want.collect()))


def test_running_without_keys_and_with_null_key(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(50)] + [(1, i, 1) for i in range(50)], "k int, id int, x long")
    whole = ordered.running(df, [], ["k", "id"], count="n", rows_per_slice=9)
    assert sorted(r["n"] for r in whole.collect()) == list(range(1, 101))
    per_key = ordered.running(df, ["k"], ["id"], count="n", rows_per_slice=9).where("k is null")
    assert sorted(r["n"] for r in per_key.collect()) == list(range(1, 51))


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 2, 11])
@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_null_measures_and_null_keys_like_a_window(spark, rows_per_slice, partitions):
    """A sum stays null until its first value, also where whole slices hold nulls only."""
    rng = random.Random(partitions)
    rows = [(None if k == 5 else k, i, None if i < 60 or rng.random() < 0.5 else x) for k, i, x in rows_with_a_hot_key(6, 400)]
    rows += [(None, 1000 + i, None) for i in range(40)] + [(77, 2000 + i, 1 if i < 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, id int, x long").repartition(partitions)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("k", "id", F.sum("x").over(w).alias("s"), F.sum(F.col("x").cast("double")).over(w).alias("d"))
    got = ordered.running(df, ["k"], ["id"], sums={"s": F.col("x"), "d": F.col("x").cast("double")}, rows_per_slice=rows_per_slice)
    assert sorted(map(str, got.select("k", "id", "s", "d").collect())) == sorted(map(str, want.collect()))


def test_building_a_plan_starts_no_job(spark):
    df = spark.createDataFrame(rows_with_a_hot_key(3, 100), "k int, id int, x long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    try:
        ordered.running(df, ["k"], ["x", "id"], count="n", rows_per_slice=3)
        ordered.ordered_fold(df, "k", ["x", "id"], ["x"], lambda v, s: ({}, s), "k int, id int, x long")
        assert not tracker.getJobIdsForGroup("plan-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_whole_keys_over_many_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(None if k == 5 else k, i, x) for k, i, x in rows_with_a_hot_key(8, 500)]
        rows += [(None, 1000 + i, i) for i in range(30)]
        df = spark.createDataFrame(rows, "k int, id int, x long")

        def number(values, state):
            before = int(state or 0)
            return {"n": np.arange(1, len(values["x"]) + 1) + before}, str(before + len(values["x"]))
        got = ordered.ordered_fold(df, "k", ["x", "id"], ["x"], number, "k int, id int, x long, n long")
        want = ordered.running(df, ["k"], ["x", "id"], count="n")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def breaker(calls, threshold, wait):
    """One call after the other."""
    state, fails, last, out = "closed", 0, None, []
    for us, ok in calls:
        decision = "accepted"
        if state == "open":
            if us - last < wait:
                out.append(("rejected", "open"))
                continue
            decision = "trial"
        if ok:
            state, fails = "closed", 0
        else:
            fails, last = fails + 1, us
            state = "open" if fails >= threshold else "closed"
        out.append((decision, state))
    return out


def test_breaker_example(spark):
    calls = [(0, 503), (1, 503), (2, 503), (3, 503), (4, 503), (10, 200), (64, 503), (65, 200), (70, 503), (130, 200)]
    df = spark.createDataFrame([("h", i, s, c) for i, (s, c) in enumerate(calls)], "host string, event_id int, s long, status_code int")
    rows = L.breaker_replay(df.withColumn("ts", F.timestamp_seconds("s"))).orderBy("event_id").collect()
    assert [r["decision"] for r in rows] == ["accepted"] * 5 + ["rejected", "trial", "rejected", "rejected", "trial"]
    assert [r["state"] for r in rows] == ["closed"] * 4 + ["open"] * 5 + ["closed"]


@pytest.fixture
def batch_rows(spark, request):
    """Sequential rules handed on from batch to batch of this many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch_rows, seed, failing", [(10_000, 6, 0.6), (1, 1, 0.7), (13, 2, 0.7), (29, 3, 0.95), (17, 4, 1.0), (111, 5, 0.3)],
                         indirect=["batch_rows"])
def test_breaker_like_step_by_step(spark, batch_rows, seed, failing):
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 9), i, rng.randrange(20_000), 503 if rng.random() < failing else 200)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "host int, event_id int, s long, status_code int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: (r["decision"], r["state"]) for r in L.breaker_replay(df, threshold=3, recovery_seconds=60).collect()}
    want = {}
    for host in {r[0] for r in rows}:
        mine = sorted((s, i, c) for h, i, s, c in rows if h == host)
        for (s, i, c), result in zip(mine, breaker([(s, c == 200) for s, _, c in mine], 3, 60)):
            want[i] = result
    assert got == want


@pytest.mark.parametrize("per_slice, seed, failing, wait", [(1, 1, 0.7, 60), (3, 2, 0.95, 60), (10, 3, 1.0, 700), (40, 4, 0.5, 5), (150, 5, 0.8, 3000), (25, 6, 0.0, 60)])
def test_breaker_of_a_cut_key_like_one_task(spark, monkeypatch, per_slice, seed, failing, wait):
    """Slices of one hot host, composed, against the loop over all its calls."""
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.8 else None if rng.random() < 0.3 else rng.randrange(1, 5), i, rng.randrange(9_000), 503 if rng.random() < failing else 200)
            for i in range(1500)]
    df = spark.createDataFrame(rows, "host int, event_id int, s long, status_code int").withColumn("ts", F.timestamp_seconds("s"))
    monkeypatch.setattr(ordered, "cannot_be_large", lambda df, n: False)
    rule, fold = L.breaker_rule(3, wait), ordered.ordered_fold
    monkeypatch.setattr(L, "ordered_fold", lambda *a: fold(*a, rows_per_slice=per_slice))
    got = {r["event_id"]: (r["decision"], r["state"]) for r in L.breaker_replay(df, threshold=3, recovery_seconds=wait).collect()}
    want = {}
    for host in {r[0] for r in rows}:
        mine = sorted((s, i, c) for h, i, s, c in rows if h == host)
        want.update(zip((i for _, i, _ in mine), breaker([(s, c == 200) for s, _, c in mine], 3, wait), strict=True))
    assert got == want
    # And the summaries alone, for every way to cut one key.
    mine = sorted((s * 1_000_000, i, c == 200) for h, i, s, c in rows if h == 0)
    state = whole = None
    for a in range(0, len(mine), per_slice * 7):
        values = {"_us": np.array([m[0] for m in mine[a:a + per_slice * 7]]), "_ok": np.array([m[2] for m in mine[a:a + per_slice * 7]])}
        state, (_, whole) = rule.through(rule.summary(values), state), rule.fold(values, whole)
        assert json.loads(state) == json.loads(whole)


@pytest.mark.parametrize("per_slice, ttl", [(1, 0), (2, 50), (9, 1), (30, 400), (30, 100_000)])
def test_expiry_of_a_cut_key_like_one_task(spark, monkeypatch, per_slice, ttl):
    rng = random.Random(per_slice + ttl)
    rows = [("a" if rng.random() < 0.9 else None if rng.random() < 0.5 else "b", i, rng.randrange(4_000)) for i in range(900)]
    df = spark.createDataFrame(rows, "fp string, id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    monkeypatch.setattr(ordered, "cannot_be_large", lambda df, n: False)
    fold = ordered.ordered_fold
    monkeypatch.setattr(R, "ordered_fold", lambda *a: fold(*a, rows_per_slice=per_slice))
    got = {r["id"] for r in R.accept_with_ttl(df, "fp", "ts", "id", ttl).collect()}
    want = set()
    for fp in {r[0] for r in rows}:
        last = None
        for s, i in sorted((s, i) for f, i, s in rows if f == fp):
            if last is None or s > last + ttl:
                want.add(i)
                last = s
    assert got == want


def test_hot_key_of_a_rule_is_spread(spark, monkeypatch):
    """Nine tenths of the rows on one host: no task folds more than a few slices."""
    df = spark.range(20_000).select(F.expr("IF(id % 10 = 0, id, 0)").alias("host"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"),
                                    F.expr("IF(hash(id) % 3 = 0, 200, 503)").alias("status_code"))
    monkeypatch.setattr(ordered, "cannot_be_large", lambda df, n: False)
    fold = ordered.ordered_fold
    monkeypatch.setattr(L, "ordered_fold", lambda *a: fold(*a, rows_per_slice=500))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = L.breaker_replay(df).withColumn("task", F.spark_partition_id()).where("host = 0").groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 9_000


def test_place_by_binary_search(spark):
    df = spark.createDataFrame([([], 5), ([3], 2), ([3], 3), ([1, 4, 9, 16, 25], 0), ([1, 4, 9, 16, 25], 16), ([1, 4, 9, 16, 25], 99), (None, 1)], "b array<int>, x int")
    assert [r[0] for r in df.select(ordered.place_in(F.col("b"), F.col("x"))).collect()] == [0, 0, 1, 0, 4, 5, 0]


def test_bounds_of_all_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MOST_BOUNDS", 16)
    df = spark.range(3_000).select(F.struct((F.col("id") % 3).alias("k0")).alias("_key"), F.struct(F.col("id").alias("o0")).alias("_order"))
    sizes = [r[0] for r in ordered.slice_bounds(df, 2).select(F.size("_bounds")).collect()]
    assert len(sizes) == 3 and 9 <= sum(sizes) <= 16


def test_streaks_and_adaptive_retry(spark):
    rng = random.Random(9)
    rows = [(h, i, i, 503 if rng.random() < 0.5 else 200) for h in range(4) for i in range(200 if h == 0 else 15)]
    rows = [(h, n, s, c) for n, (h, _, s, c) in enumerate(rows)]
    log = spark.createDataFrame(rows, "host int, event_id int, s long, status_code int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["host"]: (r["longest_streak"], r["current_streak"], r["alarm"]) for r in L.failure_streaks(log).collect()}
    for host in range(4):
        best = run = 0
        for _, _, _, c in (r for r in rows if r[0] == host):
            run = 0 if c == 200 else run + 1
            best = max(best, run)
        assert got[host] == (best, run, best >= 5)
    advice = L.adaptive_retry(log).where("host = 1").orderBy("ts").collect()
    assert advice[8]["max_retries"] == 3 and advice[8]["base_delay"] == 1.0
    last = advice[-1]
    assert (last["max_retries"], last["base_delay"]) == ((5, 1.5) if last["success_rate"] < 0.8 else (2, 0.8))


def test_retry_delays(spark):
    log = spark.createDataFrame([(1, 503), (2, 200)], "event_id int, status_code int")
    rows = L.retry_plan(log, max_retries=7).orderBy("attempt").collect()
    assert [r["delay"] for r in rows] == [1, 2, 4, 8, 16, 32, 60]
    assert [r["delay_high"] for r in rows][-2:] == [48, 60] and rows[-1]["delay_low"] == 32


def test_frontier(spark):
    items = spark.createDataFrame([("q", "a", 2, 1), ("q", "b", 0, 5), ("q", "c", 2, 0), ("q", "d", 4, 0)],
                                  "queue string, item_id string, priority int, ts long")
    assert [r["item_id"] for r in W.ranked(items).orderBy("position").collect()] == ["b", "c", "a", "d"]
    assert [r["item_id"] for r in W.next_items(items, 1).collect()] == ["b"]
    assert [r["item_id"] for r in W.bounded(items, 3).where("evicted").collect()] == ["d"]
    assert W.bounded(items, 0).where("evicted").count() == 0
    commands = spark.createDataFrame([("a", 1, 1, "remove", None), ("a", 2, 2, "update", 0), ("b", 1, 3, "remove", None)],
                                     "item_id string, ts long, command_id int, action string, priority int")
    left = {r["item_id"]: r["priority"] for r in W.apply_commands(items, commands).collect()}
    assert left == {"a": 0, "c": 2, "d": 4}


def test_queue_statistics(spark):
    items = spark.createDataFrame([("q", 1, 0), ("q", 2, 10), ("r", 3, 20)], "queue string, item_id int, s long").select(
        "queue", "item_id", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("priority"))
    rows = {r["queue"]: r for r in W.queue_stats(items, F.timestamp_seconds(F.lit(30)), maxsize=2).collect()}
    assert (rows["q"]["queue_size"], rows["q"]["average_wait_time"], rows["q"]["is_full"]) == (2, 25.0, True)
    assert (rows[None]["queue_size"], rows[None]["queues"], rows[None]["min_wait_time"]) == (3, 2, 10.0)


def test_politeness(spark):
    df = spark.createDataFrame([("h", i) for i in range(12)] + [("g", 1)], "host string, id int")
    rows = W.politeness_plan(df, "host", ["id"], per_host=5, overall=4, delay_seconds=2.0).collect()
    assert max(r["wave"] for r in rows) == 2 and max(r["start_after"] for r in rows) == 22.0
    sizes = {}
    for r in rows:
        sizes[r["batch"]] = sizes.get(r["batch"], 0) + 1
    assert all(n <= 4 for n in sizes.values()) and sum(sizes.values()) == 13
