import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from trawlframe.operators import requests as R


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("url, digest", [
    ("HTTP://ExAmple.COM", "14f8634657776975ae2c0f092cf6d8f7"),
    ("http://ex.com/a;p=1?b=2&a=1&a=0#frag", "b81662f019e8d8485609573f0c6cfe49"),
    ("http://ex.com/a?x=&y=1&z", "3675bee20c02bad12927ddc46a55de31"),
    ("http://ex.com/a?q=a+b%2Fc~*é", "5d6f6dc9cb13115cdca53fa9278c9bca"),
])
def test_fingerprint_of_url(value_of, url, digest):
    assert value_of(url, R.fingerprint(F.col("v"))) == digest


def test_payload_and_headers(spark):
    df = spark.createDataFrame(
        [("http://ex.com/", "post", {"b": "ü", "a": "1"}, {"X-K": "v", "Accept": "*/*"})],
        "url string, method string, data map<string,string>, headers map<string,string>")
    config = R.FingerprintConfig(headers=True)
    assert R.with_fingerprint(df, config).first()["fp"] == "9656d4906bbc0c89c62503ab5d530bbb"


def test_payload_text_like_json_dumps(spark):
    rng = random.Random(1)
    alphabet = ['a', '"', '\\', '\n', '\t', '\x01', '\x1f', 'é', '/', ' ', '\x7f', '😀']
    maps = [{"".join(rng.choices(alphabet, k=rng.randrange(1, 4))): "".join(rng.choices(alphabet, k=rng.randrange(5)))
             for _ in range(rng.randrange(1, 5))} for _ in range(300)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    from trawlframe.functions.jsontext import payload_text
    got = {r["i"]: r["t"] for r in df.select("i", payload_text(F.col("m")).alias("t")).collect()}
    assert all(got[i] == json.dumps(m, sort_keys=True, ensure_ascii=False) for i, m in enumerate(maps))


def test_ignored_parts(spark):
    df = spark.createDataFrame(
        [("http://ex.com/?nonce=1&k=2", {"nonce": "1"}, {"COOKIE": "x", "Accept": "a", "accept": "b"}),
         ("http://ex.com/?nonce=1&k=2", {}, {})],
        "url string, data map<string,string>, headers map<string,string>")
    full, empty = [r["fp"] for r in R.with_fingerprint(df, R.preset("strict")).collect()]
    assert full == md5('METHOD:GET|URL:http://ex.com/?k=2|DATA:{}|HEADERS:{"accept": "b"}')
    assert empty == md5("METHOD:GET|URL:http://ex.com/?k=2")
    assert R.preset("no such preset") == R.PRESETS["default"]


def accepted(times, ttl):
    last, out = None, []
    for t in times:
        if last is None or t - last > ttl:
            out.append(t)
            last = t
    return out


def test_ttl_example(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 1000, 3600, 3601, 7000, 7202])]
    df = spark.createDataFrame(rows, "fp int, id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = R.accept_with_ttl(df, "fp", "ts", "id", 3600).select(F.unix_seconds("ts").alias("s"))
    assert sorted(r["s"] for r in got.collect()) == [0, 3601, 7202]


@pytest.mark.parametrize("batch_rows", [10_000, 7])
def test_ttl_with_a_hot_key_over_many_batches(spark, batch_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        _ttl_with_a_hot_key(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _ttl_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(0, rng.randrange(40_000)) for _ in range(3000)] + [(rng.randrange(1, 40), rng.randrange(40_000)) for _ in range(1500)]
    rows = [(k, i, t) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "fp int, id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r["fp"], r["s"]) for r in R.accept_with_ttl(df, "fp", "ts", "id", 500).select("fp", F.unix_seconds("ts").alias("s")).collect())
    keys = {k for k, _, _ in rows}
    want = sorted((k, t) for k in keys for t in accepted(sorted(t for q, _, t in rows if q == k), 500))
    assert got == want


def test_admit_forget_newest(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "fp string, id int")
    seen = spark.createDataFrame([("a",)], "fp string")
    assert {(r["fp"], r["id"]) for r in R.admit(batch, seen, ["id"]).collect()} == {("b", 2), ("c", 4)}
    assert {r["fp"] for r in R.forget(batch.select("fp").distinct(), seen).collect()} == {"b", "c"}
    stamped = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "fp string, ts int")
    assert [r["fp"] for r in R.newest(stamped, 2).collect()] == ["b", "c"]


def test_idempotent_load_twice(spark):
    batch = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3), (2, "x", 4)], "task_id int, fp string, id int")
    empty = batch.limit(0)
    first = R.load_idempotent(batch, empty, ["task_id", "fp"], ["id"])
    assert sorted(r["id"] for r in first.collect()) == [1, 3, 4]
    assert R.load_idempotent(batch, first, ["task_id", "fp"], ["id"]).count() == 0


URLS = ["http://h.example/p?b=2&a=1", "HTTP://H.example/p?a=%20x&a=&a=2#f", "http://h/p;x?q=1=2&c", "http://h/p", "http://h", "http://[::1/p?a=1", "//h/p?t=1&z=é&_=3",
        "mailto:x@y", "", None, " http://h/a b?x=1+2&timestamp=3", "http://h/p?timestamp=1", "ftp://h/p;type=a?k=v&nonce=1", "http://h/p?~a=*&b=%zz"]


def test_all_configurations_at_once_like_one_by_one(spark):
    rows = [(i, u, "post" if i % 2 else "get", {"X-A": "1", "x-a": str(i), "User-Agent": "u", "Cookie": None} if i % 3 else {}, {"nonce": "1", "é\n": '"', "b": None} if i % 4 else None)
            for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "id int, url string, method string, headers map<string,string>, data map<string,string>")
    for kept in (["id", "url"], ["id", "url", "method", "headers", "data"]):
        some = df.select(*kept)
        at_once = R.with_fingerprints(some, {n: R.preset(n) for n in R.PRESETS}).collect()
        for name in R.PRESETS:
            one = {r["id"]: r["fp"] for r in R.with_fingerprint(some, R.preset(name)).collect()}
            assert {r["id"]: r[name] for r in at_once} == one, name
