import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.operators import records as G
from trawlframe.operators.validation import (
    SCHEMAS, FieldRule, error_rates, registered_names, split, valid_ratio, validate, validate_task_config, validate_value)


def kinds(df, rules, **options):
    report = validate(df, rules, **options).first()["report"]
    return report["is_valid"], [(e["field"], e["kind"]) for e in report["errors"]]


def one(spark, value, dtype="string", name="v"):
    return spark.createDataFrame([(value,)], f"{name} {dtype}")


def test_absent_required_field_has_two_errors(spark):
    rules = {"title": SCHEMAS["basic_webpage"]["title"]}
    assert kinds(spark.range(1), rules) == (False, [("title", "required"), ("title", "missing_key")])


def test_null_with_cleaners(spark):
    rules = {"title": SCHEMAS["basic_webpage"]["title"]}
    null = one(spark, None, name="title")
    assert kinds(null, rules) == (False, [("title", "required")])
    assert kinds(null, rules, compat_null=True) == (True, [])
    assert validate(null, rules, compat_null=True).first()["report"]["cleaned"] == {"title": "None"}


@pytest.mark.parametrize("value, dtype, rule, want", [
    ("12.5", "string", FieldRule("number"), ["not_numeric"]),
    ("12.5", "string", FieldRule("float", max_value=12), ["max_value"]),
    (12.5, "double", FieldRule("number", max_value=12), []),
    (-12.5, "double", FieldRule("number", min_value=-12), []),
    (float("nan"), "double", FieldRule("number"), ["not_numeric"]),
    ("1_000", "string", FieldRule("integer", min_value=999, max_value=1000), []),
    ("x", "string", FieldRule("integer"), ["type"]),
    ("in_stock now", "string", FieldRule(pattern="(in_stock|out_of_stock|preorder)"), []),
    ("not in_stock", "string", FieldRule(pattern="(in_stock|out_of_stock|preorder)"), ["pattern"]),
    ("", "string", FieldRule("url", required=False), []),
    ("abc", "string", FieldRule(min_length=4, max_length=2), ["min_length", "max_length"]),
    ("anything", "string", FieldRule("no such type"), []),
    ("abc", "string", FieldRule(custom=lambda v: v == "x"), ["custom"]),
    ("  ", "string", FieldRule(cleaners=("trim",)), ["required"]),
])
def test_rules(spark, value, dtype, rule, want):
    assert [k for _, k in kinds(one(spark, value, dtype), {"v": rule})[1]] == want


def test_undecided_custom_rule_warns(spark):
    report = validate(one(spark, "x"), {"v": FieldRule(custom=lambda v: F.lit(None).cast("boolean"))}).first()["report"]
    assert report["is_valid"] and len(report["warnings"]) == 1


def test_unknown_schema(spark):
    assert kinds(spark.range(1), "no such schema") == (False, [("", "unknown_schema")])


def test_reports_and_split(spark):
    df = spark.createDataFrame([("http://h", "t"), ("nope", "t"), ("http://h", "")], "url string, title string")
    checked = validate(df, {k: SCHEMAS["basic_webpage"][k] for k in ("title", "url")})
    good, bad = split(checked)
    assert (good.count(), bad.count()) == (1, 2)
    assert {tuple(r) for r in error_rates(checked).collect()} == {("url", "type", 1), ("title", "required", 1)}
    assert tuple(valid_ratio(checked).first())[:2] == (3, 1)


def test_single_value(spark):
    r = one(spark, " a@b.co ").select(validate_value("v", F.col("v"), T.StringType(), field_type="email", cleaners=("trim",)).alias("r")).first()["r"]
    assert (r["original"], r["cleaned"], r["is_valid"]) == (" a@b.co ", "a@b.co", True)


def test_names(spark):
    counts = {r["kind"]: r["count"] for r in registered_names(spark).groupBy("kind").count().collect()}
    assert counts["validator"] == 18 and counts["pattern"] == 12 and counts["cleaner"] >= 13


@pytest.mark.parametrize("config, want", [
    ({"name": "n", "urls": ["http://h"]}, []),
    ({"urls": ["http://h"], "timeout": 0}, ["required", "range"]),
    ({"name": "n", "max_concurrent_requests": 101}, ["required", "range"]),
    ({"name": "n", "urls": ["x" * 2049], "selector_type": "sql"}, ["max_length", "pattern"]),
])
def test_task_config(spark, config, want):
    row = validate_task_config(one(spark, json.dumps(config), name="config")).first()
    assert [e["kind"] for e in row["report"]["errors"]] == want
    assert row["parsed"]["retry_times"] == 3


def test_broken_task_config(spark):
    assert validate_task_config(one(spark, "{", name="config")).first()["report"]["errors"][0]["kind"] == "type"


def test_record_helpers(spark):
    df = spark.createDataFrame([("2024/01/02", "$1,234.50"), ("2024-01-02T03:04:05.5", "n/a"), ("02.01.2024", "7"), ("2024-13-01", "-3.5")],
                               "t string, n string")
    rows = df.select(F.date_format(G.normalize_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("t"), G.normalize_number(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("2024-01-02 00:00:00", 1234.5), ("2024-01-02 03:04:05", None), ("2024-01-02 00:00:00", 7.0), (None, -3.5)]
    same = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "x")], "id int, b string, a string")
    assert sorted(r["id"] for r in G.distinct_content(same, ["a", "b"], ["id"]).collect()) == [1, 3]
    log = G.change_log(spark.createDataFrame([(1, " a", "b")], "id int, x string, y string"), "id", {"x": ["trim"], "y": ["trim"]})
    assert [tuple(r) for r in log.collect()] == [(1, "x", " a", "a")]


def test_whole_numbers_of_any_length_meet_their_bounds(spark):
    rules = {"n": FieldRule("integer", min_value=-5, max_value=100)}
    df = spark.createDataFrame([("9" * 40,), ("-" + "9" * 40,), ("7",), ("101",)], "n string")
    assert [[k for _, k in kinds(df.where(F.col("n") == n), rules)[1]] for n in ("9" * 40, "-" + "9" * 40, "7", "101")] == [
        ["max_value"], ["min_value"], [], ["max_value"]]
