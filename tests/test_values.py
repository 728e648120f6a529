import random
import re
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawlframe.functions import patterns as P
from trawlframe.functions.cleaners import _by_slices, clean, clean_columns, register_cleaner
from trawlframe.functions.validators import is_valid
from trawlframe.functions import ids as I
from trawlframe.functions import outcomes as O


@pytest.mark.parametrize("cleaner, text, want", [
    ("normalize_unicode", "ﬁ１２", "fi12"), ("capitalize", "éLAN vital", "Élan vital"), ("capitalize", "ßA", "Ssa"),
    ("title_case", "it's o'neil-x 3rd", "It'S O'Neil-X 3Rd"), ("remove_html", "<b>x</b> y", "x y"),
    ("remove_html", "<a\nb>c", "<a\nb>c"), ("extract_numbers", "a1b22", "122"), ("remove_special_chars", "é!a@b.c#", "éa@b.c"),
    ("trim", " a\t", "a"), ("trim", " \x1fa b ", "a b"), ("normalize_whitespace", " a  \n b ", "a b"),
    ("remove_whitespace", " a b\t", "ab"), ("remove_numbers", "a1٣b", "ab"), ("extract_letters", "é1aB", "aB"),
    ("to_upper", "straße", "STRASSE"), ("to_lower", "ÉA", "éa"), ("no such cleaner", " x ", " x "),
])
def test_cleaners(value_of, cleaner, text, want):
    assert value_of(text, clean(F.col("v"), [cleaner])) == want


@pytest.mark.parametrize("text", ["ßach Zu", "ǆEP", "ŉA", "ΑΣ", "ΟΔΟΣ ΑΣ", "აბ", "İX", "", "a"])
def test_capitalize_like_python(value_of, text):
    assert value_of(text, clean(F.col("v"), ["capitalize"])) == text.capitalize()


@pytest.mark.parametrize("work", [str.title, lambda t: unicodedata.normalize("NFKC", t)])
def test_text_batches_by_slices(work):
    """Of a batch of long texts only a slice is in Python strings at a time."""
    texts = [None, "", "ßa o'neil ǆx", "x" * 300_000, None, *["été ﬁ " * 30_000] * 60, "end", ""]
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    got = _by_slices(batch, work)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got.to_pylist() == [None if t is None else work(t) for t in texts] and most < 12_000_000
    assert _by_slices(pa.array([], pa.string()), work).to_pylist() == []
    assert _by_slices(pa.array([None, None], pa.string()), work).to_pylist() == [None, None]


def test_null_handling(value_of):
    assert value_of(None, clean(F.col("v"), ["trim"])) is None
    assert value_of(None, clean(F.col("v"), ["trim"], compat_null=True)) == "None"


def test_clean_columns(spark):
    register_cleaner("exclaim", lambda v: F.concat(v, F.lit("!")))
    df = spark.createDataFrame([(" A ", 1)], "a string, n int")
    row = clean_columns(df, {"a": ["trim", "to_lower", "exclaim"], "b": ["exclaim"]}).first()
    assert (row["a"], row["b"], row["n"]) == ("a!", "!", 1)


@pytest.mark.parametrize("value, true_for, false_for", [
    ("a@b.co trailing", ["email"], ["url"]), ("x a@b.co", [], ["email"]), ("http://h", ["url"], ["email"]),
    ("2024-99-99", ["date"], []), ("12.5", ["number", "float"], ["integer"]), ("1_000", ["number", "integer"], []),
    ("1d", [], ["number"]), ("YES", ["boolean"], ["number"]), ('{"a":1}', ["json"], []), ("{bad", [], ["json"]),
    ('{"a":1} x', [], ["json"]), ("1, 2", [], ["json"]), ("1] , [2", [], ["json"]), ("NaN", ["json", "number"], ["integer"]),
    ("256.1.1.1", [], ["ip_address"]), ("13912345678", ["chinese_phone"], []), ("$1,234.50", ["price"], ["number"]),
    ("1234567", ["hex_color"], []), ("", [], ["email", "url", "json", "integer", "string_like"]), (" 12 ", ["integer"], []),
    ("555-123-4567", ["phone"], []), ("12345-6789", ["zipcode"], []), ("1234 5678 9012 3456", ["credit_card"], []),
])
def test_validators(value_of, value, true_for, false_for):
    for name in true_for:
        assert value_of(value, is_valid(F.col("v"), name)) is True, name
    for name in false_for:
        if name != "string_like":
            assert value_of(value, is_valid(F.col("v"), name)) is False, name


def test_number_checks_like_python(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choices("0123.eE+-_ infa٣", k=rng.randrange(1, 6))) for _ in range(4000)} | {"nan", "-Infinity", "1_0.2e1_0"})

    def reads(kind, text):
        try:
            kind(text)
            return True
        except ValueError:
            return False
    df = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", is_valid(F.col("v"), "float").alias("f"), is_valid(F.col("v"), "integer").alias("i"))
    wrong = [r for r in df.collect() if (r["f"], r["i"]) != (reads(float, r["v"]), reads(int, r["v"]))]
    assert not wrong, wrong[:5]


def test_validators_by_type(spark):
    df = spark.range(1).select(
        F.lit(float("nan")).alias("nan"), F.lit(2).alias("two"), F.lit(1.0).alias("one"), F.array(F.lit(1)).alias("list"),
        F.create_map(F.lit("a"), F.lit(1)).alias("map"), F.lit(None).cast("string").alias("none"))
    def check(name, column):
        return df.select(is_valid(F.col(column), name, df.schema[column].dataType).alias("r")).first()["r"]
    assert check("number", "nan") and not check("integer", "nan")
    assert check("boolean", "one") and not check("boolean", "two")
    assert check("array", "list") and check("object", "map") and not check("object", "list")
    assert not check("string", "none") and not check("email", "two")


def test_patterns_like_python(spark):
    rng = random.Random(4)
    pieces = ["a@b.co", "ñabc@x.com", "x.y@z.org,", "192.168.1.1", "256.1.1.1", "1.2.3.4.5", "2024-01-02", "12:30:45", "$1,234.50",
              "13912345678", "1234 5678 9012 3456", "12345-6789", "#ff00Aa", "555-123.4567", "é", " ", "_", "http://ex.com/a?b=c#d",
              "01234567-89ab-cdef-0123-456789abcdef", "99", "\n", "٣"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 7))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    for name, pattern in P.PATTERNS.items():
        rows = df.select("i", P.extract_named(F.col("v"), name).alias("all"), P.extract_named(F.col("v"), name, first=True).alias("one")).collect()
        for r in rows:
            found = re.findall(pattern, texts[r["i"]])
            assert (r["all"], r["one"]) == ((sorted(set(found)), found[0]) if found else (None, None)), (name, texts[r["i"]])


def test_user_regex_groups(value_of):
    text = "k=1 k=2 k=1"
    assert value_of(text, P.find_all(F.col("v"), r"k=\d")) == ["k=1", "k=2"]
    assert value_of(text, P.find_all(F.col("v"), r"k=(\d)")) == ["1", "2"]
    assert [tuple(r) for r in value_of(text, P.find_all(F.col("v"), r"(k)=(\d)"))] == [("k", "1"), ("k", "2")]
    assert value_of(text, P.extract_named(F.col("v"), "nope")) is None


def test_masking(value_of):
    assert value_of("to a@b.co from 10.0.0.1", P.mask(F.col("v"), ["email", "ip"])) == "to [email] from [ip]"


def test_snowflake(spark):
    row = spark.range(1).select(
        F.date_format(I.snowflake_time(F.lit(665570277530276842)), "yyyy-MM-dd HH:mm:ss.SSS").alias("t"),
        I.snowflake_worker(F.lit(665570277530276842)).alias("w"), I.snowflake_sequence(F.lit(665570277530276842)).alias("s")).first()
    assert tuple(row) == ("2025-09-24 03:25:19.861", 1, 1002)


@pytest.mark.parametrize("status, proxy, cookies, failure, want", [
    (200, True, True, None, "ok"), (429, False, False, None, "rate_limit"), (503, True, False, None, "server"),
    (407, True, False, None, "proxy"), (407, False, False, None, "http_error"), (403, False, True, None, "cookie"),
    (401, False, False, None, "http_error"), (0, False, False, "timeout", "timeout"), (0, False, False, "connection", "network"),
])
def test_outcomes(spark, status, proxy, cookies, failure, want):
    df = spark.createDataFrame([(status, proxy, cookies, failure)], "s int, p boolean, c boolean, f string")
    assert df.select(O.outcome_class(F.col("s"), F.col("p"), F.col("c"), F.col("f")).alias("r")).first()["r"] == want


def test_retry_rules(spark):
    statuses = {200: False, 400: False, 404: False, 408: True, 429: True, 500: True, 501: True, 520: True}
    rows = spark.createDataFrame([(s,) for s in statuses], "s int").select("s", O.retryable_status(F.col("s")).alias("r")).collect()
    assert {r["s"]: r["r"] for r in rows} == statuses
    kinds = spark.createDataFrame([("timeout",), ("rate_limit",), ("parser",), ("custom",)], "k string")
    got = kinds.select("k", O.retryable_class(F.col("k"), retry_on_timeout=False, overrides={"custom": True}).alias("r")).collect()
    assert {r["k"]: r["r"] for r in got} == {"timeout": False, "rate_limit": True, "parser": False, "custom": True}
    errors = spark.createDataFrame([(500, {}), (500, {"retryable": "False"}), (500, {"recoverable": "true"}), (404, {})],
                                   "code int, details map<string,string>")
    assert [r[0] for r in errors.select(O.retryable_error(F.col("code"), F.col("details"))).collect()] == [True, False, True, False]
    dim = O.with_error_class(spark.createDataFrame([("proxy",), ("nope",)], "error_type string")).collect()
    assert {r["error_type"]: (r["error_class"], r["code"]) for r in dim} == {"proxy": ("ProxyException", 500), "nope": ("Exception", 500)}


def test_a_pattern_registered_under_a_known_name(value_of):
    from trawlframe.functions import patterns

    before = patterns.PATTERNS["time"]
    patterns.register_pattern("time", r"\d{1,2}h\d{2}")
    try:
        assert value_of("at 12h30", patterns.extract_named(F.col("v"), "time")) == ["12h30"]
    finally:
        patterns.register_pattern("time", before)
    assert value_of("at 12:30:00", patterns.extract_named(F.col("v"), "time")) == ["12:30:00"]
