import random
from urllib.parse import parse_qs, urlencode, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from trawlframe.functions.urls import domain_of, normalize_url, resolve_href


def expected_normal(url, ignore=(), sort=True):
    """The rule written with the standard library."""
    try:
        parsed = urlparse(url)
    except ValueError:
        return url
    params = {k: v for k, v in parse_qs(parsed.query).items() if k not in ignore}
    if sort:
        params = dict(sorted(params.items()))
    query = urlencode(params, doseq=True)
    return f"{parsed.scheme}://{parsed.netloc.lower()}{parsed.path or '/'}" + (f"?{query}" if query else "")


@pytest.mark.parametrize("url, options, normal", [
    ("HTTP://ExAmple.COM", {}, "http://example.com/"),
    ("http://ex.com/a;p=1?b=2&a=1&a=0#frag", {}, "http://ex.com/a?a=1&a=0&b=2"),
    ("http://ex.com/a?x=&y=1&z", {}, "http://ex.com/a?y=1"),
    ("http://ex.com/a?q=a+b%2Fc~*é", {}, "http://ex.com/a?q=a+b%2Fc~%2A%C3%A9"),
    ("http://ex.com/?t=9&k=1", {"ignore_params": ["t"]}, "http://ex.com/?k=1"),
    ("http://ex.com/?b=1&a=2&b=0", {"sort_params": False}, "http://ex.com/?b=1&b=0&a=2"),
])
def test_normalized(value_of, url, options, normal):
    assert value_of(url, normalize_url("v", **options)) == normal


def random_url(rng):
    host = rng.choice(["Ex.com", "a.b:80", "", "x", "u@H.org", "[::1]", "[bad"])
    path = "".join(rng.choice(["/", "a", ";p", "%41", "é", ".", "..", "//"]) for _ in range(rng.randrange(5)))
    query = "&".join(rng.choice(["a", "b", "%61", "", "é", "t"]) + rng.choice(["=", "", "=="]) + rng.choice(
        ["1", "", "a+b", "%zz", "%C3%A9", "~*", "x y", "=", "%"]) for _ in range(rng.randrange(4)))
    return (rng.choice(["http://", "HTTPS://", "//", "ftp://", "", "http:"]) + host
            + ("/" + path if path else "") + rng.choice(["", "?" + query]) + rng.choice(["", "#f?x=1"]))


@pytest.mark.parametrize("ignore, sort", [((), True), (("a", "t"), True), ((), False)])
def test_normalized_like_the_standard_library(spark, ignore, sort):
    rng = random.Random(7)
    urls = sorted({random_url(rng) for _ in range(3000)})
    df = spark.createDataFrame([(u,) for u in urls], "v string")
    got = {r["v"]: r["n"] for r in df.select("v", normalize_url("v", ignore, sort).alias("n")).collect()}
    wrong = [(u, got[u], expected_normal(u, ignore, sort)) for u in urls if got[u] != expected_normal(u, ignore, sort)]
    assert not wrong, wrong[:5]


def test_resolved_like_the_standard_library(spark):
    rng = random.Random(3)
    hrefs = {"/" + "".join(rng.choice(["/", "a", "..", ".", "../", "./", "b/", "?q=/../x", "#f"]) for _ in range(rng.randrange(6)))
             for _ in range(800)}
    base = "https://ex.com/d/e.html"
    df = spark.createDataFrame([(h,) for h in sorted(hrefs)], "v string")
    rows = df.select("v", resolve_href(F.lit(base), "v").alias("u")).collect()
    wrong = [(r["v"], r["u"], urljoin(base, r["v"])) for r in rows if r["u"] != urljoin(base, r["v"]) and not r["v"].startswith("//")]
    assert not wrong, wrong[:5]


def test_other_host_and_domain(value_of):
    assert value_of("//h.org/x", resolve_href(F.lit("https://ex.com/d"), "v")) == "https://h.org/x"
    assert value_of("http://U@Ex.com:80/x?y", domain_of("v")) == "U@Ex.com:80"
