import time

import pytest
from pyspark.sql import functions as F

from trawlframe.functions import htmltree
from trawlframe.operators import extraction as X

PAGE = """<html><head><title>T1</title></head><body><h1 class="title">Main  head</h1>
<div class="content"><p>first</p><p>second</p></div>
<ul class="list"><li>a</li><li>b</li><li>c</li></ul>
<a href="https://ex.org/p1">one</a><a href="/p2">two</a><a href="p3">rel</a><a href="/p2">again</a>
<img src="https://ex.org/i1.jpg"><img src="/i2.jpg"></body></html>"""
BASE = "https://ex.com/d/e.html"


@pytest.fixture
def page(spark):
    return lambda html=PAGE: spark.createDataFrame([(1, BASE, html)], "page_id int, url string, html string")


def fields(df, rules, **options):
    return X.extract_fields(df, rules, **options).first()


def test_css_rules(page):
    row = fields(page(), {"title": "h1.title", "content": "div.content p", "none": ".nope", "href": "a::attr(href)",
                          "text": "title::text", "child": "ul > li", "either": "h1, title", "by_id": "#x", "ends": "a[href$='p1']"})
    assert row["title"] == ["Main head"]
    assert row["content"] == ["first", "second"]
    assert row["none"] is None and row["by_id"] is None
    assert row["href"] == ["https://ex.org/p1", "/p2", "p3", "/p2"]
    assert row["text"] == ["T1"] and row["child"] == ["a", "b", "c"]
    assert row["either"] == ["T1", "Main head"] and row["ends"] == ["one"]


def test_xpath_rules(page):
    row = fields(page(), {"title": "//title/text()", "second": "//div[@class='content']/p[2]", "src": "//img/@src",
                          "all": "//ul//li", "none": "//nope", "part": "//a[contains(@href,'org')]"}, selector_type="XPath")
    assert row["title"] == ["T1"] and row["second"] == ["second"]
    assert row["src"] == ["https://ex.org/i1.jpg", "/i2.jpg"]
    assert row["all"] == ["a", "b", "c"] and row["none"] is None and row["part"] == ["one"]


def test_no_rules_no_rows_and_wrong_type(page):
    assert X.extract_fields(page(), {}).count() == 0
    with pytest.raises(ValueError):
        X.extract_fields(page(), {"a": "a"}, "jsonpath")


def test_bad_rule_spoils_only_its_field(page):
    row = fields(page(), {"bad": "a::before(", "good": "title"})
    assert row["bad"] is None and row["good"] == ["T1"]


def test_malformed_markup(page):
    html = """<title>A &amp; B</title><script>var t="</p><a href='/no'>";</script><p>one<p><b>two<br>three</b>
      <ul><li>x<li>y</ul><!-- <a href="/gone">c</a> --><a HREF='/q?a=1&amp;b=2'>q</a><a href=/bare>b</a><a>none</a>"""
    row = fields(page(html), {"title": "title", "p": "p", "li": "li", "href": "a::attr(href)"})
    assert row["title"] == ["A & B"] and row["li"] == ["x", "y"]
    assert row["p"] == ["one", "twothree"] and row["href"] == ["/q?a=1&b=2", "/bare"]


def test_links_both_ways(page):
    for edges in (X.page_links(page()), X.parsed_references(page(), "a::attr(href)")):
        assert [r["dst_url"] for r in edges.orderBy("pos").collect()] == ["https://ex.org/p1", "https://ex.com/p2"]
    html = """<!-- <a href="/c"> --><script>'<a href="/s">'</script><A data-x='>' HREF = '/q?a=1&amp;b=2'>q</A><abbr href="/no">
      <a href=/bare>b</a><a\nhref="//o.org/z">o</a>"""
    both = [sorted(r["dst_url"] for r in e.collect()) for e in (X.page_links(page(html)), X.parsed_references(page(html), "a::attr(href)"))]
    assert both[0] == both[1] == ["https://ex.com/bare", "https://ex.com/q?a=1&b=2", "https://o.org/z"]


def test_images(page):
    assert [r["dst_url"] for r in X.page_images(page()).orderBy("pos").collect()] == ["https://ex.org/i1.jpg", "https://ex.com/i2.jpg"]


def test_items(page):
    html = '<div class="item"><h2>A</h2><i>1</i><i>2</i></div><div class="item"><h2>B</h2></div>'
    rows = X.extract_items(page(html), "div.item", {"name": "h2", "parts": "i"}).orderBy("item_pos").collect()
    assert [(r["item_pos"], r["name"], r["parts"]) for r in rows] == [(0, ["A"], ["1", "2"]), (1, ["B"], None)]


def test_long_form_collapse_coverage(page):
    wide = X.extract_fields(page(), {"li": "li", "title": "title", "none": ".nope"})
    long = X.long_form(wide, ["page_id"], ["li", "title", "none"]).collect()
    assert [(r["field"], r["pos"], r["value"]) for r in long] == [
        ("li", 0, "a"), ("li", 1, "b"), ("li", 2, "c"), ("title", 0, "T1"), ("none", None, None)]
    row = wide.select(*[X.collapse(F.col(c)).alias(c) for c in ("li", "title", "none")]).first()
    assert tuple(row) == ('["a","b","c"]', "T1", None)
    coverage = {r["field"]: tuple(r)[1:] for r in X.field_coverage(wide, ["li", "title", "none"]).collect()}
    assert coverage == {"li": (0, 0, 1), "title": (0, 1, 0), "none": (1, 0, 0)}


def test_table_function(spark, page):
    X.register_extract_fields(spark)
    page().createOrReplaceTempView("one_page")
    rows = spark.sql("""SELECT field, pos, value FROM one_page, LATERAL extract_fields(html, '{"li": "li"}', 'css')""").collect()
    assert [tuple(r) for r in rows] == [("li", 0, "a"), ("li", 1, "b"), ("li", 2, "c")]


def test_next_pages_and_chains(spark):
    def html(n):
        return f'<a class="next" href="/p{n}">next</a><a href="/other">o</a>'
    pages = spark.createDataFrame([(i, f"http://h/p{i}", html(i + 1)) for i in range(1, 5)], "page_id int, url string, html string")
    fresh = X.next_pages(pages, "a.next::attr(href)", pages).collect()
    assert [r["dst_url"] for r in fresh] == ["http://h/p5"]
    chain = X.follow_pages(pages, "a.next::attr(href)", pages.where("page_id = 1"), 3).orderBy("depth").collect()
    assert [(r["depth"], r["url"]) for r in chain] == [(1, "http://h/p1"), (2, "http://h/p2"), (3, "http://h/p3")]


def chain_pages(spark, links):
    rows = [(i, f"http://h/p{i}", "".join(f'<a class="next" href="/p{j}">n</a>' for j in after)) for i, after in links.items()]
    return spark.createDataFrame(rows, "page_id int, url string, html string")


def plain_chain(links, start, most):
    """Breadth first, in plain Python."""
    depth, border = {start: 1}, [start]
    while border and depth[border[0]] < most:
        border = list(dict.fromkeys(j for i in border for j in links.get(i, []) if j not in depth))
        depth.update(dict.fromkeys(border, max(depth.values()) + 1))
    return {(start, d, i) for i, d in depth.items()}


@pytest.mark.parametrize("most", [1, 2, 7, 64, 100, 1000])
@pytest.mark.parametrize("kind", ["line", "cycles", "branches"])
def test_chains_of_any_length(spark, monkeypatch, kind, most):
    """Long lines, cycles with tails, and pages with two next ones, against a plain search; lines take few rounds."""
    links = {i: [i + 1] for i in range(130)}
    if kind == "cycles":
        links = {i: [i + 1] if i % 40 != 39 else [i - 30] for i in range(120)} | {200: [200], 201: []}
    if kind == "branches":
        links = {i: [2 * i, 2 * i + 1] if i < 30 else [i // 2] for i in range(1, 61)}
        most = min(most, 7)
    rounds = []
    from trawlframe import session
    inner = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: rounds.append(1) or inner(df))
    starts = [i for i in (0, 1, 5, 41, 79, 200, 999) if i in links or i == 999]
    got = X.follow_pages(chain_pages(spark, links), "a.next::attr(href)", spark.createDataFrame([(f"http://h/p{i}",) for i in starts], "url string"), most)
    number = lambda url: int(url.rsplit("/p", 1)[1])
    assert {(number(r["start_url"]), r["depth"], number(r["url"])) for r in got.collect()} == set().union(*(plain_chain(links, i, most) for i in starts))
    assert kind == "branches" or len(rounds) <= 20


def test_item_limit_never_cuts_a_page(spark):
    rows = [("t", i, n) for i, n in enumerate([3, 4, 5, 1])] + [("u", 0, 1)]
    kept = X.until_max_items(spark.createDataFrame(rows, "task string, pos int, n int"), "task", ["pos"], "n", 6)
    assert sorted((r["task"], r["pos"]) for r in kept.collect()) == [("t", 0), ("t", 1), ("u", 0)]


def tree_values(html, rule, kind="css"):
    return htmltree.Page(html).values(htmltree.compile_rule(rule, kind))


LIST = ('<div id="d"><p class="x">one</p><p>two</p><p class="x" data-k="a, b">three</p></div>'
        '<ul class="list"><li class="x">1</li><li>2</li><li class="x">3</li></ul><a href="/u">link</a><b>bold</b>')


@pytest.mark.parametrize("rule, values", [
    ("li:nth-child(2)", ["2"]), ("li:nth-child(odd)", ["1", "3"]), ("li:nth-child(2n)", ["2"]), ("li:first-child", ["1"]), ("li:last-child", ["3"]),
    ("li:nth-last-child(2)", ["2"]), ("li:nth-child(-n+2)", ["1", "2"]), ("li:not(.x)", ["2"]), ("p:not([data-k])", ["one", "two"]), ("p.x + p", ["two"]),
    ("p.x ~ p", ["two", "three"]), ("div + ul > li.x", ["1", "3"]), ('p[data-k="a, b"], b', ["three", "bold"]), ("a::attr(href), b::text", ["/u", "bold"]),
    ("a, a::attr(href)", ["/u"]), ("ul ~ a", ["link"])])
def test_more_css(rule, values):
    assert tree_values(LIST, rule) == values


@pytest.mark.parametrize("rule, values", [
    ("count(//ul[@class='list']/li)", ["3"]), ("//li[last()]", ["3"]), ("//li[position()=2]", ["2"]), ("//b//text()", ["bold"]), ("//a//@href", ["/u"]), ("//ul//text()", ["1", "2", "3"]),
    ("//p[@class='x' and @data-k]", ["three"]), ("//li[1]/../li[2]", ["2"]), ("//p[1]/following-sibling::p", ["two", "three"]),
    ("//p[1]/following-sibling::p[1]", ["two"]), ("//p[starts-with(@data-k,'a')]", ["three"]), ("//li[text()='2']", ["2"]),
    ("//p[contains(text(),'re')]", ["three"]), ("//li[@class][@class='x']", ["1", "3"]), ("//li[1][@class='y']", []), ("//li[@class='x'][2]", ["3"]),
    ("//p[not(@class)]", ["two"]), ("//a/@href | //b/text()", ["/u", "bold"]), ("//p[@data-k='a, b']", ["three"]), ("//li[@class!='x']", [])])
def test_more_paths(rule, values):
    assert tree_values(LIST, rule, "xpath") == values


def test_rules_that_cannot_be_used(page):
    assert set(X.rule_errors({"a": "p:hover", "b": "p", "c": "a::before("})) == {"a", "c"}
    with pytest.warns(UserWarning, match="will be null"):
        assert fields(page(), {"a": "p:hover", "b": "title"})["a"] is None
    with pytest.raises(ValueError):
        X.extract_items(page(), "p:hover", {"a": "a"})


def test_strange_declarations_spoil_nothing(page):
    for html in ("<![foo[x]]><title>T</title>", "<![if IE]><title>T</title><![endif]>", "<!DOCTYPE html [<!ELEMENT a>]><title>T</title>", "<![CDATA[x]]><title>T</title>"):
        assert fields(page(html), {"title": "title"})["title"] == ["T"], html
    htmltree.Page("<![" + "<!x" * 100)


def test_nested_elements_take_linear_time():
    html = "<div>" * 8_000 + "x"
    parsed, started = htmltree.Page(html), time.process_time()
    assert len(parsed.nodes(htmltree.compile_css("div div"))) == 7_999
    assert len(parsed.nodes(htmltree.compile_css("div > div"))) == 7_999
    assert len(parsed.nodes(htmltree.compile_xpath("//div//div[1]"))) == 7_999
    assert time.process_time() - started < 1


def test_references_and_open_comments_both_ways(page):
    html = """<a href="/a?x=1&#038;y=2">a</a><a href="/b&#x2F;c&#X41;">b</a><a href='/caf&eacute;&apos;'>c</a><a href="/d&amp;lt;&#38;gt;">d</a><a href=/e&quot;f>e</a>
      <a href="/&#128512;">g</a><a href="/plain&x=1">h</a><!-- open <a href="/gone">x</a>"""
    both = [[r["dst_url"] for r in e.orderBy("pos").collect()] for e in (X.page_links(page(html)), X.parsed_references(page(html), "a::attr(href)"))]
    assert both[0] == both[1]
    assert both[0] == ["https://ex.com/" + x for x in ("a?x=1&y=2", "b/cA", "café'", "d&lt;&gt;", 'e"f', "😀", "plain&x=1")]
    html = """<a href="/a">a</a><script>var x = '<a href="/gone">'; """
    both = [[r["dst_url"] for r in e.collect()] for e in (X.page_links(page(html)), X.parsed_references(page(html), "a::attr(href)"))]
    assert both[0] == both[1] == ["https://ex.com/a"]


def test_pages_that_cannot_be_parsed_say_so(spark, monkeypatch):
    """What was read before the error stays; other pages have none."""
    pages = spark.createDataFrame([(1, "<h1>a</h1>"), (2, "<h1>b</h1><bad>")], "page_id int, html string")

    def no_bad(self, tag, attrs, start=X.Page.handle_starttag):
        if tag == "bad":
            raise ValueError("bad tag")
        start(self, tag, attrs)

    monkeypatch.setattr(X.Page, "handle_starttag", no_bad)
    rows = X.extract_fields(pages, {"h": "h1::text"}, parse_error="why").collect()
    assert [(r["page_id"], r["h"], r["why"]) for r in sorted(rows)] == [(1, ["a"], None), (2, ["b"], "ValueError: bad tag")]
    assert X.extract_fields(pages, {"h": "h1"}).columns == ["page_id", "h"]
    assert X.extract_fields(pages, {}, parse_error="why").columns == ["page_id", "why"]
