"""Facts from pages: fields by rule, links, images, item lists.

Two ways in. Rules need a parse: one Arrow pass parses each page once, emits
every requested field and drops the html before anything is shuffled. Links and
images of a page need only its tags and stay native.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.functions.cleaners import normalize_whitespace, remove_html
from trawlframe.functions.htmltree import Page, compile_rule
from trawlframe.functions.urls import let, resolve_on, site_of
from trawlframe.operators.ordered import running

_STRINGS = T.ArrayType(T.StringType())


def rule_errors(rules: dict[str, str], selector_type: str = "css") -> dict[str, str]:
    """Field → what is wrong with its rule, for rules that cannot be used."""
    out = {}
    for field, selector in rules.items():
        try:
            compile_rule(selector, selector_type)
        except ValueError as e:
            out[field] = str(e)
    return out


def _compiled(rules: dict[str, str], selector_type: str) -> dict:
    """A rule that cannot be used makes its field null, with a warning when the plan is built."""
    wrong = rule_errors(rules, selector_type)
    for field, error in wrong.items():
        warnings.warn(f"field {field!r} will be null: {error}", stacklevel=3)
    return {f: None if f in wrong else compile_rule(s, selector_type) for f, s in rules.items()}


def _check_type(selector_type: str) -> None:
    if selector_type.lower() not in ("css", "xpath"):
        raise ValueError(f"selector type not supported: {selector_type}")


def clean_values(values: Column, clean_whitespace: bool = True, clean_html: bool = True) -> Column:
    """Collapses white space, then strips leftover tags, per value."""
    if clean_whitespace:
        values = F.transform(values, normalize_whitespace)
    if clean_html:
        values = F.transform(values, remove_html)
    return values


def extract_fields(
    pages: DataFrame,
    rules: dict[str, str],
    selector_type: str = "css",
    *,
    keep: list[str] | None = None,
    html: str = "html",
    clean_whitespace: bool = True,
    clean_html: bool = True,
    parse_error: str | None = None,
) -> DataFrame:
    """One row per page: the kept columns plus one ARRAY<STRING> per rule, null
    where nothing matched. Without rules there are no rows. With ``parse_error`` a
    text column of that name comes last: why a page could be read in part only, null for others."""
    _check_type(selector_type)
    keep = keep if keep is not None else [c for c in pages.columns if c != html]
    out = T.StructType([pages.schema[c] for c in keep] + [T.StructField(f, _STRINGS) for f in rules])
    if parse_error:
        out = out.add(parse_error, "string")
    if not rules:
        none = [F.lit(None).cast("string").alias(parse_error)] if parse_error else []
        return pages.select(*keep, *none).where(F.lit(False))
    compiled = _compiled(rules, selector_type)
    fields = list(compiled)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {f: [] for f in fields}
            errors: list[str | None] = []
            for text in batch.column(html).to_pylist():
                page = Page(text or "")
                errors.append(page.error)
                for f in fields:
                    found = page.values(compiled[f]) if compiled[f] else []
                    columns[f].append(found or None)
            said = [pa.array(errors, pa.string())] if parse_error else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(columns[f], pa.list_(pa.string())) for f in fields] + said,
                names=out.names)

    parsed = pages.select(*keep, html).mapInArrow(parse, out)
    return parsed.withColumns({f: clean_values(F.col(f), clean_whitespace, clean_html) for f in fields})


def long_form(wide: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """``ids, field, pos, value``: one row per value, one with nulls for a field
    without any."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in fields]))
    return (wide.select(*ids, pairs.alias("_p"))
            .select(*ids, F.col("_p.field").alias("field"), F.posexplode_outer("_p.values").alias("pos", "value")))


def collapse(values: Column) -> Column:
    """Export form as JSON text: no value -> null, one -> the value, more -> list."""
    return F.when(F.size(values) == 1, values[0]).when(F.size(values) > 1, F.to_json(values))


def field_coverage(wide: DataFrame, fields: list[str]) -> DataFrame:
    """Per rule: pages with no value, one value, several values."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.coalesce(F.size(F.col(f)), F.lit(0)).alias("n")) for f in fields]))
    n = F.greatest(F.col("_p.n"), F.lit(0))
    return (wide.select(pairs.alias("_p")).select(F.col("_p.field").alias("field"), n.alias("n"))
            .groupBy("field").agg(
                F.count_if(F.col("n") == 0).alias("null_pages"),
                F.count_if(F.col("n") == 1).alias("scalar_pages"),
                F.count_if(F.col("n") > 1).alias("list_pages")))


def extract_items(
    pages: DataFrame,
    container: str,
    rules: dict[str, str],
    selector_type: str = "css",
    *,
    keep: list[str] | None = None,
    html: str = "html",
) -> DataFrame:
    """One row per element the container selects, with the rules applied inside
    it: kept columns, item_pos, one ARRAY<STRING> per rule."""
    _check_type(selector_type)
    keep = keep if keep is not None else [c for c in pages.columns if c != html]
    box = compile_rule(container, selector_type)
    compiled = _compiled(rules, selector_type)
    fields = list(compiled)
    out = T.StructType([pages.schema[c] for c in keep] + [T.StructField("item_pos", T.IntegerType())]
                       + [T.StructField(f, _STRINGS) for f in fields])

    def parse(batches):
        for batch in batches:
            source, positions = [], []
            columns: dict[str, list] = {f: [] for f in fields}
            for row, text in enumerate(batch.column(html).to_pylist()):
                page = Page(text or "")
                nodes = page.nodes(box)
                for position, node in enumerate(nodes):
                    source.append(row)
                    positions.append(position)
                    for f in fields:
                        found = page.values(compiled[f], node) if compiled[f] else []
                        columns[f].append(found or None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(source, pa.int64())) for c in keep]
                + [pa.array(positions, pa.int32())]
                + [pa.array(columns[f], pa.list_(pa.string())) for f in fields],
                names=[*keep, "item_pos", *fields])

    parsed = pages.select(*keep, html).mapInArrow(parse, out)
    return parsed.withColumns({f: clean_values(F.col(f)) for f in fields})


# Names of character references and what they stand for, from the standard library's table.
_NAMED = {f"&{name};": chr(code) for name, code in {**name2codepoint, "apos": 39}.items()}


def decoded(value: Column) -> Column:
    """Character references of an attribute value as characters: decimal, hexadecimal and named, each with its semicolon."""
    named = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])

    def character(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
        code = F.when(ref.rlike("^&#[xX]"), digits).otherwise(F.conv(digits, 10, 16))
        plain = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        usable = F.length(code) <= 6
        return F.when(ref.startswith("&#"), F.when(usable, plain)).otherwise(F.try_element_at(named, ref))

    found = F.array_distinct(F.regexp_extract_all(value, F.lit("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"), F.lit(0)))
    pairs = F.filter(F.transform(found, lambda r: F.struct(r.alias("ref"), character(r).alias("char"))), lambda p: p["char"].isNotNull())
    # An ampersand is put in last, so that what it begins is not read as a reference again.
    ordered = F.concat(F.filter(pairs, lambda p: p["char"] != "&"), F.filter(pairs, lambda p: p["char"] == "&"))
    return F.when(value.contains("&"), F.aggregate(ordered, value, lambda v, p: F.replace(v, p["ref"], p["char"]))).otherwise(value)


def tag_attribute(html: Column, tag: str, attribute: str) -> Column:
    """Values of an attribute over all such start tags, in document order.

    Tag scan without a tree: comments and raw-text elements are cut out first (an open one runs to the
    end of the page), any quoting style and character references are understood.
    """
    visible = F.regexp_replace(
        html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|template)\b.*?(?:</\1\s*>|\z)", " ")
    between = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*?"""
    pattern = rf"""(?i)<{tag}(?=\s){between}\s{attribute}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    raw = F.regexp_extract_all(visible, F.lit(pattern), F.lit(1))
    return F.transform(raw, lambda v: decoded(F.regexp_replace(v, r"""^["']|["']$""", "")))


def absolute(base: Column, references: Column) -> Column:
    """``http…`` kept, ``/…`` resolved against the page, others dropped; distinct."""
    kept = F.filter(references, lambda h: h.startswith("http") | h.startswith("/"))
    urls = let(site_of(base), lambda site: F.transform(
        kept, lambda h: F.when(h.startswith("http"), h).otherwise(resolve_on(site, h))))
    return F.array_distinct(urls)


def _edges(pages: DataFrame, urls: Column, keep: list[str]) -> DataFrame:
    return (pages.select(*keep, F.posexplode(urls).alias("pos", "dst_url"))
            .withColumnRenamed("url", "src_url"))


def page_links(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Edge table ``page_id, src_url, pos, dst_url`` of the links of each page."""
    keep = keep or ["page_id", "url"]
    return _edges(pages, absolute(F.col("url"), tag_attribute(F.col("html"), "a", "href")), keep)


def page_images(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """As page_links, for image sources."""
    keep = keep or ["page_id", "url"]
    return _edges(pages, absolute(F.col("url"), tag_attribute(F.col("html"), "img", "src")), keep)


def parsed_references(pages: DataFrame, selector: str, keep: list[str] | None = None) -> DataFrame:
    """As page_links, through the parser: any selector that ends in ::attr()."""
    keep = keep or ["page_id", "url"]
    wide = extract_fields(pages, {"_refs": selector}, keep=keep, clean_whitespace=False, clean_html=False)
    return _edges(wide, absolute(F.col("url"), F.col("_refs")), keep)


def until_max_items(items: DataFrame, task: str, order: list[str], n: str, max_items: int) -> DataFrame:
    """Pages of a task up to the one that reaches ``max_items`` records; the cut
    never falls inside a page."""
    counted = running(items, [task], order, sums={"_through": F.col(n).cast("long")})
    return counted.where(F.col("_through") - F.col(n) < max_items).drop("_through")


def next_pages(pages: DataFrame, selector: str, crawled: DataFrame | None = None) -> DataFrame:
    """Next-page links not crawled yet: ``page_id, src_url, dst_url``."""
    found = parsed_references(pages, selector).select("page_id", "src_url", "dst_url")
    if crawled is None:
        return found
    return found.join(crawled.select(F.col("url").alias("dst_url")), "dst_url", "left_anti")


def follow_pages(pages: DataFrame, selector: str, start: DataFrame, max_pages: int) -> DataFrame:
    """Chains of next-page links from ``start(url)`` within ``pages``, at most
    ``max_pages`` long: ``start_url, depth, url``. Each page is parsed once. A page met again, in a cycle, keeps its first depth.

    Where no page has two next pages, the rounds double: a table of jumps over 2, 4, 8, … links is joined with itself and
    with what was reached, so a chain of a thousand pages takes ten rounds. Where pages branch, such a
    table could hold all pairs; there a round is a link. Either way rounds join slim url pairs and are cut off from their lineage.
    """
    from trawlframe.session import cut_lineage

    links = cut_lineage(parsed_references(pages, selector).select("src_url", "dst_url").distinct())
    reached = start.select(F.col("url").alias("start_url"), F.lit(1).alias("depth"), "url").distinct()
    if links.groupBy("src_url").count().where("count > 1").isEmpty():
        return _doubled(links, reached, max_pages)
    frontier = reached
    for depth in range(2, max_pages + 1):
        step = (frontier.join(links, frontier["url"] == links["src_url"])
                .select("start_url", F.lit(depth).alias("depth"), F.col("dst_url").alias("url")).distinct())
        step = cut_lineage(step.join(reached.select("start_url", "url"), ["start_url", "url"], "left_anti"))
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
        frontier = step
    return reached


def _doubled(jumps: DataFrame, reached: DataFrame, max_pages: int) -> DataFrame:
    """What ``reached`` (start_url, depth, url) leads to over ``jumps`` (src_url, dst_url), one from each url at most."""
    from trawlframe.session import cut_lineage

    span, known = 1, -1
    while span < max_pages:
        ahead = (reached.join(jumps, reached["url"] == jumps["src_url"])
                 .select("start_url", (F.col("depth") + span).alias("depth"), F.col("dst_url").alias("url")).where(F.col("depth") <= max_pages))
        reached = cut_lineage(reached.unionByName(ahead).groupBy("start_url", "url").agg(F.min("depth").alias("depth")).select("start_url", "depth", "url"))
        if (now := reached.count()) == known:  # all chains have ended or come back
            break
        known, span = now, 2 * span
        if span < max_pages:
            first, second = jumps.withColumnRenamed("dst_url", "by"), jumps.withColumnRenamed("src_url", "by")
            jumps = cut_lineage(first.join(second, "by").select("src_url", "dst_url"))
    return reached


def register_extract_fields(spark: SparkSession, name: str = "extract_fields") -> None:
    """SQL form: ``SELECT … FROM pages, LATERAL extract_fields(html, rules, type)``
    with rules as a JSON object; rows ``field, pos, value``."""
    @F.udtf(returnType="field string, pos int, value string")
    class ExtractFields:
        def __init__(self):
            self.compiled: dict = {}

        def eval(self, html: str, rules: str, selector_type: str):
            if (rules, selector_type) not in self.compiled:
                self.compiled[rules, selector_type] = _compiled(json.loads(rules), selector_type)
            page = Page(html or "")
            for field, rule in self.compiled[rules, selector_type].items():
                for pos, value in enumerate(page.values(rule) if rule else []):
                    yield field, pos, value

    spark.udtf.register(name, ExtractFields)
