"""Extraction, cleaning, validation and masking of page and document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlframe.functions import cleaners as C
from trawlframe.functions import patterns as P
from trawlframe.functions import validators as V
from trawlframe.operators import extraction as X
from trawlframe.operators import records as G
from trawlframe.operators import requests as R
from trawlframe.operators import validation as VAL
from trawlframe.plans.bindings import EDGES_SQL, pages, table
from trawlframe.plans.registry import query

# In SQL \\w, \\d and \\b are ASCII only; this stands for a Unicode word edge.
_LEFT = r"(?:^|[^\p{L}\p{N}_])"
_SQL_PATTERNS = {name: p.replace(r"\w", r"\p{L}\p{N}_") for name, p in P.PATTERNS.items()}


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _sql_all(name: str, text: str = "text") -> str:
    """Distinct sorted matches in SQL; a leading word edge is a character of context."""
    p = _SQL_PATTERNS[name]
    if p.startswith(r"\b"):
        body = p.removeprefix(r"\b").removesuffix(r"\b")
        found = f"regexp_extract_all({text}, '{_LEFT}({body})(?:\\b)', 1)"
    else:
        found = f"regexp_extract_all({text}, '{p}')"
    return f"list_sort(list_distinct({found}))"


# Patterns the documents hold no match for, bound to texts that do.
_PATTERN_TEXTS = {
    "phone": ("customer", "c_custkey", "concat('tel 555.', 100 + c_custkey % 900, '-4321, ', c_name)", "'tel 555.' || (100 + c_custkey % 900) || '-4321, ' || c_name"),
    "url": ("pages", "page_id", "concat('see ', url, ' or ', url, '/x;y')", "'see ' || url || ' or ' || url || '/x;y'"),
    "date": ("orders", "o_orderkey", "concat('due ', cast(o_orderdate as string))", "'due ' || CAST(o_orderdate AS VARCHAR)"),
    "time": ("events", "event_id", "cast(ts as string)", "CAST(ts AS VARCHAR)"),
    "zipcode": ("orders", "o_orderkey", "concat('at ', o_custkey + 9990, '-12345')", "'at ' || (o_custkey + 9990) || '-12345'"),
    "guid": ("part", "p_partkey", "regexp_replace(md5(p_name), '^(.{8})(.{4})(.{4})(.{4})', '$1-$2-$3-$4-')",
             "regexp_replace(md5(p_name), '^(.{8})(.{4})(.{4})(.{4})', '\\1-\\2-\\3-\\4-')"),
}


def _register_pattern(name: str) -> None:
    source, key, text, sql_text = _PATTERN_TEXTS.get(name, ("documents", "doc_id", "text", "text"))

    @query(f"pattern_{name}", f"SELECT {key}, unnest({_sql_all(name, 't')}) AS match FROM (SELECT {key}, {sql_text} AS t FROM {source})")
    def run(spark, sf_dir):
        texts = table(spark, sf_dir, source).select(key, F.expr(text).alias("t"))
        return texts.select(key, F.explode(P.extract_named(F.col("t"), name)).alias("match"))


for _name in P.PATTERNS:
    _register_pattern(_name)


@query("pattern_first_match", rf"""
SELECT doc_id, nullif(regexp_extract(text, '{_LEFT}({_SQL_PATTERNS['email'][2:-2]})\b', 1), '') AS first_email,
  nullif(regexp_extract(text, '\$?[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]{{2}})?'), '') AS first_price, NULL::VARCHAR AS unknown FROM documents""")
def pattern_first_match(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", P.extract_named(text, "email", first=True).alias("first_email"),
        P.extract_named(text, "price", first=True).alias("first_price"),
        P.extract_named(text, "no such pattern", first=True).alias("unknown"))


@query("email_addresses", f"SELECT doc_id, array_to_string({_sql_all('email')}, ' ') AS emails FROM documents")
def email_addresses(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(P.emails(F.col("text")), " ").alias("emails"))


@query("phone_numbers", f"SELECT doc_id, array_to_string({_sql_all('phone')}, ' ') AS phones FROM documents")
def phone_numbers(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(P.phone_numbers(F.col("text")), " ").alias("phones"))


@query("regex_matches", r"""
SELECT event_id, array_to_string(regexp_extract_all(props, '\{"k"'), ' ') AS whole, array_to_string(regexp_extract_all(props, '": ([0-9]+)', 1), ' ') AS one_group,
  regexp_extract(props, '"(\w+)": ([0-9]+)', 1) || '=' || regexp_extract(props, '"(\w+)": ([0-9]+)', 2) AS two_groups FROM events""")
def regex_matches(spark, sf_dir):
    props = F.col("props")
    pair = P.find_all(props, r'"(\w+)": (\d+)')[0]
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(P.find_all(props, r'\{"k"'), " ").alias("whole"),
        F.array_join(P.find_all(props, r'": (\d+)'), " ").alias("one_group"),
        F.concat(pair["g1"], F.lit("="), pair["g2"]).alias("two_groups"))


_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
_CLEANER_SQL = {
    "trim": f"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')",
    "remove_whitespace": f"regexp_replace(text, '{_WS}+', '', 'g')",
    "remove_html": "regexp_replace(text, '<.*?>', '', 'g')",
    "normalize_whitespace": f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))",
    "to_lower": "lower(text)",
    "to_upper": "replace(replace(upper(text), 'ß', 'SS'), 'ẞ', 'SS')",
    "remove_special_chars": rf"regexp_replace(text, '[^{_WORD}\s\x1c-\x1f\x{{85}}\p{{Z}}_.@\-]', '', 'g')",
    "extract_numbers": r"regexp_replace(text, '\P{Nd}+', '', 'g')",
    "extract_letters": "regexp_replace(text, '[^a-zA-Z]+', '', 'g')",
    "remove_numbers": r"regexp_replace(text, '\p{Nd}+', '', 'g')",
    "capitalize": "upper(substr(text, 1, 1)) || lower(substr(text, 2))",
    "title_case": r"""array_to_string(list_transform(regexp_extract_all(text, '[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+'),
        lambda t: replace(replace(upper(substr(t, 1, 1)), 'ẞ', 'Ss'), 'ß', 'Ss') || lower(substr(t, 2))), '')""",
}


def _register_cleaner(name: str) -> None:
    sql = _CLEANER_SQL.get(name)

    @query(f"cleaner_{name}", sql and f"SELECT doc_id, md5({sql}) AS cleaned_md5, length({sql}) AS cleaned_length FROM documents")
    def run(spark, sf_dir):
        cleaned = C.clean(F.col("text"), [name])
        return (_documents(spark, sf_dir).select("doc_id", cleaned.alias("v"))
                .select("doc_id", F.md5("v").alias("cleaned_md5"), F.length("v").cast("long").alias("cleaned_length")))


for _name in C.CLEANERS:
    if _name != "normalize_unicode":
        _register_cleaner(_name)

# Compatibility characters and their NFKC forms.
_COMPATIBLE = (("ﬁ", "fi"), ("①", "1"), ("Ａ", "A"), ("²", "2"), ("…", "..."), ("㎏", "kg"), ("e\u0301", "é"), ("Å", "Å"))
_NFKC_SQL = "c_name || ' ' || CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{form}'" for i, (_, form) in enumerate(_COMPATIBLE)) + " END || c_mktsegment"


@query("cleaner_normalize_unicode", f"SELECT c_custkey, md5({_NFKC_SQL}) AS cleaned_md5, length({_NFKC_SQL}) AS cleaned_length FROM customer")
def cleaner_normalize_unicode(spark, sf_dir):
    """Names with a compatibility character mixed in; the forms are listed, as the SQL engine has no NFKC."""
    listed = F.array(*[F.lit(c) for c, _ in _COMPATIBLE])
    mixed = F.concat("c_name", F.lit(" "), F.element_at(listed, (F.col("c_custkey") % 8 + 1).cast("int")), "c_mktsegment")
    cleaned = C.clean(mixed, ["normalize_unicode"])
    return (spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", cleaned.alias("v"))
            .select("c_custkey", F.md5("v").alias("cleaned_md5"), F.length("v").cast("long").alias("cleaned_length")))


@query("cleaner_chain", f"""
SELECT page_id, md5(lower(regexp_replace(trim(regexp_replace(html, '{_WS}+', ' ', 'g')), '<.*?>', '', 'g'))) AS cleaned_md5 FROM pages""")
def cleaner_chain(spark, sf_dir):
    chain = ["normalize_whitespace", "remove_html", "no such cleaner", "to_lower"]
    return pages(spark, sf_dir).select("page_id", F.md5(C.clean(F.col("html"), chain)).alias("cleaned_md5"))


@query("cleaner_null_as_text", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE lower(o_orderstatus) END AS kept, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE lower(o_orderstatus) END AS compat FROM orders""")
def cleaner_null_as_text(spark, sf_dir):
    v = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", C.clean(v, ["trim", "to_lower"]).alias("kept"), C.clean(v, ["trim", "to_lower"], compat_null=True).alias("compat"))


@query("clean_batch", f"""
SELECT doc_id, md5(regexp_replace({_CLEANER_SQL['trim']}, '<.*?>', '', 'g')) AS text_md5, upper(lang) AS lang, source, '' AS summary FROM documents""")
def clean_batch(spark, sf_dir):
    cleaned = C.clean_columns(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"),
                              {"text": ["trim", "remove_html"], "lang": ["to_upper"], "summary": ["trim"]})
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "summary")


@query("post_clean_values", r"""
SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<p>(.*?)</p>', 1), lambda v: md5(regexp_replace(trim(regexp_replace(v, '[\s\x{85}\p{Z}]+', ' ', 'g')), '<.*?>', '', 'g')))) AS value_md5 FROM pages""")
def post_clean_values(spark, sf_dir):
    raw = F.regexp_extract_all(F.col("html"), F.lit("(?d)<p>(.*?)</p>"), F.lit(1))
    return (pages(spark, sf_dir).select("page_id", F.explode(X.clean_values(raw)).alias("v"))
            .select("page_id", F.md5("v").alias("value_md5")))


# Validators, over text columns of several tables.
_VALIDATOR_VALUES = {
    "email": ("documents", "doc_id", "if(instr(text, '@') > 8, substr(text, instr(text, '@') - 8), text)",
              "CASE WHEN instr(text, '@') > 8 THEN substr(text, instr(text, '@') - 8) ELSE text END"),
    "url": ("pages", "page_id", "concat('  ', if(page_id % 3 = 0, substr(url, 6), url))", "'  ' || CASE WHEN page_id % 3 = 0 THEN substr(url, 6) ELSE url END"),
    "phone": ("customer", "c_custkey", "concat('555-010-', cast(c_custkey + 1000 as string))", "'555-010-' || (c_custkey + 1000)"),
    "date": ("orders", "o_orderkey", "cast(o_orderdate as string)", "CAST(o_orderdate AS VARCHAR)"),
    "number": ("events", "event_id", "concat(' ', cast(event_id as string), if(event_id % 4 = 0, 'd', if(event_id % 4 = 1, '.5e3', '_000')))",
               "' ' || event_id || CASE event_id % 4 WHEN 0 THEN 'd' WHEN 1 THEN '.5e3' ELSE '_000' END"),
    "integer": ("events", "event_id", "concat('+', cast(event_id as string), if(event_id % 4 = 0, '.5', if(event_id % 4 = 1, '_', '_000')))",
                "'+' || event_id || CASE event_id % 4 WHEN 0 THEN '.5' WHEN 1 THEN '_' ELSE '_000' END"),
    "float": ("events", "event_id", "if(event_id % 3 = 0, '-Infinity', concat('.', cast(event_id as string), if(event_id % 3 = 1, 'e', '')))",
              "CASE event_id % 3 WHEN 0 THEN '-Infinity' WHEN 1 THEN '.' || event_id || 'e' ELSE '.' || event_id END"),
    "boolean": ("events", "event_id", "element_at(array('Yes', 'TRUE', '0', 'n', ''), cast(event_id % 5 + 1 as int))",
                "(['Yes', 'TRUE', '0', 'n', ''])[event_id % 5 + 1]"),
    "json": ("events", "event_id", "if(event_id % 3 = 0, substr(props, 2), props)", "CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END"),
    "ip_address": ("documents", "doc_id", "regexp_extract(text, '[0-9]+[.][0-9]+[.][0-9.]+', 0)", "regexp_extract(text, '[0-9]+[.][0-9]+[.][0-9.]+')"),
    "credit_card": ("documents", "doc_id", "regexp_extract(text, '[0-9]{4}[- ][0-9 -]+', 0)", "regexp_extract(text, '[0-9]{4}[- ][0-9 -]+')"),
    "chinese_phone": ("documents", "doc_id", "regexp_extract(text, '[0-9]{11}', 0)", "regexp_extract(text, '[0-9]{11}')"),
    "price": ("part", "p_partkey", "if(p_partkey % 2 = 0, concat('$', cast(p_retailprice as string)), p_name)",
              "CASE WHEN p_partkey % 2 = 0 THEN '$' || p_retailprice ELSE p_name END"),
    "zipcode": ("orders", "o_orderkey", "concat(cast(o_custkey + 9990 as string), if(o_orderkey % 2 = 0, '-1234', ''))",
                "(o_custkey + 9990) || CASE WHEN o_orderkey % 2 = 0 THEN '-1234' ELSE '' END"),
    "hex_color": ("orders", "o_orderkey", "substr(md5(cast(o_orderkey as string)), 1, cast(4 + o_orderkey % 6 as int))",
                  "substr(md5(CAST(o_orderkey AS VARCHAR)), 1, CAST(4 + o_orderkey % 6 AS INTEGER))"),
}
_D = "[0-9](?:_?[0-9])*"
_VALIDATOR_SQL = {
    "url": "regexp_matches(trim(v), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')",
    "number": rf"regexp_matches(lower(v), '^\s*[+-]?(?:(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:e[+-]?{_D})?|inf|infinity|nan)\s*$')",
    "integer": rf"regexp_matches(v, '^\s*[+-]?{_D}\s*$')",
    "boolean": "lower(v) IN ('true', 'false', '1', '0', 'yes', 'no')",
    "json": "json_valid(v)",
}
_VALIDATOR_SQL["float"] = _VALIDATOR_SQL["number"]


def _register_validator(name: str) -> None:
    source, key, value, sql_value = _VALIDATOR_VALUES[name]
    pattern = P.PATTERNS.get("ip" if name == "ip_address" else name, "")
    check = _VALIDATOR_SQL.get(name) or f"regexp_matches(trim(v), '^(?:{pattern})')"

    @query(f"validator_{name}", f"SELECT {key}, v, coalesce({check}, false) AS valid FROM (SELECT {key}, {sql_value} AS v FROM {source})")
    def run(spark, sf_dir):
        values = table(spark, sf_dir, source).select(key, F.expr(value).alias("v"))
        return values.withColumn("valid", V.is_valid(F.col("v"), name))


for _name in _VALIDATOR_VALUES:
    _register_validator(_name)


def _typed_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "value", "user_id", F.array("event_type").alias("list"), F.struct("user_id").alias("record"),
                    "event_type", (F.col("user_id") > 75).alias("flag"))


@query("validators_by_column_type", """
SELECT event_id, true AS number_ok, true AS integer_ok, user_id IN (0, 1) AS boolean_number_ok, true AS boolean_ok,
  true AS array_ok, true AS object_ok, true AS string_ok, false AS text_as_array FROM events""")
def validators_by_column_type(spark, sf_dir):
    df = _typed_values(spark, sf_dir)
    check = lambda c, name: V.is_valid(F.col(c), name, df.schema[c].dataType)
    return df.select(
        "event_id", check("value", "number").alias("number_ok"), check("value", "integer").alias("integer_ok"),
        check("user_id", "boolean").alias("boolean_number_ok"), check("flag", "boolean").alias("boolean_ok"),
        check("list", "array").alias("array_ok"), check("record", "object").alias("object_ok"),
        check("event_type", "string").alias("string_ok"), check("event_type", "array").alias("text_as_array"))


@query("json_kinds", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'scalar' END AS kind FROM events""")
def json_kinds(spark, sf_dir):
    k = F.col("event_id") % 4
    text = (F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), F.col("props"), F.lit("]")))
            .when(k == 2, F.col("event_id").cast("string")).otherwise("{"))
    return table(spark, sf_dir, "events").select("event_id", V.json_kind(text).alias("kind"))


# Rule extraction through the parser.
_RULES = {"title": "title", "heading": "article h1", "links": "nav a::attr(href)", "ads": "div.ad", "none": ".nope"}
_PATHS = {"title": "//title/text()", "heading": "//article/h1", "links": "//nav//a/@href", "ads": "//div[@class='ad']", "none": "//nope"}


def _entities(sql: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


_TITLE = f"""trim(regexp_replace({_entities("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g'))"""
_HEADING = f"""trim(regexp_replace({_entities("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '\\s+', ' ', 'g'))"""
_FIELDS_SQL = f"""
SELECT page_id, nullif({_TITLE}, '') AS title, nullif({_HEADING}, '') AS heading,
  len(regexp_extract_all(regexp_extract(html, '<nav>.*</nav>'), '<a href="[^"]')) AS links FROM pages"""


@query("page_fields_css", _FIELDS_SQL)
def page_fields_css(spark, sf_dir):
    wide = X.extract_fields(pages(spark, sf_dir), _RULES, "css", keep=["page_id"])
    return wide.select("page_id", F.nullif(F.col("title")[0], F.lit("")).alias("title"), F.nullif(F.col("heading")[0], F.lit("")).alias("heading"),
                       F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("links"))


@query("page_fields_xpath", _FIELDS_SQL)
def page_fields_xpath(spark, sf_dir):
    wide = X.extract_fields(pages(spark, sf_dir), _PATHS, "XPath", keep=["page_id"])
    return wide.select("page_id", F.nullif(F.col("title")[0], F.lit("")).alias("title"), F.nullif(F.col("heading")[0], F.lit("")).alias("heading"),
                       F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("links"))


def _long_sql(field: str, values: str) -> str:
    return f"""SELECT page_id, '{field}' AS field, CAST(unnest(CASE WHEN len(v) = 0 THEN [NULL] ELSE range(len(v)) END) AS INTEGER) AS pos,
  unnest(CASE WHEN len(v) = 0 THEN [NULL] ELSE v END) AS value FROM (SELECT page_id, {values} AS v FROM pages)"""


def _texts_sql(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(html, '{pattern}', 1), lambda x: trim(regexp_replace({_entities('x')}, '\\s+', ' ', 'g')))"


@query("page_fields_long", " UNION ALL ".join([
    _long_sql("title", _texts_sql("<title>([^<]*)</title>")), _long_sql("heading", _texts_sql("<h1>([^<]*)</h1>")),
    _long_sql("ads", _texts_sql('<div class="ad">([^<]*)</div>')),
    _long_sql("links", """regexp_extract_all(regexp_extract(html, '<nav>.*</nav>'), '<a href="([^"]+)"', 1)"""),
    "SELECT page_id, 'none', NULL, NULL FROM pages"]))
def page_fields_long(spark, sf_dir):
    wide = X.extract_fields(pages(spark, sf_dir), _RULES, keep=["page_id"])
    return X.long_form(wide, ["page_id"], list(_RULES))


@query("page_fields_collapsed", f"""
SELECT page_id, nullif({_TITLE}, '') AS title, NULL::VARCHAR AS none FROM pages""")
def page_fields_collapsed(spark, sf_dir):
    wide = X.extract_fields(pages(spark, sf_dir), _RULES, keep=["page_id"])
    return wide.select("page_id", F.nullif(X.collapse(F.col("title")), F.lit("")).alias("title"), X.collapse(F.col("none")).alias("none"))


@query("field_coverage", """
SELECT 'links' AS field, count(*) FILTER (n = 0) AS null_pages, count(*) FILTER (n = 1) AS scalar_pages, count(*) FILTER (n > 1) AS list_pages
FROM (SELECT len(regexp_extract_all(html, '<a href="[^"]')) AS n FROM pages)
UNION ALL SELECT 'none', count(*), 0, 0 FROM pages""")
def field_coverage(spark, sf_dir):
    rules = {"links": "a::attr(href)", "none": ".nope"}
    return X.field_coverage(X.extract_fields(pages(spark, sf_dir), rules, keep=["page_id"]), list(rules))


@query("page_images", f"SELECT page_id, src_url, pos, dst_url FROM {EDGES_SQL}")
def page_images(spark, sf_dir):
    """The pages hold no images; their links are rewritten into some."""
    drawn = pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", '<a href="', '<img alt="a > b" src="'))
    return X.page_images(drawn)


@query("page_items", """
SELECT page_id, unnest(l) AS href, CAST(unnest(range(len(l))) AS INTEGER) AS item_pos
FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>.*</nav>'), '<li><a href="([^"]*)"', 1) AS l FROM pages)""")
def page_items(spark, sf_dir):
    """One row per navigation entry."""
    items = X.extract_items(pages(spark, sf_dir), "nav li", {"href": "a::attr(href)"}, keep=["page_id"])
    return items.select("page_id", F.col("href")[0].alias("href"), "item_pos")


@query("page_fields_table_function", f"""
SELECT page_id, 'title' AS field, 0 AS pos, {_TITLE} AS value FROM pages WHERE {_TITLE} <> ''""")
def page_fields_table_function(spark, sf_dir):
    X.register_extract_fields(spark)
    pages(spark, sf_dir).createOrReplaceTempView("trawl_pages")
    return spark.sql("""SELECT page_id, field, pos, trim(regexp_replace(value, '\\\\s+', ' ')) AS value FROM trawl_pages,
        LATERAL extract_fields(html, '{"title": "title"}', 'css') WHERE value <> ''""")


# Validation reports.
def _webpages(spark, sf_dir):
    return as_webpages(pages(spark, sf_dir))


def as_webpages(p):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    body = F.regexp_replace(F.regexp_extract("html", "(?s)<body>(.*)</body>", 1), "(?s)<[^>]*>", " ")
    return p.select("page_id", title.alias("title"), "url", body.alias("content"),
                    F.when(F.col("page_id") % 2 == 0, "2024-05-06").otherwise("n/a").alias("publish_date"))


_WEB_SQL = r"""(SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '<.*?>', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_replace(b, '<.*?>', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS content, page_id % 2 = 0 AS dated
  FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t,
        regexp_replace(regexp_extract(html, '<body>(.*)</body>', 1, 's'), '<[^>]*>', ' ', 'g') AS b FROM pages))"""
_WEB_ERRORS = """list_filter([CASE WHEN title = '' THEN 'title:required' WHEN length(title) > 200 THEN 'title:max_length' END,
  CASE WHEN length(content) > 10000 THEN 'content:max_length' END, CASE WHEN NOT dated THEN 'publish_date:type' END], lambda e: e IS NOT NULL)"""


@query("webpage_validation", f"""
SELECT page_id, len({_WEB_ERRORS}) = 0 AS is_valid, array_to_string({_WEB_ERRORS}, ' ') AS errors, md5(title) AS title_md5 FROM {_WEB_SQL}""")
def webpage_validation(spark, sf_dir):
    checked = VAL.validate(_webpages(spark, sf_dir), "basic_webpage")
    errors = F.transform("report.errors", lambda e: F.concat(e["field"], F.lit(":"), e["kind"]))
    return checked.select("page_id", "report.is_valid", F.array_join(errors, " ").alias("errors"),
                          F.md5(F.col("report.cleaned")["title"]).alias("title_md5"))


@query("webpage_rejected", f"SELECT page_id FROM {_WEB_SQL} WHERE len({_WEB_ERRORS}) > 0")
def webpage_rejected(spark, sf_dir):
    return VAL.split(VAL.validate(_webpages(spark, sf_dir), "basic_webpage"))[1].select("page_id")


@query("webpage_error_rates", f"""
SELECT split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS kind, count(*) AS errors FROM (SELECT unnest({_WEB_ERRORS}) AS e FROM {_WEB_SQL}) GROUP BY 1, 2""")
def webpage_error_rates(spark, sf_dir):
    return VAL.error_rates(VAL.validate(_webpages(spark, sf_dir), "basic_webpage"))


@query("webpage_valid_ratio", f"""
SELECT count(*) AS rows, count(*) FILTER (len({_WEB_ERRORS}) = 0) AS valid_rows, round(count(*) FILTER (len({_WEB_ERRORS}) = 0) / count(*), 6) AS valid_ratio FROM {_WEB_SQL}""")
def webpage_valid_ratio(spark, sf_dir):
    return VAL.valid_ratio(VAL.validate(_webpages(spark, sf_dir), "basic_webpage")).withColumn("valid_ratio", F.round("valid_ratio", 6))


@query("product_validation", """
SELECT p_partkey, length(trim(p_name)) > 0 AND p_partkey % 3 <> 2 AS is_valid, CASE WHEN p_partkey % 3 = 2 THEN 'availability:pattern' ELSE '' END AS errors FROM part""")
def product_validation(spark, sf_dir):
    """part as products; every third is offered as 'maybe'."""
    k = F.col("p_partkey") % 3
    products = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").cast("string").alias("price"),
        F.when(k == 0, "in_stock now").when(k == 1, "").otherwise("maybe").alias("availability"))
    checked = VAL.validate(products, "ecommerce_product")
    errors = F.transform("report.errors", lambda e: F.concat(e["field"], F.lit(":"), e["kind"]))
    return checked.select("p_partkey", "report.is_valid", F.array_join(errors, " ").alias("errors"))


@query("contact_validation", r"""
SELECT c_custkey, c_custkey % 2 = 0 AND length(a) = 11 AS is_valid, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS cleaned_name,
  trim(CASE WHEN c_custkey % 2 = 1 THEN 'email:type' ELSE '' END || CASE WHEN length(a) <> 11 THEN ' phone:type' ELSE '' END) AS errors
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '139' ELSE '13900000000' END AS a FROM customer)""")
def contact_validation(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    people = c.select(
        "c_custkey", F.concat(F.lit("  "), F.upper("c_name")).alias("name"),
        F.when(k % 2 == 0, F.concat(k, F.lit("@shop.example.com"))).otherwise("nobody").alias("email"),
        F.when(k % 5 == 0, "139").otherwise("13900000000").alias("phone"))
    checked = VAL.validate(people, "contact_info")
    errors = F.transform("report.errors", lambda e: F.concat(e["field"], F.lit(":"), e["kind"]))
    return checked.select("c_custkey", "report.is_valid", F.col("report.cleaned")["name"].alias("cleaned_name"),
                          F.array_join(errors, " ").alias("errors"))


@query("numeric_rules", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(
  CASE WHEN floor(l_quantity) > 40 THEN 'q:max_value' ELSE '' END || CASE WHEN floor(l_quantity) < 5 THEN 'q:min_value' ELSE '' END
  || CASE WHEN l_discount > 0.08 THEN ' d:max_value' ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ' t:not_numeric' END) AS errors FROM lineitem""")
def numeric_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"),
        F.when(F.col("l_linenumber") % 2 == 0, "12").otherwise("12.5").alias("t"))
    rules = {"q": VAL.FieldRule("number", min_value=5, max_value=40), "d": VAL.FieldRule("float", max_value=0.08),
             "t": VAL.FieldRule("number")}
    errors = F.transform("report.errors", lambda e: F.concat(e["field"], F.lit(":"), e["kind"]))
    return VAL.validate(rows, rules).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(errors, " ").alias("errors"))


@query("custom_rule_validation", """
SELECT o_orderkey, o_totalprice > 1000 AND o_orderstatus <> 'P' AS is_valid, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS warnings FROM
(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders)""")
def custom_rule_validation(spark, sf_dir):
    """A custom rule that fails on P and has no verdict on F."""
    def known(v):
        return F.when(v == "F", F.lit(None).cast("boolean")).otherwise(v != "P")
    rules = {"o_orderstatus": VAL.FieldRule(custom=known), "o_totalprice": VAL.FieldRule("float", min_value=1000.000001)}
    return VAL.validate(table(spark, sf_dir, "orders"), rules).select(
        "o_orderkey", "report.is_valid", F.size("report.warnings").alias("warnings"))


@query("task_config_dry_run", """
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'name:required' END,
    CASE WHEN c > 100 OR c < 1 THEN 'max_concurrent_requests:range' END, CASE WHEN o_orderstatus = 'O' THEN 'timeout:range' END],
    lambda e: e IS NOT NULL), ' ') AS errors, c AS concurrency, 30 AS default_timeout_or_given, 'css' AS selector_type
FROM (SELECT o_orderkey, o_orderstatus, CAST(o_custkey % 150 AS INTEGER) AS c FROM orders) WHERE o_orderstatus <> 'O'
UNION ALL
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'name:required' END,
    CASE WHEN c > 100 OR c < 1 THEN 'max_concurrent_requests:range' END, 'timeout:range'], lambda e: e IS NOT NULL), ' '), c, 301, 'css'
FROM (SELECT o_orderkey, o_orderstatus, CAST(o_custkey % 150 AS INTEGER) AS c FROM orders) WHERE o_orderstatus = 'O'""")
def task_config_dry_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    config = F.to_json(F.struct(
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("t"), F.col("o_orderkey"))).alias("name"),
        F.array(F.lit("http://example.com/")).alias("urls"), (F.col("o_custkey") % 150).alias("max_concurrent_requests"),
        F.when(F.col("o_orderstatus") == "O", 301).alias("timeout")))
    checked = VAL.validate_task_config(o.select("o_orderkey", config.alias("config")))
    errors = F.transform("report.errors", lambda e: F.concat(e["field"], F.lit(":"), e["kind"]))
    return checked.select("o_orderkey", F.array_join(errors, " ").alias("errors"), F.col("parsed.max_concurrent_requests").alias("concurrency"),
                          F.col("parsed.timeout").alias("default_timeout_or_given"), "parsed.selector_type")


# Records on their way to the store.
@query("distinct_documents", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def distinct_documents(spark, sf_dir):
    return G.distinct_content(_documents(spark, sf_dir), ["text", "lang"], ["doc_id"]).select("doc_id")


@query("idempotent_load", """
SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events WHERE event_type <> 'error')
WHERE rn = 1 AND (user_id, day) NOT IN (SELECT (user_id, CAST(ts AS DATE)) FROM events WHERE event_type = 'error')""")
def idempotent_load(spark, sf_dir):
    """One result per user and day, unless an error row is stored for it."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    stored, batch = e.where("event_type = 'error'"), e.where("event_type <> 'error'")
    return R.load_idempotent(batch, stored, ["user_id", "day"], ["ts", "event_id"]).select("user_id", "day", "event_id")


@query("normalized_values", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_trunc('day', l_shipdate) AS shipped, l_extendedprice AS price FROM lineitem""")
def normalized_values(spark, sf_dir):
    """Dates in three notations and prices with currency sign, read back."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 3
    written = F.when(k == 0, F.date_format("l_shipdate", "yyyy/MM/dd")).when(k == 1, F.date_format("l_shipdate", "dd.MM.yyyy")) \
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"))
    price = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     G.normalize_time(written).cast("timestamp_ntz").alias("shipped"), G.normalize_number(price).alias("price"))


@query("cleaning_log", f"""
SELECT doc_id, 'text' AS field, md5(text) AS before_md5, md5({_CLEANER_SQL['normalize_whitespace']}) AS after_md5 FROM documents WHERE text <> {_CLEANER_SQL['normalize_whitespace']}
UNION ALL SELECT doc_id, 'lang', md5(lang), md5(upper(lang)) FROM documents WHERE lang <> upper(lang)""")
def cleaning_log(spark, sf_dir):
    log = G.change_log(_documents(spark, sf_dir), "doc_id", {"text": ["normalize_whitespace"], "lang": ["to_upper"]})
    return log.select("doc_id", "field", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


def _masked_sql() -> str:
    text = "text"
    for name in G.PERSONAL:
        p = _SQL_PATTERNS[name]
        if p.startswith(r"\b"):
            text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_])(?:{p[2:]})', '\\1[{name}]', 'g')"
        else:
            text = f"regexp_replace({text}, '{p}', '[{name}]', 'g')"
    return text


@query("masked_documents", f"SELECT doc_id, md5({_masked_sql()}) AS masked_md5 FROM documents")
def masked_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(G.mask_personal(F.col("text"))).alias("masked_md5"))


@query("union_of_shapes", """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS brand FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, NULL FROM supplier UNION ALL SELECT p_name, NULL, NULL, p_brand FROM part""")
def union_of_shapes(spark, sf_dir):
    read = lambda t: table(spark, sf_dir, t)
    return G.union_all([
        read("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        read("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        read("part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))])

