"""Record validation: specs compile to one report column, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.functions.cleaners import CLEANERS, clean
from trawlframe.functions.patterns import PATTERNS
from trawlframe.functions.validators import FLOAT_TEXT, INTEGER_TEXT, VALIDATORS, starts_with_match

ERROR_TYPE = "array<struct<field string, kind string, expected string>>"


@dataclass(frozen=True)
class FieldRule:
    """What one field must satisfy. ``custom`` is a Column -> boolean Column;
    a null verdict (it could not decide) is a warning, false an error."""

    field_type: str = "string"
    required: bool = True
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    pattern: str | None = None
    custom: Callable[[Column], Column] | None = None
    cleaners: tuple[str, ...] = ()


_TEXT_CLEANERS = ("trim", "remove_html", "normalize_whitespace")

# The predefined schemas.
SCHEMAS: dict[str, dict[str, FieldRule]] = {
    "basic_webpage": {
        "title": FieldRule(min_length=1, max_length=200, cleaners=_TEXT_CLEANERS),
        "url": FieldRule("url"),
        "content": FieldRule(required=False, max_length=10000, cleaners=_TEXT_CLEANERS),
        "publish_date": FieldRule("date", required=False),
    },
    "ecommerce_product": {
        "name": FieldRule(min_length=1, max_length=200, cleaners=("trim", "normalize_whitespace")),
        "price": FieldRule("price"),
        "description": FieldRule(required=False, max_length=5000, cleaners=_TEXT_CLEANERS),
        "image_url": FieldRule("url", required=False),
        "availability": FieldRule(required=False, pattern=r"(in_stock|out_of_stock|preorder)"),
    },
    "contact_info": {
        "name": FieldRule(min_length=1, max_length=100, cleaners=("trim", "normalize_whitespace", "title_case")),
        "email": FieldRule("email"),
        "phone": FieldRule("chinese_phone", required=False),
        "company": FieldRule(required=False, max_length=100, cleaners=("trim", "normalize_whitespace")),
    },
}


def _error(field: str, kind: str, expected="") -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(str(expected)).alias("expected"))


def _numeric(v: Column, rule: FieldRule, dtype: T.DataType) -> tuple[Column, Column]:
    """(readable, number): ``float`` compares as it is, the integer-like types
    compare whole numbers, and text must then be a whole number."""
    text = isinstance(dtype, T.StringType)
    if rule.field_type == "float":
        readable = v.rlike(FLOAT_TEXT) if text else F.lit(True)
        plain = F.replace(F.trim(v), F.lit("_"), F.lit("")) if text else v
        return readable, plain.try_cast("double")
    if text:
        plain = F.replace(F.trim(v), F.lit("_"), F.lit(""))
        # Beyond 38 digits a number is further out than any bound.
        least, most = (F.lit(sign + "9" * 38).cast("decimal(38,0)") for sign in ("-", ""))
        return v.rlike(INTEGER_TEXT), F.coalesce(
            plain.try_cast("decimal(38,0)"), F.when(v.rlike(INTEGER_TEXT), F.when(plain.startswith("-"), least).otherwise(most)))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
        return whole, F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    return F.lit(True), v.cast("decimal(38,0)")


def field_report(name: str, value: Column, dtype: T.DataType, rule: FieldRule, compat_null: bool = False) -> Column:
    """Struct field, original, cleaned, is_valid, errors, warnings.

    Order: clean, presence, type; only a value that passes those is checked for
    length, range, pattern and the custom rule, which may all report.
    """
    cleaned, kind = _cleaned(value, dtype, rule, compat_null)
    return _report(name, value, cleaned, *_checked(name, cleaned, kind, rule))


def _cleaned(value: Column, dtype: T.DataType, rule: FieldRule, compat_null: bool) -> tuple[Column, T.DataType]:
    chain = [c for c in rule.cleaners if c in CLEANERS]
    return (clean(value, chain, compat_null), T.StringType()) if chain else (value, dtype)


def _report(name: str, value: Column, cleaned: Column, errors: Column, warnings: Column) -> Column:
    return F.struct(
        F.lit(name).alias("field"), value.cast("string").alias("original"), cleaned.cast("string").alias("cleaned"),
        (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def _none() -> Column:
    return F.array().cast(ERROR_TYPE)


def _only_if(condition: Column, error: Column) -> Column:
    """A list with the error or an empty one. Lists are concatenated instead of
    filtered: that stays inside generated code."""
    return F.when(condition, F.array(error).cast(ERROR_TYPE)).otherwise(_none())


def _checked(name: str, cleaned: Column, kind: T.DataType, rule: FieldRule) -> tuple[Column, Column]:
    """(errors, warnings) of a cleaned value."""
    text = isinstance(kind, T.StringType)
    missing = cleaned.isNull() | (cleaned == "") if text else cleaned.isNull()

    found: list[Column] = []
    if text and rule.min_length is not None:
        found.append(_only_if(F.length(cleaned) < rule.min_length, _error(name, "min_length", rule.min_length)))
    if text and rule.max_length is not None:
        found.append(_only_if(F.length(cleaned) > rule.max_length, _error(name, "max_length", rule.max_length)))
    if rule.field_type in ("number", "integer", "float"):
        readable, number = _numeric(cleaned, rule, kind)
        found.append(_only_if(~readable, _error(name, "not_numeric")))
        if rule.min_value is not None:
            found.append(_only_if(readable & (number < rule.min_value), _error(name, "min_value", rule.min_value)))
        if rule.max_value is not None:
            found.append(_only_if(readable & (number > rule.max_value), _error(name, "max_value", rule.max_value)))
    if rule.pattern:
        found.append(_only_if(~starts_with_match(cleaned.cast("string"), rule.pattern), _error(name, "pattern", rule.pattern)))
    warnings = F.array().cast("array<string>")
    if rule.custom is not None:
        verdict = rule.custom(cleaned)
        found.append(_only_if(~verdict, _error(name, "custom")))
        warnings = F.when(~missing & verdict.isNull(), F.array(F.lit(f"{name}: custom rule gave no verdict"))).otherwise(warnings)

    later = F.concat(*found) if found else _none()
    errors = F.when(missing, F.array(_error(name, "required")).cast(ERROR_TYPE) if rule.required else _none())
    if rule.field_type in VALIDATORS:
        errors = errors.when(~VALIDATORS[rule.field_type](cleaned, kind),
                             F.array(_error(name, "type", rule.field_type)).cast(ERROR_TYPE))
    return errors.otherwise(later), warnings


def validate_value(name: str, value: Column, dtype: T.DataType | None = None, **options) -> Column:
    """Report of a single value."""
    return field_report(name, value, dtype or T.StringType(), FieldRule(**options))


def validate(df: DataFrame, schema: dict[str, FieldRule] | str, report: str = "report",
             compat_null: bool = False) -> DataFrame:
    """Adds the row's report: is_valid, errors, warnings, cleaned, fields.

    A column the DataFrame lacks is a missing key; if required, that is an error
    beside the one for its empty value. An unknown schema name makes every row
    invalid.
    """
    rules = SCHEMAS.get(schema, {}) if isinstance(schema, str) else schema
    if not rules:
        label = schema if isinstance(schema, str) else ""
        return df.withColumn(report, F.struct(
            F.lit(False).alias("is_valid"), F.array(_error("", "unknown_schema", label)).cast(ERROR_TYPE).alias("errors"),
            F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("map<string,string>").alias("cleaned"),
            F.lit(None).cast("array<struct<field string, original string, cleaned string, is_valid boolean, "
                             f"errors {ERROR_TYPE}, warnings array<string>>>").alias("fields")))
    # Cleaned values, then errors, get columns of their own: what follows reads
    # from them, so each cleaner chain and each rule is evaluated once.
    cleaned, errors, warnings, values = {}, {}, {}, {}
    for name, rule in rules.items():
        present = name in df.columns
        value = F.col(name) if present else F.lit(None).cast("string")
        dtype = df.schema[name].dataType if present else T.StringType()
        clean_value, kind = _cleaned(value, dtype, rule, compat_null and present)
        if rule.cleaners:
            cleaned[f"_clean_{name}"], clean_value = clean_value, F.col(f"_clean_{name}")
        errors[f"_errors_{name}"], warnings[name] = _checked(name, clean_value, kind, rule)
        values[name] = (value, clean_value)
    absent = [_error(n, "missing_key") for n, r in rules.items() if r.required and n not in df.columns]
    checked = df.withColumns(cleaned).withColumns(errors)
    all_errors = F.concat(*[F.col(c) for c in errors], *([F.array(*absent).cast(ERROR_TYPE)] if absent else []))
    is_valid = reduce(lambda a, b: a & b, [F.size(c) == 0 for c in errors], F.lit(not absent))
    result = F.struct(
        is_valid.alias("is_valid"), all_errors.alias("errors"), F.concat(*warnings.values()).alias("warnings"),
        F.create_map(*[part for n, (_, c) in values.items() for part in (F.lit(n), c.cast("string"))]).alias("cleaned"),
        F.array(*[_report(n, v, c, F.col(f"_errors_{n}"), warnings[n]) for n, (v, c) in values.items()]).alias("fields"))
    # As the output of a generator the report is computed once; as a projection
    # a filter on it would be pushed below and evaluate every rule again.
    return checked.select(*df.columns, F.explode(F.array(result)).alias(report))


def split(validated: DataFrame, report: str = "report") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows)."""
    ok = F.col(f"{report}.is_valid")
    return validated.where(ok), validated.where(~ok)


def error_rates(validated: DataFrame, report: str = "report") -> DataFrame:
    """Errors per field and kind."""
    return (validated.select(F.explode(f"{report}.errors").alias("e"))
            .groupBy(F.col("e.field").alias("field"), F.col("e.kind").alias("kind"))
            .agg(F.count(F.lit(1)).alias("errors")))


def valid_ratio(validated: DataFrame, report: str = "report") -> DataFrame:
    ok = F.col(f"{report}.is_valid")
    return validated.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("valid_rows"),
                         F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("valid_ratio"))


def registered_names(spark: SparkSession) -> DataFrame:
    """``kind, name`` of the available validators, cleaners and patterns."""
    rows = [(kind, name) for kind, names in (("validator", VALIDATORS), ("cleaner", CLEANERS), ("pattern", PATTERNS))
            for name in names]
    return spark.createDataFrame(rows, "kind string, name string")


# Limits and defaults of a task configuration.
CONFIG_SCHEMA = ("name string, description string, urls array<string>, priority int, max_items int, "
                 "max_concurrent_requests int, timeout int, request_delay double, retry_times int, "
                 "parse_rules map<string,string>, selector_type string")
CONFIG_DEFAULTS = {"priority": 0, "max_concurrent_requests": 10, "timeout": 30, "request_delay": 1.0,
                   "retry_times": 3, "selector_type": "css"}
CONFIG_RANGES = {"max_concurrent_requests": (1, 100), "timeout": (1, 300)}
MAX_URL_LENGTH = 2048


def validate_task_config(df: DataFrame, config: str = "config") -> DataFrame:
    """Dry run of a JSON task configuration: adds ``parsed`` (defaults filled)
    and ``report`` (is_valid, errors)."""
    parsed = df.withColumn("parsed", F.from_json(config, CONFIG_SCHEMA))
    value = lambda c: F.col(f"parsed.{c}")
    checks = [
        F.when(F.try_parse_json(config).isNull(), _error(config, "type", "json")),
        F.when(value("name").isNull(), _error("name", "required")),
        F.when(value("urls").isNull(), _error("urls", "required")),
        F.when(F.exists(value("urls"), lambda u: F.length(u) > MAX_URL_LENGTH), _error("urls", "max_length", MAX_URL_LENGTH)),
        F.when(~F.lower(value("selector_type")).isin("css", "xpath"), _error("selector_type", "pattern", "css|xpath")),
        *[F.when((value(c) < low) | (value(c) > high), _error(c, "range", f"{low}-{high}"))
          for c, (low, high) in CONFIG_RANGES.items()]]
    errors = F.array_compact(F.array(*checks)).cast(ERROR_TYPE)
    filled = reduce(lambda col, item: col.withField(item[0], F.coalesce(value(item[0]), F.lit(item[1]))),
                    CONFIG_DEFAULTS.items(), F.col("parsed"))
    return parsed.withColumn("report", F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"))) \
        .withColumn("parsed", filled)
