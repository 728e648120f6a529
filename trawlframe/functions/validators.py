"""Value checks by type name, as (Column, DataType) -> boolean Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.functions.cleaners import trim
from trawlframe.functions.patterns import PATTERNS, unicode_aware

Validator = Callable[[Column, T.DataType], Column]

_DIGITS = r"\d(?:_?\d)*"
# Text that reads as a float, resp. an integer, in Python notation.
FLOAT_TEXT = (rf"(?iU)^[\s\x1c-\x1f]*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
              r"|inf|infinity|nan)[\s\x1c-\x1f]*$")
INTEGER_TEXT = rf"(?U)^[\s\x1c-\x1f]*[+-]?{_DIGITS}[\s\x1c-\x1f]*$"


def starts_with_match(v: Column, pattern: str) -> Column:
    """The pattern matches at the start of the text (a prefix is enough)."""
    return v.rlike(unicode_aware(f"^(?:{pattern})"))


def _is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def _text_check(pattern_name: str) -> Validator:
    def check(v: Column, dtype: T.DataType) -> Column:
        if not _is_text(dtype):
            return F.lit(False)
        return F.coalesce(starts_with_match(trim(v), PATTERNS[pattern_name]), F.lit(False))
    return check


def is_url(v: Column, dtype: T.DataType) -> Column:
    if not _is_text(dtype):
        return F.lit(False)
    return F.coalesce(trim(v).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def is_float(v: Column, dtype: T.DataType) -> Column:
    if _is_text(dtype):
        return F.coalesce(v.rlike(FLOAT_TEXT), F.lit(False))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return v.isNotNull()
    return F.lit(False)


def is_integer(v: Column, dtype: T.DataType) -> Column:
    if _is_text(dtype):
        return F.coalesce(v.rlike(INTEGER_TEXT), F.lit(False))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return v.isNotNull()
    return F.lit(False)


def is_boolean(v: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return v.isNotNull()
    if _is_text(dtype):
        return F.coalesce(F.lower(v).isin("true", "false", "1", "0", "yes", "no"), F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(v.isin(0, 1), F.lit(False))
    return F.lit(False)


def is_json(v: Column, dtype: T.DataType) -> Column:
    """The parser stops after the first value; wrapped in a list and in an
    object, nothing can follow that value unnoticed."""
    if not _is_text(dtype):
        return F.lit(False)
    listed = F.try_parse_json(F.concat(F.lit("["), v, F.lit("]"))).isNotNull()
    named = F.try_parse_json(F.concat(F.lit('{"v":'), v, F.lit("}"))).isNotNull()
    bare = v.rlike(r"^\s*(?:NaN|-?Infinity)\s*$")
    return F.coalesce((listed & named) | bare, F.lit(False))


def is_array(v: Column, dtype: T.DataType) -> Column:
    return v.isNotNull() if isinstance(dtype, T.ArrayType) else F.lit(False)


def is_object(v: Column, dtype: T.DataType) -> Column:
    return v.isNotNull() if isinstance(dtype, (T.MapType, T.StructType)) else F.lit(False)


def is_string(v: Column, dtype: T.DataType) -> Column:
    return v.isNotNull() if _is_text(dtype) else F.lit(False)


def json_kind(v: Column) -> Column:
    """'array', 'object' or 'scalar' of a JSON text; null when it is none."""
    first = F.left(F.ltrim(v), F.lit(1))
    kind = F.when(first == "[", "array").when(first == "{", "object").otherwise("scalar")
    return F.when(is_json(v, T.StringType()), kind)


VALIDATORS: dict[str, Validator] = {
    "email": _text_check("email"),
    "url": is_url,
    "phone": _text_check("phone"),
    "date": _text_check("date"),
    "number": is_float,
    "integer": is_integer,
    "float": is_float,
    "boolean": is_boolean,
    "json": is_json,
    "array": is_array,
    "object": is_object,
    "string": is_string,
    "ip_address": _text_check("ip"),
    "credit_card": _text_check("credit_card"),
    "chinese_phone": _text_check("chinese_phone"),
    "price": _text_check("price"),
    "zipcode": _text_check("zipcode"),
    "hex_color": _text_check("hex_color"),
}


def register_validator(name: str, check: Validator) -> None:
    VALIDATORS[name] = check


def is_valid(v: Column, name: str, dtype: T.DataType | None = None) -> Column:
    return VALIDATORS[name](v, dtype or T.StringType())
