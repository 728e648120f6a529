"""Records on their way to the store: normalising, change log, content dedup,
masking, unions of differing shapes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.functions.cleaners import clean
from trawlframe.functions.patterns import mask
from trawlframe.operators.requests import content_key, first_seen

# Personal data patterns masked by default, e-mails first.
PERSONAL = ("email", "credit_card", "phone", "chinese_phone", "ip")
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Batches with different fields under one another; missing fields null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_content(df: DataFrame, columns: list[str], order: list) -> DataFrame:
    """First record of each distinct content, with its SHA-256."""
    return first_seen(df.withColumn("content_sha", content_key(columns)), "content_sha", order)


# How each format's letters look in a text.
_LETTERS = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}


def _shape(time_format: str) -> str:
    """Regex of the texts a format can read. Trying formats one by one costs an
    exception per miss; testing the shape first leaves one try per text."""
    shape = re.escape(time_format).replace(r"\[", "(?:").replace(r"\]", ")?").replace("'T'", "T")
    for letters, digits in _LETTERS.items():
        shape = shape.replace(letters, digits)
    return "^" + re.sub("S+", r"\\d{1,6}", shape) + "$"


def normalize_time(text: Column, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """Timestamp of a text in any of the formats, null when none fits."""
    result = F.lit(None).cast("timestamp")
    for time_format in reversed(formats):
        result = F.when(text.rlike(_shape(time_format)), F.try_to_timestamp(text, F.lit(time_format))).otherwise(result)
    return result


def normalize_number(text: Column) -> Column:
    """Number of a text with currency signs and thousands commas."""
    return F.regexp_replace(text, r"[^0-9.+\-eE]", "").try_cast("double")


def change_log(df: DataFrame, row_id: str, rules: dict[str, list[str]]) -> DataFrame:
    """Which cleaned fields changed: ``row_id, field, before, after``."""
    changes = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), clean(F.col(c), chain).alias("after"))
        for c, chain in rules.items()])
    return (df.select(row_id, F.explode(changes).alias("_c")).select(row_id, "_c.*")
            .where(~F.col("before").eqNullSafe(F.col("after"))))


def mask_personal(text: Column, names: tuple[str, ...] = PERSONAL) -> Column:
    return mask(text, list(names))
