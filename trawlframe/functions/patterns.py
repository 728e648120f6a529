"""Named text patterns and regex extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern library.
PATTERNS: dict[str, str] = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "url": r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "date": r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    "time": r"\d{1,2}:\d{2}:\d{2}",
    "price": r"\$?\d+(?:,\d{3})*(?:\.\d{2})?",
    "chinese_phone": r"1[3-9]\d{9}",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "zipcode": r"\b\d{5}(?:-\d{4})?\b",
    "hex_color": r"#?[0-9A-Fa-f]{6}",
    "guid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
}

# A text without this piece cannot match; a substring test is far cheaper
# than running the regex over a long text. By pattern, so a pattern registered under the same name has none.
_NEEDS = {PATTERNS[name]: piece for name, piece in {"email": "@", "url": "http", "ip": ".", "time": ":", "guid": "-"}.items()}


def unicode_aware(pattern: str) -> str:
    """``\\w``, ``\\d``, ``\\s`` and ``\\b`` over all of Unicode."""
    return "(?U)" + pattern


def register_pattern(name: str, pattern: str) -> None:
    re.compile(pattern)
    PATTERNS[name] = pattern


def find_all(text: Column, pattern: str) -> Column:
    """Distinct matches, sorted: the whole match without groups, the group with
    one group, a struct of groups with several."""
    groups = re.compile(pattern).groups
    java = F.lit(unicode_aware(pattern))
    if groups <= 1:
        found = F.regexp_extract_all(text, java, F.lit(groups))
    else:
        columns = [F.regexp_extract_all(text, java, F.lit(g)) for g in range(1, groups + 1)]
        found = F.arrays_zip(*[c.alias(f"g{g}") for g, c in enumerate(columns, 1)])
    return F.array_sort(F.array_distinct(found))


def extract_named(text: Column, name: str, first: bool = False) -> Column:
    """All distinct matches of a named pattern (or the first match); null when
    there is none or the name is unknown."""
    if name not in PATTERNS:
        return F.lit(None).cast("string" if first else "array<string>")
    java = unicode_aware(PATTERNS[name])
    piece = _NEEDS.get(PATTERNS[name])
    possible = text.contains(piece) if piece else text.isNotNull()
    if first:
        return F.when(possible, F.nullif(F.regexp_extract(text, java, 0), F.lit("")))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(java), F.lit(0))))
    # Most texts have no match: one pass decides, only hits pay for the list.
    return F.when(possible & text.rlike(java), found)


def emails(text: Column) -> Column:
    """Distinct e-mail addresses in a text, empty array when none."""
    return F.coalesce(extract_named(text, "email"), F.array().cast("array<string>"))


def phone_numbers(text: Column) -> Column:
    """Distinct ddd ddd dddd numbers in a text, empty array when none."""
    return F.coalesce(extract_named(text, "phone"), F.array().cast("array<string>"))


def mask(text: Column, names: list[str], replacement: str = "[{name}]") -> Column:
    """Text with every match of the named patterns replaced."""
    for name in names:
        text = F.regexp_replace(text, unicode_aware(PATTERNS[name]), replacement.format(name=name))
    return text
