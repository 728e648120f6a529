"""Text cleaners by name, as Column -> Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Cleaner = Callable[[Column], Column]

# Unicode white space plus the separator controls.
_WS = r"[\s\x1c-\x1f]"


def trim(v: Column) -> Column:
    return F.regexp_replace(v, rf"(?U)^{_WS}+|{_WS}+$", "")


def remove_whitespace(v: Column) -> Column:
    return F.regexp_replace(v, rf"(?U){_WS}+", "")


def remove_html(v: Column) -> Column:
    # UNIX_LINES: only a line feed ends a line, so a tag may hold other breaks.
    return F.regexp_replace(v, "(?d)<.*?>", "")


def normalize_whitespace(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, rf"(?U){_WS}+", " "))


def remove_special_chars(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)[^\w\s\x1c-\x1f\-_.@]", "")


# Bytes of text, about, that are Python strings at a time.
_SLICE = 1 << 20


def _by_slices(v: pa.Array, work: Callable[[str], str]) -> pa.Array:
    """``work`` on each text. A batch has thousands of rows of any length: only a slice of it is made into Python
    strings, which take up to four times the bytes of the text, and the rest stays in Arrow."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    cuts = [0, *(np.flatnonzero(np.diff(before // _SLICE)) + 1).tolist(), len(v)]
    return pa.chunked_array([pa.array([None if t is None else work(t) for t in v.slice(a, b - a).to_pylist()], pa.string())
                             for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()).combine_chunks()


@F.arrow_udf(T.StringType())
def _nfkc(v: pa.Array) -> pa.Array:
    return _by_slices(v, lambda t: unicodedata.normalize("NFKC", t))


def normalize_unicode(v: Column) -> Column:
    """NFKC form. The only cleaner without a built-in: runs on Arrow batches."""
    return _nfkc(v)


def extract_numbers(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\D+", "")


def extract_letters(v: Column) -> Column:
    return F.regexp_replace(v, "[^a-zA-Z]+", "")


def remove_numbers(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\d+", "")


def capitalize(v: Column) -> Column:
    # The first letter in title case, which may be two letters ('ß' -> 'Ss', 'ǆ' -> 'ǅ'); the others keep
    # their neighbours while they are put in lower case, as a sigma at a word's end has a form of its own.
    first = F.left(v, F.lit(1))
    return F.concat(F.initcap(first), F.substr(F.lower(v), F.length(F.lower(first)) + 1))


@F.arrow_udf(T.StringType())
def _titled(v: pa.Array) -> pa.Array:
    return _by_slices(v, str.title)


def title_case(v: Column) -> Column:
    """Upper case after anything that is not a letter: ``O'Neil-X``. ``initcap``
    knows only blanks, and splitting into words in the JVM takes ten times as
    long as an Arrow batch."""
    return _titled(v)


CLEANERS: dict[str, Cleaner] = {
    "trim": trim,
    "remove_whitespace": remove_whitespace,
    "remove_html": remove_html,
    "normalize_whitespace": normalize_whitespace,
    "to_lower": F.lower,
    "to_upper": F.upper,
    "remove_special_chars": remove_special_chars,
    "normalize_unicode": normalize_unicode,
    "extract_numbers": extract_numbers,
    "extract_letters": extract_letters,
    "remove_numbers": remove_numbers,
    "capitalize": capitalize,
    "title_case": title_case,
}


def register_cleaner(name: str, cleaner: Cleaner) -> None:
    CLEANERS[name] = cleaner


def clean(v: Column, names: Iterable[str], compat_null: bool = False) -> Column:
    """The named cleaners in turn; unknown names are ignored.

    ``compat_null`` turns a null into the text ``None`` first, as string
    coercion does in Python; off by default.
    """
    known = [CLEANERS[n] for n in names if n in CLEANERS]
    v = v.cast("string")
    if known and compat_null:
        v = F.coalesce(v, F.lit("None"))
    for cleaner in known:
        v = cleaner(v)
    return v


def clean_columns(df: DataFrame, rules: dict[str, Iterable[str]]) -> DataFrame:
    """Applies a cleaner chain per column. A column that is absent counts as
    empty text; columns without a rule stay."""
    return df.withColumns({
        name: clean(F.col(name) if name in df.columns else F.lit(""), chain)
        for name, chain in rules.items()})
