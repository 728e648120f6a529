"""JSON text of string maps, byte-exact because it is hashed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawlframe.functions.urls import let

# The short escapes of JSON.
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def quote(text: Column) -> Column:
    """JSON string literal; non-ASCII characters are kept."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = escaped
    for code in range(32):
        char = chr(code)
        controls = F.replace(controls, F.lit(char), F.lit(_SHORT.get(char, f"\\u{code:04x}")))
    body = F.when(text.rlike(r"[\x00-\x1f]"), controls).otherwise(escaped)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _object(entries: Column) -> Column:
    """``{"k": "v", …}`` of an array of (key, …, value) structs, in their order."""
    pairs = F.transform(entries, lambda e: F.concat(quote(e["key"]), F.lit(": "), F.coalesce(quote(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _pieces(entries: Column) -> Column:
    """Name and JSON text of each entry, in order of the names."""
    return F.transform(entries, lambda e: F.struct(
        e["key"].alias("key"), F.concat(quote(e["key"]), F.lit(": "), F.coalesce(quote(e["value"]), F.lit("null"))).alias("text")))


def payload_pieces(data: Column) -> Column:
    """What payload texts under several settings share; null when empty."""
    return F.when(F.size(data) > 0, _pieces(F.sort_array(F.map_entries(data))))


def header_pieces(headers: Column) -> Column:
    """As payload_pieces, with lower-case names of which the last spelling counts."""
    entries = F.sort_array(F.transform(F.map_entries(headers), lambda e, i: F.struct(
        F.lower(e["key"]).alias("key"), i.alias("i"), e["value"].alias("value"))))
    last = let(entries, lambda found: F.filter(found, lambda e, i: ~F.coalesce(F.get(found, i + 1)["key"] == e["key"], F.lit(False))))
    return F.when(F.size(headers) > 0, _pieces(last))


def join_pieces(pieces: Column, ignore: Iterable[str]) -> Column:
    """JSON object of the pieces whose name is not ignored; null where there are no pieces at all."""
    ignored = sorted(set(ignore))
    kept = F.filter(pieces, lambda p: ~p["key"].isin(ignored)) if ignored else pieces
    return F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda p: p["text"]), ", "), F.lit("}"))


def payload_text(data: Column, ignore: Iterable[str] = ()) -> Column:
    """Request payload without ignored names, names sorted; null when empty. A
    payload that is not empty but loses every name still counts, as ``{}``."""
    ignored = sorted(set(ignore))
    kept = F.map_filter(data, lambda k, v: ~k.isin(ignored)) if ignored else data
    return F.when(F.size(data) > 0, _object(F.sort_array(F.map_entries(kept))))


def header_text(headers: Column, ignore: Iterable[str]) -> Column:
    """Request headers with lower-case names, without the ignored ones; of two
    spellings of one name the last counts."""
    ignored = sorted({name.lower() for name in ignore})
    entries = F.transform(F.map_entries(headers), lambda e, i: F.struct(
        F.lower(e["key"]).alias("key"), i.alias("i"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e: ~e["key"].isin(ignored)) if ignored else entries
    last = let(F.sort_array(kept), lambda all_kept: F.filter(
        all_kept, lambda e, i: ~F.coalesce(F.get(all_kept, i + 1)["key"] == e["key"], F.lit(False))))
    return F.when(F.size(headers) > 0, _object(last))
