"""URL splitting, normalisation and resolution as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic URI grammar; never raises, unlike parse_url / java.net.URI.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

# Schemes whose last path segment may carry ';parameters'.
_PARAMETER_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu",
                      "sip", "sips", "mms", "sftp", "tel")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _tidy(url: Column) -> Column:
    """Drops what a URL parser drops: blanks in front and inner line breaks."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def url_part(url: Column | str, part: str) -> Column:
    """One of scheme, authority, path, query, fragment ('' when absent)."""
    index = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}[part]
    value = F.regexp_extract(_tidy(_col(url)), _PARTS, index)
    return F.lower(value) if part == "scheme" else value


def domain_of(url: Column | str) -> Column:
    """Authority of the URL as written (host and port)."""
    return url_part(url, "authority")


def decode_component(text: Column) -> Column:
    """Form decoding; a '%' that starts no escape stays as it is."""
    decoded = F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(text.rlike("[%+]"), decoded).otherwise(text)


def encode_component(text: Column) -> Column:
    """Form encoding with '~' kept and '*' escaped."""
    encoded = F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(text.rlike(r"[^A-Za-z0-9_.~\-]"), encoded).otherwise(text)


def _query_text(query: Column, ignore_params: Iterable[str], sort_params: bool) -> Column:
    pieces = F.filter(F.split(query, "&"), lambda p: (F.instr(p, "=") > 0) & (F.instr(p, "=") < F.length(p)))
    pairs = F.transform(pieces, lambda p, i: F.struct(
        decode_component(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"),
        decode_component(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    ignored = sorted(set(ignore_params))
    if ignored:
        pairs = F.filter(pairs, lambda p: ~p["k"].isin(ignored))
    if not sort_params:
        # Repeats of a name are written together, where the name first stood.
        pairs = let(pairs, lambda all_pairs: F.transform(all_pairs, lambda p: F.struct(
            F.array_position(F.transform(all_pairs, lambda q: q["k"]), p["k"]).alias("first"), p["i"].alias("i"),
            p["k"].alias("k"), p["v"].alias("v"))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: F.concat(
        encode_component(p["k"]), F.lit("="), encode_component(p["v"]))), "&")


def normalize_url(
    url: Column | str, ignore_params: Iterable[str] = (), sort_params: bool = True
) -> Column:
    """Canonical URL text: lower-case host, no fragment or path parameters,
    query without blank and ignored parameters, sorted by name."""
    url = _col(url)

    def build(whole: Column) -> Column:
        return let(F.substring_index(whole, "?", 1), lambda base: _canonical(
            base, F.substr(whole, F.length(base) + 2), ignore_params, sort_params))
    normal = let(F.substring_index(_tidy(url), "#", 1), build)
    broken = _broken(url)
    # Most URLs are written plainly: what stands before the query is canonical
    # as it is, and only the query needs work.
    whole = F.substring_index(url, "#", 1)
    base = F.substring_index(whole, "?", 1)
    plain = whole.rlike(r"^[a-z][a-z0-9+.\-]*://[a-z0-9.:\-]*/[^?;\[\]\x00-\x20]*(?:\?[^\x00-\x20]*)?$")
    quick = F.concat(base, _query_part(F.substr(whole, F.length(base) + 2), ignore_params, sort_params))
    return F.when(plain, quick).when(broken, url).otherwise(normal)


def split_url(url: Column | str) -> dict[str, Column]:
    """What canonical forms of a URL under several settings share: ``base`` (all before the query), ``pairs`` (the query's pairs,
    decoded, sorted, each with its encoded ``text``) and ``fixed``, which is the URL itself where it cannot be split."""
    url = _col(url)
    whole = F.substring_index(_tidy(url), "#", 1)
    plain = whole.rlike(r"^[a-z][a-z0-9+.\-]*://[a-z0-9.:\-]*/[^?;\[\]\x00-\x20]*(?:\?[^\x00-\x20]*)?$")
    start = F.substring_index(whole, "?", 1)
    base = F.when(plain, start).otherwise(_canonical(start, F.lit(""), (), True))
    pieces = F.filter(F.split(F.substr(whole, F.length(start) + 2), "&"), lambda p: (F.instr(p, "=") > 0) & (F.instr(p, "=") < F.length(p)))
    # A piece without anything to decode or encode is its own text.
    simple = lambda p: ~p.rlike(r"[^A-Za-z0-9_.~=\-]|=.*=")
    halves = F.transform(pieces, lambda p, i: F.struct(
        decode_component(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"),
        decode_component(F.substr(p, F.instr(p, "=") + 1)).alias("v"), F.when(simple(p), p).alias("text")))
    pairs = F.transform(F.sort_array(halves), lambda h: F.struct(h["k"].alias("k"), F.coalesce(
        h["text"], F.concat(encode_component(h["k"]), F.lit("="), encode_component(h["v"]))).alias("text")))
    return {"base": base, "pairs": F.when(whole.contains("="), pairs), "fixed": F.when(_broken(url), url)}


def join_url(parts: dict[str, Column], ignore_params: Iterable[str] = ()) -> Column:
    """Canonical text, with sorted parameters, from what :func:`split_url` gives."""
    ignored = sorted(set(ignore_params))
    pairs = F.filter(parts["pairs"], lambda p: ~p["k"].isin(ignored)) if ignored else parts["pairs"]
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.transform(pairs, lambda p: p["text"]), "&"))).otherwise("")
    return F.coalesce(parts["fixed"], F.concat(parts["base"], query))


def _broken(url: Column) -> Column:
    """An unbalanced bracket host cannot be split; such a URL stays as it is."""
    return (url.contains("[") | url.contains("]")) & url.rlike(
        r"^[^/?#]*//(?:[^/?#\]]*\[[^/?#\]]*|[^/?#\[]*\][^/?#\[]*)(?:[/?#]|$)")


def _query_part(query: Column, ignore_params: Iterable[str], sort_params: bool) -> Column:
    return F.when(query.contains("="), let(
        _query_text(query, ignore_params, sort_params),
        lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("?"), t)))).otherwise("")


def _canonical(base: Column, query: Column, ignore_params: Iterable[str], sort_params: bool) -> Column:
    """The parts are cut off from left to right, each bound once; only the
    scheme needs a regex."""
    def with_scheme(scheme: Column) -> Column:
        return let(F.when(scheme == "", base).otherwise(F.substr(base, F.length(scheme) + 2)),
                   lambda rest: let(
                       F.when(rest.startswith("//"), F.substring_index(F.substr(rest, F.lit(3)), "/", 1)).otherwise(""),
                       lambda authority: with_authority(scheme, rest, authority)))

    def with_authority(scheme: Column, rest: Column, authority: Column) -> Column:
        path = F.when(rest.startswith("//"), F.substr(rest, F.length(authority) + 3)).otherwise(rest)
        path = let(path, lambda p: F.when(p == "", "/").when(
            p.contains(";") & F.lower(scheme).isin(*_PARAMETER_SCHEMES),
            F.regexp_replace(F.regexp_replace(p, ";[^/]*$", ""), "^$", "/")).otherwise(p))
        return F.concat(F.lower(scheme), F.lit("://"), F.lower(authority), path,
                        _query_part(query, ignore_params, sort_params))

    return let(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), with_scheme)


def _fold_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    tail = F.element_at(parts, -1).isin(".", "..")
    joined = F.array_join(F.when(tail, F.array_append(folded, F.lit(""))).otherwise(folded), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def site_of(url: Column | str) -> Column:
    """Scheme and authority as a struct, what references are resolved against."""
    return F.struct(url_part(url, "scheme").alias("scheme"), domain_of(url).alias("authority"))


def resolve_on(site: Column, href: Column) -> Column:
    """Absolute URL of a ``/path`` or ``//host/path`` reference on a site."""
    def build(h: Column) -> Column:
        return let(F.substring_index(F.substring_index(h, "#", 1), "?", 1), lambda path: joined(h, path))

    def joined(h: Column, path: Column) -> Column:
        rest = F.substr(h, F.length(path) + 1)
        rest = F.when(rest == "", "").otherwise(
            F.regexp_replace(F.regexp_replace(rest, "#$", ""), r"^\?(?=#|$)", ""))
        folded = F.when(path.contains("/."), F.when(path.rlike(r"/\.\.?(/|$)"), _fold_dots(path)).otherwise(path)).otherwise(path)
        start = F.concat(site["scheme"], F.lit(":"))
        return F.when(h.startswith("//"), F.concat(start, path, rest)).otherwise(
            F.concat(start, F.lit("//"), site["authority"], folded, rest))

    return let(F.regexp_replace(href, r"[\t\r\n]", ""), build)


def resolve_href(base: Column | str, href: Column | str) -> Column:
    """Absolute URL of a ``/path`` or ``//host/path`` reference on page ``base``."""
    return resolve_on(site_of(base), _col(href))
