"""Request fingerprints and duplicate removal.

A fingerprint may be hot (one URL requested in a third of all rows), so every
operator here reduces per fingerprint before the shuffle.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlframe.functions.jsontext import header_pieces, header_text, join_pieces, payload_pieces, payload_text
from trawlframe.functions.urls import join_url, normalize_url, split_url
from trawlframe.operators.ordered import Rule, ordered_fold

# Header names that never count, and the presets.
DEFAULT_IGNORED_HEADERS = (
    "User-Agent", "Accept", "Accept-Language", "Accept-Encoding", "Connection",
    "Upgrade-Insecure-Requests", "Cache-Control",
    "Sec-Fetch-Dest", "Sec-Fetch-Mode", "Sec-Fetch-Site",
)


@dataclass(frozen=True)
class FingerprintConfig:
    """What of a request counts, and how long and how many are remembered."""

    url: bool = True
    method: bool = True
    headers: bool = False
    data: bool = True
    ignore_params: tuple[str, ...] = ()
    ignore_headers: tuple[str, ...] = DEFAULT_IGNORED_HEADERS
    sort_params: bool = True
    max_size: int = 100_000
    ttl: int | None = None


PRESETS: dict[str, FingerprintConfig] = {
    "default": FingerprintConfig(),
    "basic": FingerprintConfig(method=False, data=False, max_size=10_000),
    "strict": FingerprintConfig(
        headers=True, ignore_params=("timestamp", "nonce", "signature"),
        ignore_headers=("User-Agent", "Cookie"), max_size=5_000),
    "api": FingerprintConfig(
        ignore_params=("timestamp", "t", "_", "callback", "random"), max_size=20_000, ttl=3600),
}


def preset(name: str) -> FingerprintConfig:
    """The named preset; an unknown name means the default."""
    return PRESETS.get(name, PRESETS["default"])


def fingerprint(
    url: Column,
    method: Column | None = None,
    headers: Column | None = None,
    data: Column | None = None,
    config: FingerprintConfig = PRESETS["default"],
) -> Column:
    """MD5 hex of the parts of a request that count."""
    parts = []
    if config.method:
        parts.append(F.concat(F.lit("METHOD:"), F.upper(method if method is not None else F.lit("GET"))))
    if config.url:
        parts.append(F.concat(F.lit("URL:"), normalize_url(url, config.ignore_params, config.sort_params)))
    if config.data and data is not None:
        parts.append(F.concat(F.lit("DATA:"), payload_text(data, config.ignore_params)))
    if config.headers and headers is not None:
        parts.append(F.concat(F.lit("HEADERS:"), header_text(headers, config.ignore_headers)))
    # concat_ws leaves out parts that are null.
    return F.md5(F.concat_ws("|", *parts))


def with_fingerprint(df: DataFrame, config: FingerprintConfig = PRESETS["default"]) -> DataFrame:
    """Adds ``fp`` from the columns url, method, headers, data that exist."""
    has = {c: F.col(c) if c in df.columns else None for c in ("method", "headers", "data")}
    return df.withColumn("fp", fingerprint(F.col("url"), has["method"], has["headers"], has["data"], config))


def with_fingerprints(df: DataFrame, configs: dict[str, FingerprintConfig]) -> DataFrame:
    """Adds a fingerprint column for each name in ``configs`` from the columns url, method, headers, data that exist. URL, payload and
    headers are taken apart once; a configuration only leaves parts out and joins the rest."""
    own = list(df.columns)
    if not all(c.sort_params for c in configs.values()):
        has = {c: F.col(c) if c in own else None for c in ("method", "headers", "data")}
        return df.withColumns({n: fingerprint(F.col("url"), has["method"], has["headers"], has["data"], c) for n, c in configs.items()})
    # One column a part: of a struct that is only taken apart again the optimizer would make a copy for each use.
    parts = {f"_url_{name}": part for name, part in split_url("url").items()}
    if "data" in own:
        parts["_data"] = payload_pieces(F.col("data"))
    if "headers" in own:
        parts["_headers"] = header_pieces(F.col("headers"))
    method = F.concat(F.lit("METHOD:"), F.upper("method") if "method" in own else F.lit("GET"))

    def joined(config: FingerprintConfig) -> Column:
        texts = [method] if config.method else []
        if config.url:
            texts.append(F.concat(F.lit("URL:"), join_url({name: F.col(f"_url_{name}") for name in ("base", "pairs", "fixed")}, config.ignore_params)))
        if config.data and "data" in own:
            texts.append(F.concat(F.lit("DATA:"), join_pieces(F.col("_data"), config.ignore_params)))
        if config.headers and "headers" in own:
            texts.append(F.concat(F.lit("HEADERS:"), join_pieces(F.col("_headers"), [h.lower() for h in config.ignore_headers])))
        return F.md5(F.concat_ws("|", *texts))

    return df.withColumns(parts).select(*own, *[joined(c).alias(n) for n, c in configs.items()])


def first_seen(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order``, whose columns should end in an id.

    The rank filter is cut down to one candidate per key and map task before
    the shuffle, so a hot key costs one row per map task.
    """
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unseen(df: DataFrame, seen: DataFrame, key: str | list[str] = "fp") -> DataFrame:
    """Rows whose key is not in the stored seen-set."""
    keys = [key] if isinstance(key, str) else key
    return df.join(seen.select(*keys), keys, "left_anti")


def already_seen(df: DataFrame, seen: DataFrame, key: str | list[str] = "fp") -> DataFrame:
    """Rows whose key is in the stored seen-set."""
    keys = [key] if isinstance(key, str) else key
    return df.join(seen.select(*keys), keys, "left_semi")


def admit(df: DataFrame, seen: DataFrame, order: list, key: str = "fp") -> DataFrame:
    """New requests of a batch: first of each key, if not stored already.
    Duplicates within the batch go first, so the join meets each key once."""
    return unseen(first_seen(df, key, order), seen, key)


def newest(seen: DataFrame, max_size: int, ts: str = "ts", key: str = "fp") -> DataFrame:
    """The ``max_size`` entries accepted last; what a bounded seen-set keeps."""
    return seen.orderBy(F.col(ts).desc(), F.col(key)).limit(max_size)


def forget(seen: DataFrame, removed: DataFrame, key: str = "fp") -> DataFrame:
    """Seen-set without the listed fingerprints."""
    return unseen(seen, removed, key)


def dedup_stats(df: DataFrame, config: FingerprintConfig, key: str = "fp") -> DataFrame:
    """One row: requests, distinct fingerprints, duplicates dropped, limits."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requests"),
        F.count(F.lit(1)).alias("total_fingerprints"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    ).select(
        F.lit("table").alias("backend"), "requests", "total_fingerprints", "duplicates",
        F.lit(config.max_size).alias("max_size"), F.lit(config.ttl).cast("int").alias("ttl"))


def duplicate_report(df: DataFrame, url: str = "url", key: str = "fp") -> DataFrame:
    """Long form: for each fingerprint seen more than once, its distinct URLs
    with their counts, the group's size and its number of spellings."""
    members = df.groupBy(key, url).agg(F.count(F.lit(1)).alias("n"))
    groups = (members.groupBy(key).agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("variants"))
              .where("group_size > 1"))
    return members.join(groups, key).select(key, url, "n", "group_size", "variants")


def _accept(ttl: int):
    """Fold for one key: sorted whole seconds -> those accepted again."""
    def fold(values: dict[str, np.ndarray], state: str | None):
        seconds = values["second"]
        taken = np.zeros(len(seconds), dtype=bool)
        last = json.loads(state) if state else None
        i = 0 if last is None else int(np.searchsorted(seconds, last + ttl, side="right"))
        while i < len(seconds):
            taken[i] = True
            last = int(seconds[i])
            i = int(np.searchsorted(seconds, last + ttl, side="right"))
        return {"_keep": taken}, (None if last is None else json.dumps(last))
    return fold


def accept_rule(ttl: int) -> Rule:
    """The rule that can be composed: the state is the last accepted second, which leads from each second to the next accepted one.

    The first one accepted in a slice lies within its first ``ttl`` seconds, so the summary lists no others.
    """
    def summary(values: dict[str, np.ndarray]) -> str:
        seconds = values["second"]
        n = len(seconds)
        following = np.searchsorted(seconds, seconds + ttl, side="right")
        jump = np.where(following < n, following, np.arange(n))
        while not np.array_equal(further := jump[jump], jump):
            jump = further
        ends = jump[:int(np.searchsorted(seconds, seconds[0] + ttl, side="right")) + 1]
        kept = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
        return json.dumps({"at": seconds[kept].tolist(), "exits": seconds[ends[kept]].tolist()})

    def through(told: str, state: str | None) -> str | None:
        known = json.loads(told)
        i = 0 if state is None else bisect_right(known["at"], json.loads(state) + ttl)
        return json.dumps(known["exits"][i]) if i < len(known["at"]) else state

    return Rule(_accept(ttl), summary, through)


def accept_with_ttl(df: DataFrame, key: str, ts: str, row_id: str, ttl: int) -> DataFrame:
    """Rows accepted when an entry expires more than ``ttl`` whole seconds after
    its last *accepted* request; duplicates in between do not extend it.

    Within one second only the first row can be accepted, so each key is first
    reduced to one row per second of its span. Keys that are still long are cut
    into slices, whose effects are composed.
    """
    seconds = df.select(key, row_id, F.unix_seconds(F.col(ts).cast("timestamp")).alias("second"), F.col(ts).alias("_ts"))
    per_second = seconds.groupBy(key, "second").agg(F.min(F.struct("_ts", row_id)).alias("first"))
    slim = per_second.select(key, "second", F.col("first._ts").alias("ts"), F.col(f"first.{row_id}").alias(row_id))
    fields = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())
    return ordered_fold(slim, key, ["second"], ["second"], accept_rule(ttl), schema).select(key, row_id, "ts")


def content_key(columns: Iterable[str]) -> Column:
    """SHA-256 of a record's JSON text, fields in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def load_idempotent(batch: DataFrame, stored: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of ``batch`` to append so that ``keys`` stay unique in ``stored``."""
    return unseen(first_seen(batch, keys, order), stored, keys)
