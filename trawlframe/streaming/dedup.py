"""Duplicate removal on request streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.operators.requests import _accept
from trawlframe.streaming.held import HeldFold, held_fold


def first_within(stream: DataFrame, key: str, ts: str, duration: str, lateness: str | None = None) -> DataFrame:
    """One row per key and period: event time is cut into periods of ``duration``, and of a key's rows in a
    period the one that arrives first passes, whatever the micro-batches. A period's keys are forgotten ``lateness`` (default: the duration)
    after its end. ``period`` is its start."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness or duration)
    # The period takes over as the event time: a stream may have one only, and it says when a key is forgotten.
    periods = timed.withColumn("_period", F.window(ts, duration)).withColumn(ts, F.col(ts) + F.expr("INTERVAL 0 SECONDS"))
    once = periods.dropDuplicates([key, "_period"])
    return once.withColumn("period", F.col("_period.start")).drop("_period")


def accept_with_ttl(stream: DataFrame, key: str, ts: str, row_id: str, ttl: int, lateness: str = "0 seconds") -> HeldFold:
    """Streaming form of the batch rule of the same name: an entry expires more
    than ``ttl`` seconds after its last accepted request.

    Rows are taken in order of time, each when the watermark has passed it. A key's state ends with its entry. ``ingest.to_table`` runs it.
    """
    fold = _accept(ttl)

    def by_second(values, state):
        return fold({"second": values["_us"] // 1_000_000}, state)

    def ends(state: str | None, last: int) -> int | None:
        return (int(state) + ttl + 1) * 1000 if state is not None else None

    return held_fold(stream, key, ts, row_id, {}, by_second, {}, lateness, ends)
