"""Live circuit breaker state per host."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.functions.outcomes import is_success
from trawlframe.operators.fetchlog import FAILURE_THRESHOLD, RECOVERY_SECONDS, breaker_fold
from trawlframe.streaming.held import HeldFold, held_fold


def breaker_states(stream: DataFrame, host: str = "host", ts: str = "ts", row_id: str = "event_id",
                   threshold: int = FAILURE_THRESHOLD, recovery_seconds: float = RECOVERY_SECONDS, lateness: str = "0 seconds",
                   idle_seconds: float | None = None) -> HeldFold:
    """Streaming form of the breaker replay: the same fold over calls in order of time, each given out
    when the watermark has passed it. A host without failures in a row keeps no state; another one
    keeps it, or is forgotten ``idle_seconds`` after its last call. ``ingest.to_table`` runs it."""
    def ends(state: str | None, last: int) -> int | None:
        if not state or json.loads(state) == {"failures": 0}:
            return None
        return last + int(idle_seconds * 1000) if idle_seconds is not None else (1 << 53)

    return held_fold(stream, host, ts, row_id, {"_ok": is_success(F.col("status_code"))}, breaker_fold(threshold, recovery_seconds),
                     {"decision": "string", "state": "string"}, lateness, ends,
                     idle_seconds)
