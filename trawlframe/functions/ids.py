"""Time-ordered ids and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Epoch offset in ms and the bit layout (time, worker, sequence).
EPOCH_MS = 1_600_000_000_000
TIME_SHIFT, WORKER_SHIFT, WORKER_MASK, SEQUENCE_MASK = 22, 12, 0x3FF, 0xFFF


def snowflake(ts: Column, sequence: Column, worker: int = 1) -> Column:
    """64-bit id of a time, a worker and a sequence number."""
    ms = F.unix_millis(ts.cast("timestamp")) - F.lit(EPOCH_MS)
    return (F.shiftleft(ms, TIME_SHIFT)
            .bitwiseOR(F.lit((worker & WORKER_MASK) << WORKER_SHIFT).cast("long"))
            .bitwiseOR(sequence.cast("long").bitwiseAND(F.lit(SEQUENCE_MASK).cast("long"))))


def snowflake_time(snowflake_id: Column) -> Column:
    return F.timestamp_millis(F.shiftright(snowflake_id.cast("long"), TIME_SHIFT) + F.lit(EPOCH_MS))


def snowflake_worker(snowflake_id: Column) -> Column:
    return F.shiftright(snowflake_id.cast("long"), WORKER_SHIFT).bitwiseAND(F.lit(WORKER_MASK).cast("long")).cast("int")


def snowflake_sequence(snowflake_id: Column) -> Column:
    return snowflake_id.cast("long").bitwiseAND(F.lit(SEQUENCE_MASK).cast("long")).cast("int")


def row_uuid(*key: Column) -> Column:
    """Hex id; from a natural key it is the same on every run."""
    return F.left(F.sha2(F.concat_ws("\x1f", *key), 256), F.lit(32)) if key else F.replace(F.uuid(), F.lit("-"), F.lit(""))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"))


def file_name(task_id: Column, ts: Column, template: str = "{task_id}_{timestamp}") -> Column:
    """The template with its two names filled in."""
    stamp = F.date_format(ts, "yyyyMMdd_HHmmss")
    name = F.replace(F.lit(template), F.lit("{task_id}"), task_id.cast("string"))
    return F.replace(name, F.lit("{timestamp}"), stamp)


def export_name(ts: Column) -> Column:
    return F.concat(F.lit("task_results_"), F.date_format(ts, "yyyyMMdd_HHmmss"))
