"""Exports of records as JSON, CSV, Parquet or a registered format."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlframe.session import cut_lineage

Writer = Callable[[DataFrame, str], None]

MANIFEST = "export_id string, task_id string, format string, path string, records long, ok boolean, error string, exported_at timestamp"


def _flat(df: DataFrame) -> list[Column]:
    """Columns in sorted order, nested ones as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in sorted(df.columns)]


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, columns sorted by name, missing values empty."""
    df.select(*_flat(df)).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


WRITERS: dict[str, Writer] = {"json": write_json, "csv": write_csv, "parquet": write_parquet}


def register_writer(name: str, writer: Writer) -> None:
    WRITERS[name] = writer


def export(df: DataFrame, path: str, formats: Iterable[str] = ("json", "csv", "parquet"), *, task_id: str = "",
           now: datetime | None = None, store_first: bool = False) -> DataFrame:
    """Writes every known format below ``path`` and returns the manifest, one
    row per format. Unknown formats are skipped and a failing one does not stop
    the others. Rows are counted while they are written. ``store_first`` keeps
    records that are costly to compute in the checkpoint folder, so that they
    are computed once and not once per format.
    """
    if store_first:
        df = cut_lineage(df)
    spark = df.sparkSession
    at = now or datetime.now(timezone.utc)
    export_id = uuid.uuid4().hex
    rows = []
    for name in formats:
        if name not in WRITERS:
            continue
        target = f"{path.rstrip('/')}/{name}"
        seen = Observation()
        try:
            if name == "csv" and df.isEmpty():
                raise ValueError("no records to export")
            WRITERS[name](df.observe(seen, F.count(F.lit(1)).alias("records")), target)
            rows.append((export_id, task_id, name, target, int(seen.get["records"]), True, None, at))
        except Exception as e:  # noqa: BLE001 - reported in the manifest
            rows.append((export_id, task_id, name, target, 0, False, f"{type(e).__name__}: {e}", at))
    return spark.createDataFrame(rows, MANIFEST)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
