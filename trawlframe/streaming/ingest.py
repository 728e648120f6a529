"""Continuous jobs from page and result streams into tables.

Each batch writes so that repeating it after a failure changes nothing: it
overwrites its own folders, and what it adds to a keyed table counts from the commit on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from trawlframe.functions.outcomes import is_success
from trawlframe.operators.extraction import extract_fields
from trawlframe.operators.requests import fingerprint, load_idempotent
from trawlframe.operators.validation import FieldRule, split, validate
from trawlframe.streaming.held import HeldFold
from trawlframe.streaming.levels import Levels, newest


def available_now(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``on_batch`` over everything there is, then stops."""
    query = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def to_table(stream: DataFrame | HeldFold, path: str, checkpoint: str, mode: str = "append", finish: bool = False) -> DataFrame:
    """Runs the stream over everything there is into a Parquet table. Of a sequential rule ``finish`` gives out the rows that still wait
    for the watermark too; any other stream ends with ``closing_row``."""
    if isinstance(stream, HeldFold):
        return stream.run(path, checkpoint, finish)
    if finish:
        raise ValueError("only a sequential rule can be finished: let the source end with closing_row")
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def closing_row(rows: DataFrame, ts: str, beyond_us: int) -> DataFrame:
    """One row of nulls but for ``ts``, which lies ``beyond_us`` after the latest of ``rows``. As the last micro-batch of a source it moves
    the watermark past all others (lateness and window width and more must fit into ``beyond_us``); its own window stays open."""
    kind = rows.schema[ts].dataType
    later = F.timestamp_micros(F.unix_micros(F.max(F.col(ts).cast("timestamp"))) + F.lit(beyond_us)).cast(kind)
    return rows.agg(later.alias(ts)).select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def stream_of(spark: SparkSession) -> str:
    """The id of the stream whose batch function runs; a restart from the same checkpoint keeps it."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def key_index(path: str, task_id_type: str, buckets: int = 64) -> Levels:
    """The (task_id, fp) of the records at ``path``, beside them."""
    return Levels(f"{path.rstrip('/')}-keys", f"task_id {task_id_type}, fp string", ("task_id", "fp"), buckets=buckets)


def ingest_pages(rules: dict[str, str], task_id: Column, path: str, selector_type: str = "css", buckets: int = 64):
    """Batch function: extract the fields of arriving pages and add records
    not stored yet; one record per task and fingerprint.

    Records lie in folders by stream and batch. What is stored is looked up in an index of keys beside the table, of which a batch reads the
    buckets that its own keys fall into. One stream at a time may write to a table.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark, stream = batch.sparkSession, stream_of(batch.sparkSession)
        keyed = batch.withColumns({"task_id": task_id, "fp": fingerprint(F.col("url"))})
        index = key_index(path, keyed.schema["task_id"].dataType.simpleString(), buckets)
        count, batches = index.committed(spark)
        if batches.get(stream, -1) >= batch_id:
            return
        records = extract_fields(batch, rules, selector_type).withColumns({"task_id": task_id, "fp": fingerprint(F.col("url"))})
        stored = index.read(spark, index.buckets_of(keyed), index.live(count)).select("task_id", "fp")
        folder = f"{path}/stream={stream}/batch_id={batch_id}"
        load_idempotent(records, stored, ["task_id", "fp"], ["page_id"]).write.mode("overwrite").parquet(folder)
        added = spark.read.schema(index.schema).parquet(folder)
        index.append(added, stream, batch_id)
    return on_batch


def progress(results: DataFrame) -> DataFrame:
    """Running totals per task; in update mode each batch gives the tasks it
    touched."""
    ok = is_success(F.col("status_code"))
    return results.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("done_count"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failed_count"))


def run_progress(results: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Keeps the totals of the tasks that each batch touched, in levels at ``path``, and returns the latest of each task."""
    spark, totals = results.sparkSession, progress(results)
    table = Levels(path.rstrip("/"), _ddl(totals), ("task_id",))
    query = (totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda batch, batch_id: table.append(batch, stream_of(batch.sparkSession), batch_id)).start())
    query.awaitTermination()
    return newest(table.read(spark), table.keys).drop("_seq")


def validate_into(schema: dict[str, FieldRule] | str, valid_path: str, rejected_path: str):
    """Batch function: valid rows to one table, rejected ones with their report
    to another. The batch is validated for each; :func:`validate_by_outcome` does it once."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = split(validate(batch, schema))
        valid.drop("report").write.mode("overwrite").parquet(f"{valid_path}/batch_id={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
    return on_batch


def validate_by_outcome(schema: dict[str, FieldRule] | str, path: str, counts: Callable[[int, dict[str, int]], None] | None = None):
    """Batch function: all rows in one pass to the table at ``path``, in folders by batch and by ``outcome`` (valid, rejected); valid rows have no report.
    ``counts`` gets the batch's number and how many rows were valid and rejected, counted in that pass."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        seen, ok = Observation(), F.col("report.is_valid")
        marked = validate(batch, schema).select(*batch.columns, F.when(~ok, F.col("report")).alias("report"), F.when(ok, "valid").otherwise("rejected").alias("outcome"))
        counted = marked.observe(seen, *[F.count_if(F.col("outcome") == o).alias(o) for o in ("valid", "rejected")])
        counted.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch_id={batch_id}")
        if counts:
            counts(batch_id, seen.get)
    return on_batch
