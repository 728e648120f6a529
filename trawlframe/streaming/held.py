"""Sequential rules on streams: rows wait in a table until the watermark has passed them, and only then are folded in order."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.utils import AnalysisException

from trawlframe.operators.ordered import Fold
from trawlframe.streaming.levels import Levels, newest, remove

#: The waiting rows of one lateness lie in about so many buckets; none is shorter than an hour.
BUCKETS = 8
HOUR = 3_600_000_000


@dataclass(frozen=True)
class HeldFold:
    """A sequential rule over a stream, run by ``ingest.to_table``.

    ``rows`` is the stream of _key, _id, _us (event time in microseconds) and the columns ``names``. Nothing of a row is kept in a
    group's state: rows are landed in a table by bucket of time, and of a key only ``fold``'s state is carried. A micro-batch reads and
    writes the states of the keys that it folds and of no others.
    """

    rows: DataFrame
    names: tuple[str, ...]
    columns: tuple[str, str]
    fold: Fold
    outputs: dict[str, str]
    lateness: str
    ends: Callable[[str | None, int], int | None]
    idle_us: int | None = None

    def folded(self, ready: DataFrame, states: DataFrame | None) -> DataFrame:
        """The rule's rows (_last is null), and for each key of ``ready`` a row with its _state, the time of its _last row and until
        when the state lasts (null: it has ended). ``states`` are those of keys of ``ready``.

        A task streams through its sorted rows, the state of a key first: a key of any length needs the memory of a batch.
        """
        none = {"_state": F.lit(None).cast("string"), "_last": F.lit(None).cast("long"), "_until": F.lit(None).cast("long")}
        rows = ready.select("_key", "_id", "_us", *self.names).withColumns(none)
        if states is not None:
            rows = rows.unionByName(states.select("_key", "_state", "_last", "_until"), allowMissingColumns=True)
        out = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in ("_key", "_id", "_us", "_state", "_last", "_until")])
        for name, kind in self.outputs.items():
            out = out.add(name, kind)
        types = {f.name: to_arrow_type(f.dataType) for f in out.fields}
        fold, names, made_names, ends, idle_us = self.fold, self.names, list(self.outputs), self.ends, self.idle_us

        def frame(n: int, given: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in types.items()], list(types))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun, key, state, last = False, None, None, None
            closed: list[tuple] = []

            def close() -> None:
                if begun and last is not None:
                    end = ends(state, last // 1000)
                    closed.append((key, state, last, None if end is None else end * 1000))

            def give() -> Iterator[pa.RecordBatch]:
                if closed:
                    names_of_state = ("_key", "_state", "_last", "_until")
                    columns = [pa.array(list(c), types[n]) for n, c in zip(names_of_state, zip(*closed, strict=True), strict=True)]
                    yield frame(len(closed), dict(zip(names_of_state, columns, strict=True)))
                    closed.clear()

            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                codes = batch.column("_key").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), n]
                given = batch.column("_last").is_valid().to_numpy(zero_copy_only=False)
                at = batch.column("_us").fill_null(0).to_numpy(zero_copy_only=False)
                values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
                keep, made = np.zeros(n, dtype=bool), {c: np.full(n, None, dtype=object) for c in made_names}
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    new_key = batch.column("_key")[a].as_py()
                    if not begun or new_key != key:
                        close()
                        begun, key, state, last = True, new_key, None, None
                    if given[a]:
                        state, last = batch.column("_state")[a].as_py(), batch.column("_last")[a].as_py()
                        a += 1
                    gaps = [] if idle_us is None else (np.flatnonzero(np.diff(at[a:b]) > idle_us) + a + 1).tolist()
                    for i, j in zip([a, *gaps], [*gaps, b], strict=True):
                        if i == j:
                            continue
                        if idle_us is not None and last is not None and at[i] - last > idle_us:
                            state = None
                        new, state = fold({"_us": at[i:j], **{c: v[i:j] for c, v in values.items()}}, state)
                        keep[i:j] = new.get("_keep", True)
                        for c in made_names:
                            made[c][i:j] = new[c]
                        last = int(at[j - 1])
                mask = pa.array(keep)
                done = {c: batch.column(c).filter(mask) for c in ("_key", "_id", "_us")}
                yield frame(int(keep.sum()), done | {c: pa.array(v[keep].tolist(), types[c]) for c, v in made.items()})
                yield from give()
            close()
            yield from give()

        # The row with a key's state has no time and so comes first.
        return rows.repartition(F.col("_key")).sortWithinPartitions("_key", "_us", "_id").mapInArrow(run, out)

    def run(self, path: str, checkpoint: str, finish: bool = False) -> DataFrame:
        """Runs the stream over everything there is; the table at ``path`` gets the rows that the watermark has passed.

        ``finish`` gives out the rows that still wait too, as if nothing could follow. They stay waiting for a later run,
        which writes them again in their place. Rows that come behind the watermark of the micro-batches before, or have no time, cannot
        be folded in order: they go to the table at ``late_path(path)``, and a warning says how many they are.
        """
        spark = self.rows.sparkSession
        held = f"{checkpoint.rstrip('/')}-held"
        late_us = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL '{self.lateness}') AS us").first()["us"]
        width = max(HOUR, late_us // BUCKETS)
        bucket = lambda us: F.floor(us / F.lit(width))
        landed_as = T.StructType([*self.rows.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("_bucket", T.LongType())])

        states = Levels(f"{held}/states", f"_key {self.rows.schema['_key'].dataType.simpleString()}, _state string, _last long, _until long", ("_key",))
        done: list[int] = []

        def on_batch(batch: DataFrame, n: int) -> None:
            spark = batch.sparkSession
            # Every table of a batch is overwritten when it is repeated; its mark comes last.
            batch.withColumn("_bucket", bucket(F.col("_us"))).write.mode("overwrite").partitionBy("_bucket").parquet(f"{held}/landed/batch_id={n}")
            landed = spark.read.schema(landed_as).parquet(f"{held}/landed").where(F.col("batch_id") <= n)
            before = _mark(spark, held, n - 1)
            latest = landed.where(F.col("batch_id") == n).agg(F.max("_us")).first()[0]
            late = F.col("_us").isNull() if before is None else F.col("_us").isNull() | (F.col("_us") < before)
            landed.where((F.col("batch_id") == n) & late).drop("batch_id", "_bucket").write.mode("overwrite").parquet(f"{late_path(path)}/batch_id={n}")
            passed = max((x for x in (before, None if latest is None else latest // 1000 * 1000 - late_us) if x is not None), default=None)
            folded = f"{held}/folded/batch_id={n}"
            self._fold_into(landed, bucket, before, passed, states, n, folded, f"{path}/batch_id={n}")
            ended = lambda rows, oldest: newest(rows, states.keys).where(~F.lit(oldest) | (F.col("_until") >= F.lit(passed)))
            states.append(spark.read.schema(states.schema).parquet(folded).where("_last IS NOT NULL"), "", n, ended)
            spark.createDataFrame([(passed,)], "passed long").write.mode("overwrite").parquet(f"{held}/marks/batch_id={n}")
            done.append(n)
            # No later run of this batch or of those to come reads what lies before its mark.
            old = [] if before is None else _below(spark, f"{held}/landed", before // width - 1)
            remove(spark, folded, f"{held}/marks/batch_id={n - 2}", *old)

        query = (self.rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        key, row_id = self.columns
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema.fields}
        schema = f"_key {kinds['_key']}, _id {kinds['_id']}, _us long" + "".join(f", {n} {t}" for n, t in self.outputs.items())
        # What waits is batch -1 of the table, written anew by each run.
        n = _last_mark(spark, held)
        if finish and n is not None:
            landed, before = spark.read.schema(landed_as).parquet(f"{held}/landed").where(F.col("batch_id") <= n), _mark(spark, held, n)
            waiting = landed if before is None else landed.where((F.col("_bucket") >= bucket(F.lit(before))) & (F.col("_us") >= before))
            latest = waiting.agg(F.max("_us")).first()[0]
            self._fold_into(landed, bucket, before, before if latest is None else latest + 1, states, n + 1, f"{held}/folded/batch_id=-1", f"{path}/batch_id=-1")
        else:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch_id=-1")
        if done and (missed := spark.read.schema(self.rows.schema).parquet(*[f"{late_path(path)}/batch_id={k}" for k in done]).count()):
            warnings.warn(f"{missed} rows came after the watermark or have no time; they are in {late_path(path)}", stacklevel=2)
        return spark.read.schema(schema).parquet(path).select(
            F.col("_key").alias(key), F.col("_id").alias(row_id), F.timestamp_micros("_us").alias("ts"), *self.outputs)

    def _fold_into(self, landed: DataFrame, bucket: Callable[[Column], Column], before: int | None, passed: int | None, states: Levels,
                   n: int, folded: str, path: str) -> None:
        """Folds the rows from ``before`` to ``passed`` (None: from the first, none) on the states that the first ``n`` micro-batches left, as
        a repeated batch must not see its own: rows and new states to ``folded``, rows alone to ``path``."""
        spark = landed.sparkSession
        ready = landed.where(F.lit(False) if passed is None else (F.col("_bucket") <= bucket(F.lit(passed))) & (F.col("_us") < passed))
        if before is not None:
            ready = ready.where((F.col("_bucket") >= bucket(F.lit(before))) & (F.col("_us") >= before))
        runs, known = states.live(n), None
        if runs and before is not None:
            keys = ready.select(F.col("_key").alias("_ready")).distinct()
            within = states.buckets_of(ready) if runs[0][0] else None
            last = newest(states.read(spark, within, runs), states.keys).where(F.col("_until") >= before)
            known = last.join(keys, F.col("_key").eqNullSafe(F.col("_ready")), "left_semi")
        self.folded(ready, known).write.mode("overwrite").parquet(folded)
        rows = spark.read.parquet(folded).where("_last IS NULL").drop("_state", "_last", "_until")
        rows.write.mode("overwrite").parquet(path)


def late_path(path: str) -> str:
    """The table of the rows (_key, _id, _us and the rule's columns) that came too late for the one at ``path``."""
    return f"{path.rstrip('/')}-late"


def _mark(spark: SparkSession, held: str, n: int) -> int | None:
    """How far the watermark was after micro-batch ``n``."""
    return spark.read.parquet(f"{held}/marks/batch_id={n}").first()["passed"] if n >= 0 else None


def _below(spark: SparkSession, landed: str, bucket: int) -> list[str]:
    """The folders of landed rows with a bucket of time before ``bucket``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{landed}/batch_id=*/_bucket=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    paths = [str(f.getPath()) for f in found]
    return [p for p in paths if p.rsplit("=", 1)[1].lstrip("-").isdigit() and int(p.rsplit("=", 1)[1]) < bucket]


def _last_mark(spark: SparkSession, held: str) -> int | None:
    try:
        return spark.read.parquet(f"{held}/marks").agg(F.max("batch_id")).first()[0]
    except AnalysisException:  # no micro-batch yet
        return None


def held_fold(stream: DataFrame, key: str, ts: str, row_id: str, values: dict, fold: Fold, outputs: dict[str, str], lateness: str,
              ends: Callable[[str | None, int], int | None], idle_seconds: float | None = None) -> HeldFold:
    """``key, row_id, ts`` and ``outputs`` of the rows that ``fold`` keeps, the same for any split into micro-batches.

    A row comes out once the watermark, ``lateness`` behind the latest row of the stream, has passed it; with less ``lateness`` than rows
    really have, those behind it are put aside. ``fold`` gets _us (event time
    in microseconds) and the columns of ``values`` (name → Column). A key's state stays until ``ends(state, last row in ms)`` (event
    time in ms; None: at once) has passed; after ``idle_seconds`` without a row a key starts afresh.
    """
    rows = stream.select(F.col(key).alias("_key"), F.col(row_id).alias("_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"),
                         *[c.alias(n) for n, c in values.items()])
    idle_us = None if idle_seconds is None else int(idle_seconds * 1_000_000)
    return HeldFold(rows, tuple(values), (key, row_id), fold, outputs, lateness, ends, idle_us)
