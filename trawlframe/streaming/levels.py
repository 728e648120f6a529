"""Keyed tables that grow by micro-batches: runs in levels, merged as they fill up.

Every batch adds a run. ``fan`` runs of a level become one run of the next, so after n batches a reader opens no more than
(fan - 1) * log(n) runs and a row has been written log(n) times. Which runs are live follows from the number of batches alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes folders of any storage that Spark can write to; what does not exist is passed over."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def newest(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of each key the row of the last batch that has one."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_seq").alias("_row")).select(*keys, "_row.*")


@dataclass(frozen=True)
class Levels:
    """A keyed table at ``path`` with the columns ``schema`` (DDL), which gets one run per batch from one writer at a time.

    A batch is known by its stream and number: one that is already in the table changes nothing when it comes again. The commit comes
    last, so a run left by a batch that failed is overwritten. Runs above the lowest level are foldered by hash bucket of
    ``keys``: a reader that knows its keys opens only their folders. Merged runs are removed a batch after the merge; a DataFrame read earlier
    than that has to be read anew.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    fan: int = 8
    buckets: int = 64

    def live(self, count: int) -> list[tuple[int, int]]:
        """(level, first batch) of the runs that hold the first ``count`` batches."""
        runs, first, level = [], 0, 0
        while self.fan ** (level + 1) <= count:
            level += 1
        for at in range(level, -1, -1):
            for _ in range((count - first) // self.fan ** at):
                runs.append((at, first))
                first += self.fan ** at
        return runs

    def folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/level={run[0]}/first={run[1]}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of ``rows``: a list that the setting bounds."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def committed(self, spark: SparkSession) -> tuple[int, dict[str, int]]:
        """The number of batches in the table and the last one of each stream."""
        try:
            rows = spark.read.schema("stream string, batch_id long, count long").parquet(f"{self.path}/commits").collect()
        except AnalysisException:  # no batch yet
            return 0, {}
        count = max((r["count"] for r in rows), default=0)
        return count, {r["stream"]: r["batch_id"] for r in rows if r["count"] == count}

    def read(self, spark: SparkSession, within: list[int] | None = None, runs: list[tuple[int, int]] | None = None) -> DataFrame:
        """All rows of the live runs with the number of their batch as _seq; of the buckets ``within`` alone if given."""
        runs = self.live(self.committed(spark)[0]) if runs is None else runs
        flat = [self.folder(r) for r in runs if r[0] == 0]
        parts = [(flat, f"{self.schema}, _seq long", self.bucket())] if flat else []
        parts += [([self.folder(r)], f"{self.schema}, _seq long, _bucket int", F.col("_bucket")) for r in runs if r[0]]
        out = None
        for folders, schema, bucket in parts:
            rows = spark.read.schema(schema).parquet(*folders)
            rows = (rows if within is None else rows.where(bucket.isin(within))).drop("_bucket")
            out = rows if out is None else out.unionByName(rows)
        return spark.createDataFrame([], f"{self.schema}, _seq long") if out is None else out

    def append(self, rows: DataFrame, stream: str, batch_id: int, merge: Callable[[DataFrame, bool], DataFrame] | None = None) -> None:
        """Adds a batch. ``merge`` (rows of several runs with _seq, whether these reach back to the first batch) reduces runs
        that become one; without it the newest row of each key stays."""
        spark = rows.sparkSession
        count, batches = self.committed(spark)
        if batches.get(stream, -1) >= batch_id:
            return
        level = 0
        while (count + 1) % self.fan ** (level + 1) == 0:
            level += 1
        first = count + 1 - self.fan ** level
        new = rows.withColumn("_seq", F.lit(count).cast("long"))
        if level:
            both = self.read(spark, runs=[r for r in self.live(count) if r[1] >= first]).unionByName(new)
            merged = merge(both, first == 0) if merge else newest(both, self.keys)
            merged.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self.folder((level, first)))
        else:
            new.write.mode("overwrite").parquet(self.folder((0, first)))
        rows_of_commit = sorted((batches | {stream: batch_id}).items())
        spark.createDataFrame(rows_of_commit, "stream string, batch_id long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/count={count + 1}")
        # What the batch before this one replaced; its commit is no longer the last.
        gone = set(self.live(count - 1)) - set(self.live(count)) if count > 0 else set()
        remove(spark, *[self.folder(r) for r in gone], f"{self.path}/commits/count={count - 1}")
