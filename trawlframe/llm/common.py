"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.session import scratch_path

# The white space of the contracts, space and the controls 9 to 13.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the work above is done
    once, and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession) -> int:
    """Number of tasks for an explicit repartition: the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels may not be learned from (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_slices(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into consecutive runs of about ``budget`` bytes; a longer row is a run of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > budget:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``budget`` bytes of text, so that the
    Python objects made from them stay small however long the texts are."""
    texts = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    for a, b in row_slices(sizes, budget):
        yield batch.slice(a, b - a)


def segments_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows): the runs of equal keys of each batch; a run that goes on in the next batch comes in several pieces."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield tuple(c[a] for c in columns), batch.slice(a, b - a)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys in a stream of batches that is sorted by them.

    Rows of one key must sit in one partition (an explicit repartition by the
    key). Only the run that reaches a batch's end is carried on, so memory is
    that of a batch and of the largest run, which callers bound.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for key, rows in segments_of(batches, keys):
        if held and key != held_key:
            yield pa.Table.from_batches(held)
            held = []
        held_key = key
        held.append(rows)
    if held:
        yield pa.Table.from_batches(held)


def map_runs(df: DataFrame, keys: list[str], order: list[str], work: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]],
             schema: str) -> DataFrame:
    """Applies ``work`` to the stream of key runs of each partition."""
    spread = df.repartition(tasks_of(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return spread.mapInArrow(lambda batches: work(groups_of(batches, keys)), schema)


def deal_units(rows: DataFrame, item: str, n_blocks: Column) -> DataFrame:
    """``rows`` with a unit of work (u, v): the rows of a key are dealt to ``n_blocks`` blocks by the hash of
    ``item``, and every two blocks, or one with itself, make a unit. Any two rows of a key meet in a unit, and
    a unit never holds more than two blocks however many rows the key has. ``block`` says to which block a row belongs."""
    return (rows.withColumn("n_blocks", n_blocks.cast("int"))
            .withColumn("block", F.pmod(F.xxhash64(item), F.col("n_blocks")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
            .withColumns({"u": F.least("block", "other"), "v": F.greatest("block", "other")}).drop("n_blocks", "other"))


def merge_edges(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) after adding the edges a[i]-b[i] to a
    partition given as labels; all in arrays, a few rounds of hooking and jumping."""
    labels = labels.copy()
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        low, high = np.minimum(la[differ], lb[differ]), np.maximum(la[differ], lb[differ])
        np.minimum.at(labels, high, low)
        while True:
            nxt = labels[labels]
            if np.array_equal(nxt, labels):
                break
            labels = nxt


def smallest_of(ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each row the smallest id with its label."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, ids)
    return least[labels]


#: Up to this product of norms every partial sum of an inner product of integers is exact in double precision.
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


def whole_parts(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles, as doubles (beyond their range: the largest of them)."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256.0 * x), posinf=np.finfo(float).max, neginf=np.finfo(float).min)


def norms_of(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((values * values).sum(axis=-1))


def integer_scores(values: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Inner products of rows of integers (as doubles) with ``q``, exact; beyond 63 bits and a sign the nearest number that fits.

    Rows that doubles could round go through Python's integers.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        sure = norms * q_norm <= EXACT
        out = np.where(sure, values @ q, 0.0).astype(np.int64)
    if not sure.all():
        own = [int(c) for c in q]
        for i in np.flatnonzero(~sure).tolist():
            out[i] = min(max(sum(int(a) * b for a, b in zip(values[i], own, strict=True)), -LONG), LONG)
    return out


def vectors_of(column: pa.Array, length: int) -> np.ndarray:
    """A batch's vectors of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def fit_vector(vector: Column) -> Column:
    """True for a vector that is not null or empty and holds no null or non-finite component."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
