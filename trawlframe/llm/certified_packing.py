"""Packing documents into sequences: best-fit decreasing with certified bin counts.

Documents are tokenised once; all that is kept of a piece is its length and digest. Pieces of full length are sequences of
their own. The others are dealt to partitions of bounded size by a hash, and each partition is packed best-fit decreasing. Dual-feasible
functions bound from below how few sequences its pieces can have; a partition that meets its bound is done. Those with a gap
exchange: their sequences with room left are dealt anew, whole, to as few partitions as hold them, and packed again. A partition takes
the new packing if it has fewer sequences than came in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import map_runs, stored, table, text_slices
from trawlframe.llm.pair_index_bpe import tokenizer_path
from trawlframe.llm.token_ids import LibraryIds, built, ship
from trawlframe.plans.registry import query


@dataclass(frozen=True)
class Settings:
    """``capacity`` tokens of a sequence; about ``part_rows`` pieces of a partition; at most ``rounds`` exchanges."""

    capacity: int = 1024
    part_rows: int = 65_536
    rounds: int = 3
    end_id: int = 2


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, each into the fullest bin that it fits, equal ones in order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    n_bins = 0
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = at, capacity - room
        by_room[room - length].append(at)
        rooms |= 1 << (room - length)
    return bins, offsets


def fewest_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins that pieces need: the largest of the bounds by three families of dual-feasible functions.

    Such a function maps lengths to weights so that no filled bin weighs more than one; all weights together are
    then a bound. The families: middle lengths keep their share, larger ones count whole and smaller ones not at all (this one
    has the plain sum as its first member); lengths rounded to multiples of 1 / (k + 1); and lengths counted by how many
    pieces of a least length fit beside them.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(object)  # Python integers: no sum overflows
    x = np.arange(capacity + 1)
    weights: list[tuple[np.ndarray, int]] = []
    for least in range(capacity // 2 + 1):
        weights.append((np.where(x > capacity - least, capacity, np.where(x < least, 0, x)), capacity))
    for k in range(1, 33):
        weights.append((np.where(x * (k + 1) % capacity == 0, k * x, x * (k + 1) // capacity * capacity), k * capacity))
    for least in range(1, capacity // 2 + 1):
        fit = capacity // least
        weights.append((np.where(2 * x > capacity, fit - (capacity - x) // least, np.where(x >= least, 1, 0)), fit))
    seen = np.flatnonzero(counts)
    return max(-(-int((w[seen].astype(object) * counts[seen]).sum()) // whole) for w, whole in weights)


def pieces(docs: DataFrame, spec: str, s: Settings) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32) of all pieces; uid numbers them within this run of the tasks, so store the table."""
    shared = ship(docs.sparkSession, spec=spec)
    end, capacity = np.uint32(s.end_id).tobytes(), s.capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, uid = built(shared, LibraryIds), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in text_slices(whole, "text"):
                ids = [x + end for x in library.encode(batch.column("text").to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                n_pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(ids)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                first = sizes - (n_pieces - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                crc = [zlib.crc32(memoryview(ids[r])[4 * a:4 * (a + n)]) for r, a, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(len(row))), batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64())], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
                uid += len(row)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(work, "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"))


PLACED = "uid bigint, length bigint, sequence_id bigint, offset bigint, room bigint, gap bigint"


def _packed(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows`` (part, uid, length, and sequence_id and offset of the packing so far, or null) packed anew where that needs fewer sequences:
    (uid, length, sequence_id, offset, room, gap), room is what the sequence leaves, gap the partition's sequences beyond its bound."""
    capacity = s.capacity

    def work(runs: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for run in runs:
            uid, length = run.column("uid").to_numpy(), run.column("length").to_numpy()
            bins, offset = best_fit_decreasing(length, capacity)
            n_bins = int(bins.max()) + 1
            if not run.column("sequence_id").null_count:
                _, before = np.unique(run.column("sequence_id").to_numpy(), return_inverse=True)
                if before.max() + 1 <= n_bins:
                    bins, offset, n_bins = before, run.column("offset").to_numpy(), int(before.max()) + 1
            room = capacity - np.bincount(bins, length, n_bins).astype(np.int64)
            name = np.zeros(n_bins, np.int64)
            first = offset == 0
            name[bins[first]] = uid[first]
            gap = n_bins - fewest_bins(length, capacity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (uid, length, name[bins], offset, room[bins], np.full(len(uid), gap))],
                ["uid", "length", "sequence_id", "offset", "room", "gap"])

    return map_runs(rows.select("part", "uid", "length", "sequence_id", "offset"), ["part"], ["uid"], work, PLACED)


def pack(docs: DataFrame, spec: str, settings: Settings | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document (doc_id, text).

    A null or empty text is the end id alone. A document longer than a sequence is cut so that all pieces but the first are full. Rows that
    share a doc_id, null ones too, are documents of their own. Sequences have no order; their ids are any numbers. No documents: no
    rows. Other columns are not read. The driver sees one count a round.
    """
    s = settings or Settings()
    cut = stored(pieces(docs, spec, s), "pieces")
    short = cut.where(F.col("length") < s.capacity)
    n = short.count()
    none = F.lit(None).cast("long")
    rows = short.select("uid", "length", none.alias("sequence_id"), none.alias("offset"), F.col("uid").alias("deal"))
    done = cut.where(F.col("length") == s.capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for turn in range(s.rounds + 1):
        n_parts = max(1, -(-n // s.part_rows))
        part = F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(n_parts))
        placed = stored(_packed(rows.withColumn("part", part), s), "packed")
        # Sequences that are full, or whose partition meets its bound, stay; the others are dealt anew as wholes.
        open_ = (F.col("gap") > 0) & (F.col("room") > 0)
        rows = placed.where(open_).select("uid", "length", "sequence_id", "offset", F.col("sequence_id").alias("deal"))
        n = rows.count() if turn < s.rounds else 0
        done = done.unionByName(placed.where(~open_ if n else F.lit(True)).select("uid", "sequence_id", "offset"))
        if not n:
            break
    return cut.join(done, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op13_certified_packing")
def op13_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of all documents."""
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    return pack(table(spark, sf_dir, "documents"), spec)
