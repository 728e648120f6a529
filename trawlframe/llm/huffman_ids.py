"""Token ids in files, as canonical length-limited Huffman code.

Format, a folder of three Parquet tables:

- ``code``: (id, n, bits, max_bits, checkpoint): count and code length of each id that occurs, and, alike in all rows, the settings that a
  reader needs; the canonical code follows from the lengths.
- ``shards``: (shard, start): ids before each shard. Shards are ranges of ascending doc_id.
- ``blocks``, one folder a shard: independent blocks of whole documents in ascending order. A block has its place in the shard,
  doc_ids and lengths of its documents, the code bits, and the bit offset of every 512th id.

Decoding starts at all checkpoints at once and takes one id a step from each, by one look-up in a table over the next
``max_bits`` bits. Spark writes and commits the tables, so a lost executor or a repeated task leaves no half-written
file, on any storage that Spark reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawlframe.llm.common import stored, table, tasks_of, text_slices
from trawlframe.llm.pair_index_bpe import tokenizer_path
from trawlframe.llm.token_ids import LibraryIds, built, ship
from trawlframe.plans.registry import query
from trawlframe.session import scratch_path


@dataclass(frozen=True)
class Settings:
    max_bits: int = 20
    block_ids: int = 65_536
    checkpoint: int = 512
    end_id: int = 0


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``max_bits`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64 if counts.sum() > 1 << 62 else np.int64)
    # At each depth: which items of the merged list are ids (the rest are packages of two items of the list below).
    is_id, items = [], weights
    marks = np.ones(n, dtype=bool)
    for _ in range(max_bits - 1):
        is_id.append(marks)
        pairs = len(items) // 2
        packages = items[:2 * pairs:2] + items[1:2 * pairs:2]
        joined = np.concatenate([weights, packages])
        sort = np.argsort(joined, kind="stable")
        items, marks = joined[sort], sort < n
    is_id.append(marks)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for marks in reversed(is_id):
        ids = int(marks[:take].sum())
        lengths[order[:ids]] += 1
        take = 2 * (take - ids)
    return lengths


class Code:
    """The canonical code: shorter codes first, equal lengths in order of id; first bit highest."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, max_bits: int):
        self.ids, self.lengths, self.max_bits = np.asarray(ids, np.int64), np.asarray(lengths, np.int64), max_bits

    @cached_property
    def _codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids in canonical order and their codes, aligned to ``max_bits``."""
        order = np.lexsort((self.ids, self.lengths))
        steps = np.left_shift(1, self.max_bits - self.lengths[order])
        return order, np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(order) else steps

    @cached_property
    def _by_id(self) -> tuple[np.ndarray, np.ndarray]:
        order, aligned = self._codes
        size = int(self.ids.max(initial=-1)) + 1
        codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        codes[self.ids[order]] = aligned.astype(np.uint64) << np.uint64(64 - self.max_bits)
        lengths[self.ids[order]] = self.lengths[order]
        return codes, lengths

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every value of the next ``max_bits`` bits: the id whose code they begin with, and its length."""
        order, aligned = self._codes
        repeat = np.left_shift(1, self.max_bits - self.lengths[order])
        ids, lengths = np.repeat(self.ids[order], repeat), np.repeat(self.lengths[order], repeat)
        spare = (1 << self.max_bits) - len(ids)  # only a code of a single id leaves values unused
        return np.append(ids, np.zeros(spare, np.int64)).astype(np.uint32), np.append(lengths, np.ones(spare, np.int64)).astype(np.int64)

    def encode(self, ids: np.ndarray, checkpoint: int) -> tuple[bytes, np.ndarray]:
        """Code bits of ids, and the bit offset of every ``checkpoint``-th."""
        codes, lengths = self._by_id
        bits = lengths[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        if not len(ids):
            return b"", starts
        code, word, shift = codes[ids], starts >> 6, (starts & 63).astype(np.uint64)
        out = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.bitwise_or.reduceat(code >> shift, first)
        over = np.flatnonzero((starts & 63) + bits > 64)  # at most one code runs into each word
        out[word[over] + 1] |= code[over] << (np.uint64(64) - shift[over])
        return out.astype(">u8").tobytes()[:int(ends[-1] + 7 >> 3)], starts[::checkpoint]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int], checkpoint: int) -> list[np.ndarray]:
        """Ids of several blocks, from all their checkpoints side by side."""
        ids, lengths = self._table
        room = checkpoint * self.max_bits // 8 + 8
        base = np.cumsum([0, *(len(p) for p in payloads)])[:-1]
        buffer = np.frombuffer(b"".join(payloads) + bytes(room), np.uint8).astype(np.uint32)
        window = (buffer[:-3] << 24) | (buffer[1:-2] << 16) | (buffer[2:-1] << 8) | buffer[3:]  # four bytes from each byte on
        at = np.concatenate([c.astype(np.int64) + 8 * int(b) for c, b in zip(checkpoints, base, strict=True)])
        steps = min(checkpoint, max(counts, default=0))
        out = np.zeros((len(at), steps), np.uint32)
        last = 8 * (len(window) - 1)
        drop = np.uint32(32 - self.max_bits)
        for k in range(steps):
            key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> drop
            out[:, k] = ids[key]
            at = np.minimum(at + lengths[key], last)  # beyond a block's end, where results are cut off
        flat, row = [], 0
        for c, n in zip(checkpoints, counts, strict=True):
            flat.append(out[row:row + len(c)].reshape(-1)[:n] if steps == checkpoint else out[row:row + len(c), :n].reshape(-1)[:n])
            row += len(c)
        return flat


def tokenised(docs: DataFrame, spec: str, s: Settings, width: int) -> DataFrame:
    """(shard, doc_id, local, n_tokens, ids): ids of every document with the end id, ``width`` bytes each, in ascending order of doc_id within
    and across shards; ``local`` counts the ids of the shard before the document. A shard's last row has local -1: its counts of ids, from 0 on."""
    shared = ship(docs.sparkSession, spec=spec, width=width)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange(tasks_of(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")))
    end, kind = int(s.end_id).to_bytes(width, "little"), f"<u{width}"
    names = ["shard", "doc_id", "local", "n_tokens", "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, library = TaskContext.get().partitionId(), 0, built(shared, LibraryIds)
        total = np.zeros(1 << 16 if width == 2 else 0, np.int64)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                ids = [x + end for x in library.encode(batch.column("text").to_pylist())]
                sizes = np.array([len(x) // width for x in ids], dtype=np.int64)
                ends = done + np.cumsum(sizes)
                own = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
                total = own + np.pad(total, (0, len(own) - len(total)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard, np.int32)), batch.column("doc_id"), pa.array(ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())], names)
                done = int(ends[-1])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([0]),
                                              pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return ordered.mapInArrow(work, "shard int, doc_id bigint, local bigint, n_tokens bigint, ids binary")


def counted(ids: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, from the last rows of the shards; the shuffle has a row for each id and shard at most."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("ids"):
                total = np.frombuffer(x.as_buffer(), "<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return ids.where("local = -1").select("ids").mapInArrow(work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, spec: str, path: str, settings: Settings | None = None) -> None:
    """Writes the ids of all documents (doc_id, text) to a new folder ``path`` in the format above.

    A null or empty text has only the end id. Rows with the same doc_id are documents of their own, in the order of a hash of their texts;
    null doc_ids come first. No documents: empty tables. Only the counts of the vocabulary's ids and one row a shard
    reach the driver or a single task.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    # Ids that fit take two bytes on their way into the blocks.
    width = 2 if LibraryIds(spec).library.get_vocab_size(with_added_tokens=True) <= 1 << 16 and s.end_id < 1 << 16 else 4
    staged = stored(tokenised(docs, spec, s, width), "ids")
    rows = sorted((r["id"], r["n"]) for r in counted(staged).collect())  # at most the size of the vocabulary
    ids, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    lengths = code_lengths(counts, s.max_bits)
    spark.createDataFrame([(int(a), int(b), int(c), s.max_bits, s.checkpoint) for a, b, c in zip(ids, counts, lengths, strict=True)], CODE) \
        .coalesce(1).sortWithinPartitions("id").write.parquet(f"{path}/code")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard
    staged = staged.where("local >= 0")
    (staged.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
     .write.parquet(f"{path}/shards"))
    shared = ship(spark, ids=ids, lengths=lengths, max_bits=s.max_bits)

    def block(shard: int, local: int, held: list) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(x[2] for x in held), dtype=f"<u{width}")
        payload, offsets = built(shared, Code).encode(flat, s.checkpoint)
        cells = [shard, local, len(held), len(flat), [x[0] for x in held], [x[1] for x in held], payload, offsets.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, KINDS, strict=True)], NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, (0, 0)
        for batch in batches:
            for shard, doc_id, local, n, x in zip(*(batch.column(c) for c in ("shard", "doc_id", "local", "n_tokens", "ids")), strict=True):
                key, n = (shard.as_py(), local.as_py()), n.as_py()
                if held and (size + n > s.block_ids or key != (first[0], first[1] + size)):
                    yield block(*first, held)
                    held, size = [], 0
                if not held:
                    first = key
                held.append((doc_id.as_py(), n, x.as_py()))
                size += n
        if held:
            yield block(*first, held)

    blocks = staged.mapInArrow(work, ", ".join(f"{a} {b}" for a, b in zip(NAMES, SPARK_KINDS, strict=True)))
    blocks.sortWithinPartitions("shard", "local").write.partitionBy("shard").option("compression", "uncompressed").parquet(f"{path}/blocks")


CODE = "id bigint, n bigint, bits int, max_bits int, checkpoint int"
NAMES = ["shard", "local", "n_docs", "n_tokens", "doc_ids", "lengths", "bits", "checkpoints"]
SPARK_KINDS = ["int", "bigint", "int", "bigint", "array<bigint>", "array<bigint>", "binary", "array<bigint>"]
KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files: ``start`` ids come before it, ``ids`` are little-endian
    unsigned 32-bit integers. Blocks are decoded on their own, so any task may read any of them. What the writer was set to is read
    from the files."""
    rows = sorted((r["id"], r["bits"], r["max_bits"], r["checkpoint"]) for r in spark.read.schema(CODE).parquet(f"{path}/code").collect())
    max_bits, checkpoint = rows[0][2:] if rows else (1, 1)
    shared = ship(spark, ids=np.array([r[0] for r in rows], np.int64), lengths=np.array([r[1] for r in rows], np.int64), max_bits=max_bits)
    shards = spark.read.schema("shard int, start bigint").parquet(f"{path}/shards")
    order = [i for i, n in enumerate(NAMES) if n != "shard"]
    blocks = spark.read.schema(", ".join([*(f"{NAMES[i]} {SPARK_KINDS[i]}" for i in order), "shard int"])).parquet(f"{path}/blocks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                batch = whole.slice(at, 32)
                counts = batch.column("n_tokens").to_pylist()
                flat = built(shared, Code).decode(batch.column("bits").to_pylist(), [np.array(c, np.int64) for c in batch.column("checkpoints").to_pylist()],
                                           counts, checkpoint)
                for k, found in enumerate(flat):
                    sizes = np.array(batch.column("lengths")[k].as_py(), np.int64)
                    ends = np.cumsum(sizes)
                    raw = found.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(batch.column("doc_ids")[k].as_py(), pa.int64()), pa.array(batch.column("start")[k].as_py() + ends - sizes), pa.array(sizes),
                         pa.array([raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(shards, "shard").select((F.col("start") + F.col("local")).alias("start"), "n_tokens", "doc_ids", "lengths", "bits", "checkpoints")
    return placed.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


@query("op2_huffman_ids")
def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads them back."""
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = scratch_path(spark, "huffman")
    write_ids(table(spark, sf_dir, "documents"), spec, path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
