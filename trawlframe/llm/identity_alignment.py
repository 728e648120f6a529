"""Alignment of two tokenizers' tokens on the bytes of the corpus, with a fast path for tokens that both have.

Places where tokens of both end cut a text into groups; the A token and the B token that end there are linked. A table
made beforehand maps each A id to the B id with the same bytes. Groups of one A token and its own B token are counted
in vectors as long as the vocabulary; only what other groups link enters the shuffle of pairs, a row for each pair and chunk of texts.
The counts come back by chunk, to the documents that wait there with their links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import segments_of, stored, table, tasks_of, text_slices
from trawlframe.llm.pair_index_bpe import tokenizer_path
from trawlframe.llm.token_ids import BYTE_LETTERS, LibraryIds, built, ship
from trawlframe.plans.registry import query


@dataclass(frozen=True)
class Settings:
    """Texts of a chunk have about ``chunk_bytes`` bytes; a longer text is a chunk of its own."""

    chunk_bytes: int = 32 << 20


class Pieces:
    """Ids and bytes of a ``sentencepiece`` model given as its file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.library.encode(texts, num_threads=1)]

    @cached_property
    def tokens(self) -> list[bytes]:
        p = self.library
        return [bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
                for i in range(p.get_piece_size())]


class Aligner:
    """Both tokenizers, and the table from A ids to the B ids with the same bytes (-1: none; the smallest of several)."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = LibraryIds(spec, plain_special=True), Pieces(model)
        code = {c: i for i, c in enumerate(BYTE_LETTERS)}
        vocab = self.a.library.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.a.library.get_added_tokens_decoder().values()}
        self.tokens_a = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.tokens_a[i] = token.encode() if token in special else bytes(map(code.__getitem__, token))
        self.tokens_b = self.b.tokens
        self.length_a, self.length_b = (np.array(list(map(len, t)), np.int64) for t in (self.tokens_a, self.tokens_b))
        own = {}
        for i, token in enumerate(self.tokens_b):
            if token and not self.b.library.is_control(i) and not self.b.library.is_unknown(i):
                own.setdefault(token, i)
        self.same = np.array([own.get(t, -1) if t else -1 for t in self.tokens_a], np.int64)
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        # A token's text in a listing of groups: in its row, before the bar, at the group's end.
        self.text_a = [text(len(self.tokens_a), ","), text(len(self.tokens_a), "|")]
        self.text_b = [text(len(self.tokens_b), ","), text(len(self.tokens_b), ";")]

    def align(self, texts: list[str]) -> tuple[dict[str, list], np.ndarray, list[np.ndarray]]:
        """Columns of the texts; and, text by text, how many links are of equal bytes, with all those links' A ids, and the codes of the others."""
        n = len(texts)
        spaced = [f" {t}" for t in texts]
        given = np.array([bool(t) for t in texts], dtype=bool)
        ids_a = [np.frombuffer(x, "<u4").astype(np.int64) for x in self.a.encode(spaced)]
        ids_b = self.b.encode(texts)
        for k in np.flatnonzero(given).tolist():
            raw = spaced[k].encode()
            given[k] = (b"".join(map(self.tokens_a.__getitem__, ids_a[k].tolist())) == raw
                        and b"".join(map(self.tokens_b.__getitem__, ids_b[k].tolist())) == raw)
        ids_a = [x if g else x[:0] for x, g in zip(ids_a, given, strict=True)]
        ids_b = [x if g else x[:0] for x, g in zip(ids_b, given, strict=True)]
        n_a, n_b = (np.array(list(map(len, ids)), np.int64) for ids in (ids_a, ids_b))
        a, b = np.concatenate([np.zeros(0, np.int64), *ids_a]), np.concatenate([np.zeros(0, np.int64), *ids_b])
        # One line of bytes for all texts: both tokenizers end together at the end of each text.
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        total = int(end_a[-1]) if len(a) else 0
        ends = np.zeros(total + 1, dtype=bool)
        ends[end_a] = True
        last_b = np.flatnonzero(ends[end_b])  # B tokens that end with an A token
        ends[:] = False
        ends[end_b] = True
        last_a = np.flatnonzero(ends[end_a])
        wide_a, wide_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        text_of_a = np.repeat(np.arange(n), n_a)
        owner = text_of_a[last_a]
        n_groups = np.bincount(owner, minlength=n)
        link_a, link_b = a[last_a], b[last_b]
        regular = (wide_a == 1) & (wide_b == 1) & (self.same[link_a] == link_b)
        # The listing: tokens in order of group, A before B.
        group_a, group_b = np.repeat(np.arange(len(last_a)), wide_a), np.repeat(np.arange(len(last_b)), wide_b)
        starts_a, starts_b = last_a + 1 - wide_a, last_b + 1 - wide_b
        place = np.empty(len(a) + len(b), dtype=object)
        at_a, at_b = np.arange(len(a)) + starts_b[group_a], np.arange(len(b)) + (starts_a + wide_a)[group_b]
        place[at_a], place[at_b] = self.text_a[0][a], self.text_b[0][b]
        place[at_a[last_a]], place[at_b[last_b]] = self.text_a[1][link_a], self.text_b[1][link_b]
        cuts = np.cumsum(n_a + n_b).tolist()
        digests = ["" if not x else hashlib.sha256("".join(place[c - x:c].tolist())[:-1].encode()).hexdigest()
                   for c, x in zip(cuts, (n_a + n_b).tolist(), strict=True)]
        columns = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups, "groups_sha256": digests}
        code = link_a * len(self.tokens_b) + link_b
        split = lambda values, mine: np.split(values[mine], np.cumsum(np.bincount(owner[mine], minlength=n))[:-1])
        return columns, split(link_a, regular), split(code, ~regular)


DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
STAGED = f"kind int, chunk bigint, {DOC}, same binary, others binary, a int, b int, n bigint"
ARROW = {"kind": pa.int32(), "chunk": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
         "groups_sha256": pa.string(), "same": pa.binary(), "others": pa.binary(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64()}
DOCUMENT, SAME, OTHER = 0, 1, 2


def _batch(n: int, kind: int, given: dict) -> pa.RecordBatch:
    given = {"kind": np.full(n, kind), **given}
    return pa.RecordBatch.from_arrays([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(n, t)
                                       for c, t in ARROW.items()], list(ARROW))


def _staged(docs: DataFrame, spec: str, model: bytes, s: Settings) -> DataFrame:
    """Rows of three kinds: documents with their links, a task's counts of links of equal bytes, a chunk's counts of the others."""
    shared = ship(docs.sparkSession, spec=spec, model=model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = built(shared, Aligner)
        wide = len(own.tokens_b)
        small = np.dtype("<u4" if len(own.tokens_a) * wide < 1 << 32 else "<u8")
        chunk, size = TaskContext.get().partitionId() << 32, 0
        same = np.zeros(len(own.tokens_a), np.int64)
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def others() -> pa.RecordBatch:
            return _batch(len(codes), OTHER, {"chunk": np.full(len(codes), chunk), "a": codes // wide, "b": codes % wide, "n": counts})

        for whole in batches:
            for batch in text_slices(whole, "text", 2 << 20):
                texts = batch.column("text").to_pylist()
                bytes_here = sum(map(len, texts))
                if size and size + bytes_here > s.chunk_bytes:
                    yield others()
                    chunk, size, codes, counts = chunk + 1, 0, codes[:0], counts[:0]
                size += bytes_here
                columns, equal, codes_of = own.align(texts)
                same += np.bincount(np.concatenate(equal), minlength=len(same))
                new, back = np.unique(np.concatenate([codes, *codes_of]), return_inverse=True)
                weights = np.concatenate([counts, np.ones(len(back) - len(counts), np.int64)])
                codes, counts = new, np.bincount(back, weights, len(new)).astype(np.int64)
                yield _batch(len(texts), DOCUMENT, {
                    "chunk": np.full(len(texts), chunk), "doc_id": batch.column("doc_id"), **columns,
                    "same": [x.astype("<u4").tobytes() for x in equal], "others": [x.astype(small).tobytes() for x in codes_of]})
        if size or len(codes):
            yield others()
        seen = np.flatnonzero(same)
        yield _batch(len(seen), SAME, {"a": seen, "b": own.same[seen], "n": same[seen]})

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, STAGED))


def align(docs: DataFrame, spec: str, model: bytes, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs`` (doc_id, text).

    ``spec`` is the JSON text of a byte-level vocabulary (A, which encodes space + text), ``model`` a piece model's file (B, which adds the space
    itself). Counts of a pair are over all links of ``docs``; n_best are a document's links whose count is the highest of their B id, count_sum
    the sum of its links' counts. A text that is null, empty, or not spelled by either's tokens has no tokens: zeros and an empty digest. Repeated rows and
    null doc_ids are documents of their own; an empty table gives an empty one. Other columns are not read. The driver sees
    two vectors no longer than the vocabularies.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    own = Aligner(spec, model)
    n_a, n_b = len(own.tokens_a), len(own.tokens_b)
    small = np.dtype("<u4" if n_a * n_b < 1 << 32 else "<u8")
    staged = stored(_staged(docs, spec, model, s), "alignment")
    equal = staged.where(F.col("kind") == SAME).groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = stored(staged.where(F.col("kind") == OTHER).groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    # At most one row for each id of the vocabularies.
    same, best = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    for r in equal.collect():
        same[r["a"]] = r["n"]
        best[r["b"]] = max(best[r["b"]], r["n"])
    for r in pairs.groupBy("b").agg(F.max("n").alias("n")).collect():
        best[r["b"]] = max(best[r["b"]], r["n"])
    is_best = (same > 0) & (same == best[np.maximum(own.same, 0)])
    shared = ship(spark, same=same, is_best=is_best, best=best, n_b=n_b)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents before the shuffle: the links of equal bytes become two numbers."""
        counts, good = shared.value["same"], shared.value["is_best"]
        for batch in batches:
            links = [np.frombuffer(x or b"", "<u4") for x in batch.column("same").to_pylist()]
            sums = [int(counts[x].sum()) for x in links]
            hits = [int(good[x].sum()) for x in links]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("others"), pa.array(hits, pa.int64()), pa.array(sums, pa.int64())],
                                             [*names, "others", "n_best", "count_sum"])

    names = ["chunk", *(c.split()[0] for c in DOC.split(", "))]
    documents = staged.where(F.col("kind") == DOCUMENT).select(*names, "others", "same").mapInArrow(
        counted, f"chunk bigint, {DOC}, others binary, n_best bigint, count_sum bigint").withColumn("turn", F.lit(1))
    back = (staged.where(F.col("kind") == OTHER).select("chunk", "a", "b").join(pairs, ["a", "b"])
            .select("chunk", (F.col("a").cast("long") * n_b + F.col("b")).alias("code"), F.col("n").alias("count"), F.lit(0).alias("turn")))
    met = back.unionByName(documents, allowMissingColumns=True).repartition(tasks_of(spark), "chunk").sortWithinPartitions("chunk", "turn", "code")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest, wide = shared.value["best"], shared.value["n_b"]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, codes, counts, good = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for (chunk, turn), batch in segments_of(batches, ["chunk", "turn"]):
            if chunk != at:
                at, held, codes = chunk, [], None
            if not turn:
                held.append((batch.column("code").to_numpy(), batch.column("count").to_numpy()))
                continue
            if codes is None:  # the chunk's pairs came first, in order
                codes, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), ())))
                good = counts == highest[codes % wide]
                held = []
            sums, hits = [], []
            for x in batch.column("others").to_pylist():
                links = np.searchsorted(codes, np.frombuffer(x or b"", small).astype(np.int64))
                sums.append(int(counts[links].sum()))
                hits.append(int(good[links].sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[1:]), pa.array(np.array(hits, np.int64) + batch.column("n_best").to_numpy()),
                 pa.array(np.array(sums, np.int64) + batch.column("count_sum").to_numpy())], [*names[1:], "n_best", "count_sum"])

    return met.mapInArrow(finish, f"{DOC}, n_best bigint, count_sum bigint").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op11_identity_alignment")
def op11_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents between a byte-level and a piece vocabulary."""
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return align(table(spark, sf_dir, "documents"), spec, model)
