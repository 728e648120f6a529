"""MinHash near-dedup as a chosen-path set similarity join.

Every text becomes its set of word shingles; texts with the same set become one
representative. In each of a few independent trees a node's texts go down to the children that their selected
minwise tokens name (two per level), so similar texts meet again on some path.
Small nodes, and nodes that no longer get smaller, are compared exhaustively on
short signatures; the pairs found there only decide which texts are verified together. Links are
confirmed on full sets, and components of links are the groups.

Recall at similarity s: a pair that shares a node shares a child with probability
c = 1 - (1 - s)² and survives all further levels with probability p = 1 - (1 - s p)²; at s = 0.8 that is
0.9375 for any depth. Two trees give 1 - 0.0625² = 0.996, and pairs of a
larger group have many ways to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import deal_units, map_runs, merge_edges, smallest_of, stored, table, text_slices
from trawlframe.llm.components import components
from trawlframe.plans.registry import query


@dataclass(frozen=True)
class Settings:
    """``percent`` of the union that the intersection must reach; ``words`` per shingle."""

    words: int = 5
    percent: int = 80
    trees: int = 2
    levels: int = 4
    branch: int = 2
    small_node: int = 128
    signature: int = 64
    block_rows: int = 2_048
    block_shingles: int = 4_000_000

    def agreement(self) -> int:
        """Signature places that must agree: four standard deviations below what the threshold itself gives."""
        s = self.percent / 100
        return max(1, int(self.signature * s - 4 * (self.signature * s * (1 - s)) ** 0.5))


class WordHashes(dict):
    """64-bit hash of each word; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


def shingle_set(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    found = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z are lowered, only 9-13 and 32 separate
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    size = min(words, n)
    mixed = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ each[k:n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype="<i8").tolist()
    return a, b


def _minima(shingles: np.ndarray, salts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minwise value of a set for each hash function, in pieces of bounded size."""
    least = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4_096):
        least = np.minimum(least, ((shingles[at:at + 4_096, None] ^ salts) * factors).min(axis=0))
    return least


def digest(text: str) -> Column:
    """What tells the texts of rows with one doc_id apart."""
    return F.md5(F.col(text).cast("binary"))


def describe(docs: DataFrame, s: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, set_a, set_b, picks, signature): the text's digest, a fingerprint of its set, its
    selected tokens for every tree, level and branch, and a signature for quick comparison."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(11)
        n_picks = s.trees * s.levels * s.branch
        salts = draw.integers(0, 1 << 63, n_picks + s.signature, dtype=np.uint64)
        factors = draw.integers(0, 1 << 63, n_picks + s.signature, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        hashes = WordHashes()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sizes, prints, picks, signatures = [], [], [], []
                for t in batch.column("text").to_pylist():
                    shingles = shingle_set(t or "", s.words, hashes)
                    least = _minima(shingles, salts, factors)
                    sizes.append(len(shingles))
                    prints.append(fingerprint(shingles))
                    picks.append(least[:n_picks].astype(np.int64))
                    signatures.append((least[n_picks:] & np.uint64(0xFFFF)).astype("<u2").tobytes())
                halves = np.array(prints, dtype=np.int64).reshape(-1, 2)
                offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * n_picks)
                flat = pa.array(np.concatenate(picks) if picks else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                     pa.ListArray.from_arrays(offsets, flat), pa.array(signatures, pa.binary())],
                    ["doc_id", "digest", "n_shingles", "set_a", "set_b", "picks", "signature"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), digest(text).alias("digest")).mapInArrow(
        work, "doc_id bigint, digest string, n_shingles bigint, set_a bigint, set_b bigint, picks array<bigint>, signature binary")


def _children(rows: DataFrame, level: int, s: Settings) -> DataFrame:
    """(rep, tree, node, above): the nodes each row goes down to; ``rows`` has rep, tree, node, n (size of that node) and picks."""
    at = (F.col("tree") * s.levels + level) * s.branch
    kids = F.array(*(F.xxhash64("node", F.lit(level), F.lit(j), F.element_at("picks", (at + j + 1).cast("int"))) for j in range(s.branch)))
    return rows.select("rep", "tree", F.explode(kids).alias("node"), F.col("n").alias("above"))


def leaves(reps: DataFrame, s: Settings) -> DataFrame:
    """(node, n, rep): the leaves of all trees with at least two texts."""
    picks = reps.select("rep", "picks")
    rows = _children(picks.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(s.trees - 1))))
                     .withColumns({"node": F.col("tree").cast("long"), "n": F.lit(None).cast("long")}), 0, s)
    done = None
    for level in range(1, s.levels + 1):
        rows = stored(rows, "path")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = rows.join(sizes, "node")
        # A node that keeps half of the one above is dense: going on would only copy its rows.
        ends = (F.col("n") <= s.small_node) | F.coalesce(F.col("n") * 2 >= F.col("above"), F.lit(False)) | F.lit(level == s.levels)
        here = sized.where(ends).select("node", "n", "rep")
        done = here if done is None else done.unionByName(here)
        if level == s.levels:
            break
        further = sized.where(~ends).select("rep", "tree", "node", "n")
        if not further.take(1):
            break
        rows = _children(further.join(picks, "rep"), level, s)
    return done


def _linked(n: int, alike) -> np.ndarray:
    """Labels of the components among rows 0..n-1, all pairs decided.

    ``alike(i)`` says which rows are like row i. Rows like a common leader are one component
    whatever they are to each other, so only the rest is compared with all rows.
    """
    labels = np.arange(n)
    best = np.zeros(n, dtype=bool)
    for leader in range(0, n, max(1, n // 4)):
        like = alike(leader)
        like[leader] = True
        if like.sum() > best.sum():
            best = like
        members = np.flatnonzero(like)
        labels = merge_edges(labels, np.full(len(members), leader), members)
    for i in np.flatnonzero(~best).tolist():
        members = np.flatnonzero(alike(i))
        labels = merge_edges(labels, np.full(len(members), i), members)
    return labels


def _forest(reps: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    """One edge from each row to the smallest node of its component."""
    roots = smallest_of(reps, labels)
    keep = roots != reps
    return pa.RecordBatch.from_arrays([pa.array(reps[keep]), pa.array(roots[keep])], ["a", "b"])


def _compare_signatures(runs: Iterator[pa.Table], s: Settings) -> Iterator[pa.RecordBatch]:
    need = s.agreement()
    for run in runs:
        reps = run.column("rep").to_numpy()
        n = len(reps)
        if n < 2:
            continue
        marks = np.frombuffer(b"".join(run.column("signature").to_pylist()), dtype="<u2").reshape(n, s.signature)
        if n <= s.small_node:
            agree = np.zeros((n, n), np.int16)
            for k in range(s.signature):
                agree += marks[:, k, None] == marks[None, :, k]
            a, b = np.nonzero(np.triu(agree >= need, 1))
            labels = merge_edges(np.arange(n), a, b)
        else:
            labels = _linked(n, lambda i, m=marks: (m == m[i]).sum(axis=1) >= need)
        edges = _forest(reps, labels)
        if edges.num_rows:
            yield edges


def _verify(runs: Iterator[pa.Table], s: Settings) -> Iterator[pa.RecordBatch]:
    """Links on full sets: 100 * intersection >= percent * union."""
    hashes = WordHashes()
    for run in runs:
        # Rows that share a doc_id come with each other's texts too: the fingerprint tells which text is meant.
        sets, owners = [], []
        for rep, set_a, set_b, text in zip(*(run.column(c) for c in ("rep", "set_a", "set_b", "text")), strict=True):
            if owners and owners[-1] == rep.as_py():  # sorted by rep: the same text again
                continue
            shingles = shingle_set(text.as_py() or "", s.words, hashes)
            if fingerprint(shingles) == (set_a.as_py(), set_b.as_py()):
                sets.append(shingles)
                owners.append(rep.as_py())
        if len(sets) < 2:
            continue
        reps = np.array(owners, dtype=np.int64)
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        mark = np.zeros(int(numbers.max()) + 1, dtype=bool)

        def alike(i: int, numbers=numbers, starts=starts, ends=ends, sizes=sizes, mark=mark) -> np.ndarray:
            own = numbers[starts[i]:ends[i]]
            mark[own] = True
            common = np.add.reduceat(mark[numbers], starts, dtype=np.int64)
            mark[own] = False
            return 100 * common >= s.percent * (sizes + sizes[i] - common)

        edges = _forest(reps, _linked(len(reps), alike))
        if edges.num_rows:
            yield edges


def _grouped(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, digest, n_shingles, component, smallest) for every row of ``docs``: component is a number of the row's group,
    smallest the least doc_id in it; both are null where the row links with nothing because of its empty set or null doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(describe(docs, s), "sets")
    # A set is a node of its own, numbered as the table is written, also where other sets have the same least doc_id.
    reps = stored(sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b")
                  .agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("picks").alias("picks"),
                       F.first("signature").alias("signature")).withColumn("rep", F.monotonically_increasing_id()), "reps")
    meet = deal_units(leaves(reps, s), "rep", F.ceil(F.col("n") / s.block_rows))
    found = map_runs(meet.select("node", "u", "v", "rep").join(reps.select("rep", "signature"), "rep"), ["node", "u", "v"], [],
                     lambda runs: _compare_signatures(runs, s), "a bigint, b bigint")
    together = components(found)
    members = reps.select("rep", "least", "set_a", "set_b", "n_shingles").join(together.withColumnRenamed("node", "rep"), "rep")
    sizes = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / s.block_rows, F.sum("n_shingles") / s.block_shingles)).alias("need"))
    units = deal_units(members.join(sizes, "component"), "rep", F.col("need"))
    texts = units.select("component", "u", "v", "rep", "least", "set_a", "set_b").join(docs.withColumnRenamed("doc_id", "least"), "least")
    checked = map_runs(texts, ["component", "u", "v"], ["rep"], lambda runs: _verify(runs, s), "a bigint, b bigint")
    groups = components(checked).withColumnRenamed("node", "rep")
    named = stored(reps.select("set_a", "set_b", "rep", "least").join(groups, "rep", "left")
                   .select("set_a", "set_b", F.coalesce("component", "rep").alias("component"), "least"), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.drop("least").join(smallest, "component")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (sets.select("doc_id", "digest", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
            .select("doc_id", "digest", "n_shingles", F.when(linked, F.col("component")).alias("component"),
                    F.when(linked, F.col("smallest")).alias("smallest")))


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, kept whether it is the row's own. A null or
    empty text, or one of white space only, has an empty set and links with nothing. A text with
    fewer words than a shingle has its whole sequence as one. A null doc_id links with nothing and
    is kept. Rows that share a doc_id are told apart by their sets. Other columns are not read.
    """
    return (_grouped(docs, settings or Settings())
            .select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` (doc_id, text and other columns) with one row of each group: of the rows with its smallest doc_id the
    one with the smallest digest, of equal texts the row with the smallest hash. Rows that link with nothing all stay."""
    keys = stored(_grouped(docs, settings or Settings()).where("component IS NOT NULL").groupBy("doc_id", "digest")
                  .agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("copies")), "group-keys")
    chosen = stored(keys.groupBy("component").agg(F.min(F.struct("doc_id", "digest", "copies")).alias("k")).select("k.*"), "chosen")
    others = keys.join(chosen, ["doc_id", "digest"], "left_anti").select("doc_id", "digest")
    repeated = chosen.where("copies > 1").select("doc_id", "digest")
    again = bool(repeated.take(1))
    # The caller's row travels as one value: its columns may have any names and types, maps too.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"))
    out = rows.join(others.unionByName(repeated) if again else others, ["doc_id", "digest"], "left_anti").select("row")
    if again:
        first = (rows.join(repeated, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest")
                 .agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")))
        out = out.unionByName(first.select("row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


@query("op6_chosen_path")
def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=2))
