"""Hard negatives by an inverted multi-index.

Vectors are cut in halves and each half is given the nearest codeword of its codebook; the two codewords are the vector's cell. No vector of
a cell scores more with an anchor than the sum of two bounds: for each half, the codeword's product and the anchor's
length times the codeword's radius, the largest distance of any vector from it. A multi-sequence heap visits cells by descending
sum. An anchor's positives are certain once the next cell's bound is below its last positive; the windows of negatives that the positives
open are certain once the bound is below each window's last negative, or its lower edge.

The work is dealt by cells: neighbouring small cells make a unit, a large cell is several units. An anchor goes to the units
of its best cells first, which gives a floor for its positives, and then only to units with a cell that can reach the floor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawlframe.llm.common import fit_vector, integer_scores, norms_of, segments_of, stored, table, tasks_of, vectors_of, whole_parts
from trawlframe.llm.token_ids import built, ship
from trawlframe.plans.registry import query


@dataclass(frozen=True)
class Settings:
    """``k`` positives an anchor and negatives a positive; negatives score at least ``least`` hundredths of the positive and not more than it.

    Codebooks are fitted on the ``sample`` vectors with the smallest hashed ids; they have the fourth root of the number of vectors as
    codewords, ``codewords`` at most, which bounds the table of cells.
    """

    k: int = 5
    least: int = 80
    sample: int = 8_192
    codewords: int = 128
    unit_rows: int = 8_192
    seed: int = 3


#: The cell of vectors too long for sums in double precision: every anchor visits it, sums are Python's.
WIDE = -1
WIDE_NORM = float(1 << 26)


def codebook(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Codewords of vectors: Lloyd's rounds from a draw of the rows."""
    draw = np.random.default_rng(seed)
    words = x[draw.permutation(len(x))[:n]].copy()
    for _ in range(8):
        near = nearest(x, words)
        sums, counts = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, x)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2 * (x @ words.T), axis=1)


def heap_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs by descending first[i] + second[j]; only the border of what was visited is held."""
    rows, columns = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    a, b = first[rows].tolist(), second[columns].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)] if a and b else []
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, rows[i], columns[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class Books:
    """Codebooks, radii and units by the vectors' length. A length the sample did not have has one codeword, zero."""

    def __init__(self, words: dict, cells: dict | None = None):
        self.words, self.cells = words, cells or {}

    def halves(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length in self.words:
            return self.words[length]
        return np.zeros((1, length // 2)), np.zeros((1, length - length // 2))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance, distance) of vectors of one length, a distance for each half."""
        wide = norms_of(v) > WIDE_NORM
        near, far = [], []
        cut = v.shape[1] // 2
        for words, x in zip(self.halves(v.shape[1]), (v[:, :cut], v[:, cut:]), strict=True):
            x = np.where(wide[:, None], 0.0, x)
            at = nearest(x, words)
            near.append(at)
            far.append(np.sqrt(((x - words[at]) ** 2).sum(axis=1)))
        cell = near[0] * len(self.halves(v.shape[1])[1]) + near[1]
        return np.where(wide, WIDE, cell), far[0], far[1]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most that a vector of each codeword's can add to a product with ``q``, for each half; a little more, for rounding."""
        length = len(q)
        (_, _, _, radii), cut = self.cells[length], length // 2
        if norms_of(q) > WIDE_NORM:
            return tuple(np.full(len(r), np.inf) for r in radii)
        out = []
        for words, radius, x in zip(self.halves(length), radii, (q[:cut], q[cut:]), strict=True):
            reach = norms_of(x) * radius
            middle = words @ x
            out.append(middle + reach + 1e-9 * (np.abs(middle) + reach) + 1e-6)
        return tuple(out)

    def visits(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, first unit, number of units) of the cells that have vectors, by descending bound, wide ones first."""
        first, count, wide, _ = self.cells[len(q)]
        if wide is not None:
            yield (np.inf, *wide)
        width = len(self.halves(len(q))[1])
        for bound, i, j in heap_order(*self.bounds(q)):
            cell = i * width + j
            if count[cell]:
                yield bound, int(first[cell]), int(count[cell])


class Unit:
    """The vectors of a unit, by cell and label."""

    def __init__(self, books: Books, cell: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        order = np.lexsort((labels, cell))
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.norms, self.books = norms_of(self.values), books
        cell = cell[order]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.slices = dict(zip(cell[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True), strict=True))
        self.width = len(books.halves(values.shape[1])[1])
        normal = np.array([c for c in self.slices if c != WIDE], np.int64)
        self.first, self.second = np.unique(normal // self.width), np.unique(normal % self.width)

    def visits(self, q: np.ndarray) -> Iterator[tuple[float, slice]]:
        if WIDE in self.slices:
            yield np.inf, slice(*self.slices[WIDE])
        first, second = self.books.bounds(q)
        for bound, i, j in heap_order(first[self.first], second[self.second]):
            rows = self.slices.get(int(self.first[i]) * self.width + int(self.second[j]))
            if rows:
                yield bound, slice(*rows)

    def scores(self, rows: slice, q: np.ndarray, q_norm: float) -> np.ndarray:
        return integer_scores(self.values[rows], self.norms[rows], q, q_norm)

    def positives(self, own: int, label: int, q: np.ndarray, floor: float, k: int) -> list[tuple[int, int]]:
        """The best k (-score, id) of the label, none below the floor."""
        q_norm, best = norms_of(q), []
        for bound, rows in self.visits(q):
            if bound < floor:
                break
            a, b = np.searchsorted(self.labels[rows], [label, label + 1]) + rows.start
            if a == b:
                continue
            scores = self.scores(slice(a, b), q, q_norm)
            good = np.flatnonzero((scores >= floor) & (self.ids[a:b] != own))
            if len(good):
                best = sorted(best + list(zip((-scores[good]).tolist(), self.ids[a:b][good].tolist(), strict=True)))[:k]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
        return best

    def negatives(self, own: int, label: int, q: np.ndarray, windows: dict[int, int], k: int) -> dict[int, list[tuple[int, int]]]:
        """For each window (upper edge: lower edge) the best k (-score, id) of other labels in it."""
        q_norm, best, floors = norms_of(q), {p: [] for p in windows}, dict(windows)
        for bound, rows in self.visits(q):
            least = min(floors.values())
            if bound < least:
                break
            scores = self.scores(rows, q, q_norm)
            good = np.flatnonzero((scores >= least) & (self.labels[rows] != label) & (self.ids[rows] != own))
            if not len(good):
                continue
            scores, ids = scores[good], self.ids[rows][good]
            for p, floor in list(floors.items()):
                inside = (scores >= floor) & (scores <= p)
                if inside.any():
                    best[p] = sorted(best[p] + list(zip((-scores[inside]).tolist(), ids[inside].tolist(), strict=True)))[:k]
                    if len(best[p]) == k:
                        floors[p] = max(floor, -best[p][-1][0])
        return best


def _indexed(rows: DataFrame, s: Settings) -> tuple[DataFrame, Books]:
    """``rows`` (vec_id, label, x) with length and unit, stored; and the books with radii and units of all cells."""
    spark = rows.sparkSession
    n = rows.count()
    drawn = rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id", F.lit(s.seed)), "vec_id").limit(s.sample).collect()
    words = {}
    for length in sorted({len(r["x"]) for r in drawn}):
        v = whole_parts(np.array([r["x"] for r in drawn if len(r["x"]) == length], float))
        v = v[norms_of(v) <= WIDE_NORM]
        size = max(1, min(s.codewords, round(n ** 0.25), len(v) // 4))
        if len(v):
            words[length] = (codebook(v[:, :length // 2], size, s.seed), codebook(v[:, length // 2:], size, s.seed + 1))
    shared = ship(spark, words=words)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = built(shared, Books)
        for (length,), batch in segments_of(batches, ["length"]):
            cell, a, b = books.place(whole_parts(vectors_of(batch.column("x"), int(length))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(a), pa.array(b)], [*batch.schema.names, "cell", "r1", "r2"])

    kind = rows.schema["x"].dataType.simpleString()
    placed = stored(rows.select("vec_id", "label", "x", F.size("x").alias("length")).mapInArrow(
        place, f"vec_id bigint, label bigint, x {kind}, length int, cell bigint, r1 double, r2 double"), "cells")
    # At most the square of the codewords for each length.
    found = placed.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()
    books, cells = Books(words), {}
    table_rows = []
    for length in sorted({r["length"] for r in found}):
        first_words, second_words = books.halves(length)
        width = len(second_words)
        start, count = np.zeros(len(first_words) * width, np.int64), np.zeros(len(first_words) * width, np.int64)
        radii, wide = (np.zeros(len(first_words)), np.zeros(width)), None
        unit, filled = -1, s.unit_rows
        for r in sorted((r for r in found if r["length"] == length), key=lambda r: r["cell"]):
            need = -(-r["n"] // s.unit_rows)
            if need > 1 or filled + r["n"] > s.unit_rows:
                unit, filled = unit + 1, 0
            here = (unit, need)
            unit, filled = unit + need - 1, s.unit_rows if need > 1 else filled + r["n"]
            table_rows.append((length, r["cell"], *here))
            if r["cell"] == WIDE:
                wide, filled = here, s.unit_rows
                continue
            start[r["cell"]], count[r["cell"]] = here
            i, j = divmod(r["cell"], width)
            radii[0][i], radii[1][j] = max(radii[0][i], r["r1"]), max(radii[1][j], r["r2"])
        cells[length] = (start, count, wide, radii)
    units = spark.createDataFrame(table_rows, "length int, cell bigint, start bigint, need bigint")
    dealt = (placed.join(F.broadcast(units), ["length", "cell"])
             .select("vec_id", "label", "x", "length", "cell", (F.col("start") + F.pmod(F.xxhash64("vec_id", "x"), F.col("need"))).alias("unit")))
    return dealt, Books(words, cells)


ASKED = "length int, unit bigint, vec_id bigint, label bigint, copy bigint, x array<double>, floor double, windows array<bigint>"


def _routed(anchors: DataFrame, shared, first: bool | None, s: Settings) -> DataFrame:
    """Anchors (vec_id, label, copy, x, floor, windows) copied to their units. ``first``: only to those of the best cells that hold k vectors or
    more; False: to all others that reach the floor; None: to all that do."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = built(shared, Books)
        for (length,), batch in segments_of(batches, ["length"]):
            places, units = [], []
            for at, (x, floor) in enumerate(zip(whole_parts(vectors_of(batch.column("x"), int(length))), batch.column("floor").to_pylist(), strict=True)):
                head: set[int] = set()
                mine: set[int] = set()
                for bound, start, need in books.visits(x):
                    own = range(start, start + need)
                    if bound != np.inf and not head:
                        head.update(own)
                        if first:
                            break
                    if floor is not None and bound < floor:
                        break
                    mine.update(own)
                chosen = sorted(head if first else mine - head if first is False else mine)
                places += [at] * len(chosen)
                units += chosen
            rows = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("length"), pa.array(units, pa.int64()), *(rows.column(c) for c in ("vec_id", "label", "copy", "x", "floor", "windows"))],
                                             [c.split()[0] for c in ASKED.split(", ")])

    return anchors.mapInArrow(work, ASKED)


def _met(rows: DataFrame, asked: DataFrame, shared, s: Settings, windows: bool) -> DataFrame:
    """(anchor_id, copy, positive_score, vec_id, score): what each unit finds for the anchors sent to it. ``windows``: negatives, else positives."""
    k = s.k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = built(shared, Books)
        at, held, unit = None, [], None
        for (length, number, asks), batch in segments_of(batches, ["length", "unit", "asks"]):
            if (length, number) != at:
                at, held, unit = (length, number), [], None
            if not asks:
                held.append((batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(),
                             whole_parts(vectors_of(batch.column("x"), int(length)))))
                continue
            if unit is None:  # the unit's vectors came first
                unit, held = Unit(books, *(np.concatenate(c) for c in zip(*held, strict=True))), []
            out: list[tuple] = []
            for own, label, copy, q, floor, edges in zip(
                    *(batch.column(c).to_pylist() for c in ("vec_id", "label", "copy")), whole_parts(vectors_of(batch.column("x"), int(length))),
                    batch.column("floor").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                if windows:
                    found = unit.negatives(own, label, q, {p: lower_edge(p, s.least) for p in edges}, k)
                    out += [(own, copy, p, i, -m) for p, best in found.items() for m, i in best]
                else:
                    out += [(own, copy, None, i, -m) for m, i in unit.positives(own, label, q, -np.inf if floor is None else floor, k)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "copy", "positive_score", "vec_id", "score"])

    kind = "array<double>"
    both = (rows.withColumns({"asks": F.lit(0), "x": F.col("x").cast(kind)})
            .unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
            .repartition(tasks_of(rows.sparkSession), "length", "unit").sortWithinPartitions("length", "unit", "asks"))
    return both.mapInArrow(work, "anchor_id bigint, copy bigint, positive_score bigint, vec_id bigint, score bigint")


def lower_edge(positive: int, least: int) -> int:
    """The smallest score n with least * positive <= 100 * n."""
    return -(-least * positive // 100)


def hard_negatives(vectors: DataFrame, is_anchor: Column, settings: Settings | None = None, key: str = "vec_id", vector: str = "embedding",
                   label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of floor(256 x) of the components; higher ones come first, ties by smaller id. An anchor's positives are the
    first k other rows of its label, and a positive's negatives the first k rows of other labels whose score is between ``least`` hundredths
    of the positive's and the positive's. ``is_anchor`` is a condition on ``key``. Rows with a null key, a null label, or a vector that is null, empty or
    holds a null or non-finite component take no part; vectors meet those of their length only. Rows with the anchor's key are not among its
    others; a repeated anchor asks once, other repeated rows count each. A positive with a negative score has no negatives. Scores beyond 64 bits count
    as the nearest number that fits. Fewer rows than k give fewer results, an empty table none. Other columns are not read.
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit_vector(F.col("x")))
    dealt, books = _indexed(rows, s)
    shared = ship(spark, words=books.words, cells=books.cells)
    asking = stored(dealt.where(is_anchor).select("length", "vec_id", "label", F.xxhash64("label", "x").alias("copy"), F.col("x").cast("array<double>").alias("x"))
                    .distinct(), "anchors")
    null = {"floor": F.lit(None).cast("double"), "windows": F.lit(None).cast("array<bigint>")}
    best = Window.partitionBy("anchor_id", "copy").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= s.k)

    head = stored(ranked(_met(dealt, _routed(asking.withColumns(null), shared, True, s), shared, s, False)), "positives-first")
    floors = head.where(F.col("place") == s.k).select(F.col("anchor_id").alias("vec_id"), "copy", F.col("score").cast("double").alias("floor"))
    again = asking.join(floors, ["vec_id", "copy"], "left").withColumn("windows", null["windows"])
    rest = _met(dealt, _routed(again.select("length", "vec_id", "label", "copy", "x", "floor", "windows"), shared, False, s), shared, s, False)
    positives = stored(ranked(head.drop("place").unionByName(rest)).select("anchor_id", "copy", F.col("vec_id").alias("positive_id"),
                                                                          F.col("score").alias("positive_score")), "positives")
    edges = (positives.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id"), "copy")
             .agg(F.collect_set("positive_score").alias("windows"), F.min("positive_score").alias("least")))  # k of them at most
    wanted = asking.join(edges, ["vec_id", "copy"]).withColumn("floor", F.floor(F.col("least") * F.lit(s.least / 100.0) - 1).cast("double"))
    found = _met(dealt, _routed(wanted.select("length", "vec_id", "label", "copy", "x", "floor", "windows"), shared, None, s), shared, s, True)
    first = Window.partitionBy("anchor_id", "copy", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    negatives = (found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
                 .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= s.k))
    return positives.join(negatives, ["anchor_id", "copy", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS "rank",
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike
     AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 5
"""


@query("op12_multi_index", SQL)
def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every hundredth embedding; every seventh has another label."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
