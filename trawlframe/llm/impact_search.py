"""Exact top-k search by integer inner product over an impact-ordered index.

Vectors are dealt to blocks. A block's index has posting segments: for each dimension and quantised impact the vectors
with it. A query goes through a block score at a time: segments by descending impact, which is what they add beyond the least of their
dimension, go to the accumulators of their vectors. A dimension not yet seen of a vector adds no more than the best
segment that is left, and the k-th best exact score so far, of this block or the first one, is a floor: a vector whose accumulator
plus that bound is below the floor is proven out. Processing stops when few vectors are left possible; these are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawlframe.llm.common import fit_vector, integer_scores, norms_of, segments_of, stored, table, tasks_of, vectors_of, whole_parts
from trawlframe.plans.registry import query


@dataclass(frozen=True)
class Settings:
    """``k`` results a query; ``block_rows`` vectors of a block; ``levels``: quantised impacts of a dimension, about; ``checks``: shares of the
    postings after which possible vectors are counted; ``rescore``: so few of them are scored exactly at once."""

    k: int = 5
    block_rows: int = 8_192
    levels: int = 48
    checks: tuple[float, ...] = (0.8, 0.9, 0.95, 0.98, 1.0)
    rescore: int = 384


#: Vectors longer than this are possible results of every query; others' sums are exact in double precision.
WIDE_NORM = float(1 << 26)


class BlockIndex:
    """Posting segments of the vectors of one block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, s: Settings):
        self.ids, self.values, self.norms, self.s = ids, values, norms_of(values), s
        self.wide = np.flatnonzero(self.norms > WIDE_NORM)
        rows = np.flatnonzero(self.norms <= WIDE_NORM)
        v = values[rows]
        step = max(1.0, float(v.max(initial=0) - v.min(initial=0)) / s.levels)
        low, high, dim, self.postings = [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)], []
        for d in range(v.shape[1] if len(rows) else 0):
            order = np.argsort(v[:, d], kind="stable")
            own = v[order, d]
            levels = np.floor(own / step)
            starts = np.flatnonzero(np.append(True, levels[1:] != levels[:-1]))
            # The values that a segment really holds bound it more closely than its level.
            low.append(own[starts])
            high.append(own[np.append(starts[1:], len(own)) - 1])
            dim.append(np.full(len(starts), d))
            self.postings += np.split(rows[order], starts[1:])
        self.low, self.high, self.dim = map(np.concatenate, (low, high, dim))
        self.sizes = np.array([len(p) for p in self.postings], np.int64)

    def possible(self, q: np.ndarray, q_norm: float, own: int, floor: float) -> np.ndarray:
        """Rows that can still be among the best k; all others are proven to be below the floor, given or found."""
        s, n = self.s, len(self.ids)
        others = self.ids != own
        if not len(self.postings) or q_norm > WIDE_NORM:
            return np.flatnonzero(others)
        weight = q[self.dim]
        most, least = np.maximum(weight * self.low, weight * self.high), np.minimum(weight * self.low, weight * self.high)
        # Contributions are counted from the least of their dimension, so every segment adds something.
        ground = np.full(len(q), np.inf)
        np.minimum.at(ground, self.dim, least)
        impact = most - ground[self.dim]
        order = np.argsort(-impact, kind="stable")
        impact, done = impact[order], np.cumsum(self.sizes[order])
        total, seen = np.zeros(n), np.zeros(n)
        base, at = float(ground.sum()), 0
        slack = 1e-9 * (abs(base) + float(impact[0]) * len(q)) + 1e-6  # for the rounding of sums
        rows = np.flatnonzero(others & (self.norms <= WIDE_NORM))
        for share in s.checks:
            upto = len(order) if share >= 1 else int(np.searchsorted(done, share * done[-1]))
            if upto > at:
                found = np.concatenate([self.postings[i] for i in order[at:upto].tolist()])
                total += np.bincount(found, np.repeat(impact[at:upto], self.sizes[order[at:upto]]), n)
                seen += np.bincount(found, minlength=n)
                at = upto
            # A dimension not seen of a row adds no more than the best segment that is left.
            ahead = float(impact[at]) if at < len(order) else 0.0
            sums = total[rows] + (len(q) - seen[rows]) * ahead
            if len(rows) > s.k:
                best = rows[np.argpartition(-sums, s.k)[:2 * s.k]]
                exact = np.sort(integer_scores(self.values[best], self.norms[best], q, q_norm))[::-1]
                if len(exact) >= s.k:
                    floor = max(floor, float(exact[s.k - 1]))
            rows = rows[sums + base + slack >= floor]
            if len(rows) <= s.rescore:
                break
        return np.union1d(rows, self.wide[others[self.wide]]) if len(self.wide) else rows

    def search(self, own: int, q: np.ndarray, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, exact scores) of the best k rows whose id is not ``own``, ties to smaller ids; and how many rows were scored."""
        q_norm = float(norms_of(q))
        rows = self.possible(q, q_norm, own, floor)
        scores = integer_scores(self.values[rows], self.norms[rows], q, q_norm)
        top = np.lexsort((self.ids[rows], -scores))[:self.s.k]
        return self.ids[rows[top]], scores[top], len(rows)


def _searched(candidates: DataFrame, queries: DataFrame, n_units: int, s: Settings) -> DataFrame:
    """(query_id, copy, vec_id, score): the best k of each block for the queries sent to it. Both sides have length, block, part, vec_id, x."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, index = [], None, None
        for (length, block, part, asks), batch in segments_of(batches, ["length", "block", "part", "asks"]):
            if (length, block, part) != at:
                held, at, index = [], (length, block, part), None
            ids, values = batch.column("vec_id").to_numpy(), whole_parts(vectors_of(batch.column("x"), int(length)))
            if not asks:
                held.append((ids, values))
                continue
            if index is None:  # candidates come first; the queries then stream through their index
                if not held:
                    continue
                index, held = BlockIndex(*(np.concatenate(c) for c in zip(*held, strict=True)), s), []
            asked, copies, found, scores = [], [], [], []
            for own, copy, q, floor in zip(ids.tolist(), batch.column("copy").to_pylist(), values, batch.column("floor").to_pylist(), strict=True):
                best, exact, _ = index.search(own, q, -np.inf if floor is None else floor)
                asked.append(np.full(len(best), own))
                copies.append(np.full(len(best), copy))
                found.append(best)
                scores.append(exact)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (asked, copies, found, scores)],
                                             ["query_id", "copy", "vec_id", "score"])

    both = (candidates.withColumns({"asks": F.lit(0), "copy": F.lit(None).cast("long"), "floor": F.lit(None).cast("double")})
            .unionByName(queries.withColumn("asks", F.lit(1)))
            .repartition(max(tasks_of(candidates.sparkSession), n_units), "length", "block", "part").sortWithinPartitions("length", "block", "part", "asks"))
    return both.select("length", "block", "part", "asks", "vec_id", "copy", "floor", "x").mapInArrow(
        work, "query_id bigint, copy bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, settings: Settings | None = None, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query, scores descending, ties to the smaller vec_id.

    ``is_query`` is a condition on ``key``. Vectors that are null, empty or hold a null or non-finite
    component take no part, nor do rows with a null key; vectors are compared with those of their length. A row is no candidate
    for a query of the same key, repeated rows are candidates each, and a repeated query asks once.
    A query without candidates gives no rows. Scores beyond 64 bits count as the nearest number that fits. Other columns are not read.

    All queries go through the first block; the k-th score they find there is the floor with which they start in all other blocks.
    """
    s = settings or Settings()
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    fit = rows.where(F.col("vec_id").isNotNull() & fit_vector(F.col("x"))).withColumn("length", F.size("x"))
    n_blocks = max(1, -(-fit.count() // s.block_rows))
    # Few blocks are indexed by several tasks, each for a part of the queries, so that all tasks have work.
    parts = max(1, -(-2 * tasks_of(vectors.sparkSession) // n_blocks))
    block = F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = fit.select("vec_id", "x", "length", block.alias("block"), each.alias("part"))
    asking = fit.where(is_query).select("vec_id", "x", "length", F.xxhash64("x").alias("copy"),
                                        F.pmod(F.xxhash64("x", F.lit(1)), F.lit(parts)).cast("int").alias("part")).distinct()
    ranked = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    none = F.lit(None).cast("double")
    found = _searched(candidates.where("block = 0"), asking.withColumns({"block": F.lit(0), "floor": none}), parts, s)
    if n_blocks > 1:
        head = stored(found, "first-block")
        floors = head.groupBy(F.col("query_id").alias("vec_id"), "copy").agg(
            F.when(F.count(F.lit(1)) >= s.k, F.min("score").cast("double")).alias("floor"))
        others = asking.join(floors, ["vec_id", "copy"], "left").withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(n_blocks - 1))))
        found = head.unionByName(_searched(candidates.where("block > 0"), others, n_blocks * parts, s))
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= s.k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INTEGER AS "rank", vec_id, score FROM ranked WHERE place <= 5
"""


@query("op7_impact_search", SQL)
def op7_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others for every fiftieth embedding."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
