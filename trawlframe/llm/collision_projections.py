"""Near-dedup of embeddings by counting collisions on one-dimensional projections.

Equal vectors become one representative. Representatives are sorted on many random one-dimensional
projections. A sort table first cuts them at the middle of a few projections, which keeps the parts
small, and then looks through the window of each vector on the sorted order
of one more. For every pair met there the collisions on all counting projections, each in a window centred on the
querying vector, are counted; pairs with enough collisions are verified by cosine.

Calibration, for a pair at the threshold itself (distance d of the unit vectors): a difference of projections is
normal with deviation d, and a middle cut separates the pair with probability angle / pi. The number of tables
follows from the wanted miss rate, the count from four standard deviations below its mean. The number of cuts grows with the logarithm of
the number of vectors, so that parts keep their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import deal_units, map_runs, merge_edges, smallest_of, stored, table
from trawlframe.llm.components import components
from trawlframe.plans.registry import query


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    miss: float = 0.01
    part_rows: int = 128
    block_rows: int = 2_048
    counting: int = 32
    seed: int = 5


@dataclass(frozen=True)
class Layout:
    """Numbers that follow from the settings and the number of vectors."""

    cuts: int
    tables: int
    window: float
    count_window: float
    least_count: int


def layout(n: int, s: Settings) -> Layout:
    distance = math.sqrt(2 - 2 * s.cosine)
    window, count_window = 2.0 * distance, distance
    cuts = max(0, math.ceil(math.log2(max(1, n) / s.part_rows)))
    met = (1 - math.acos(s.cosine) / math.pi) ** cuts * math.erf(window / distance / math.sqrt(2))
    collide = math.erf(count_window / distance / math.sqrt(2))
    least = s.counting * collide - 4 * math.sqrt(s.counting * collide * (1 - collide))
    return Layout(cuts, max(1, math.ceil(math.log(s.miss) / math.log(1 - met))), window, count_window, max(1, int(least)))


class Projections:
    """The random directions for vectors of one length."""

    def __init__(self, length: int, plan: Layout, s: Settings):
        draw = np.random.default_rng([s.seed, length])
        self.plan = plan
        self.cut = draw.standard_normal((plan.tables, plan.cuts, length))
        self.sort = draw.standard_normal((plan.tables, length))
        self.count = draw.standard_normal((s.counting, length))

    def parts(self, unit: np.ndarray) -> np.ndarray:
        """Part of each vector in each table, as the number made of the sides of the cuts."""
        weights = 1 << np.arange(self.plan.cuts, dtype=np.int64)
        return np.stack([(unit @ c.T > 0) @ weights if self.plan.cuts else np.zeros(len(unit), np.int64) for c in self.cut], axis=1)


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length one in double precision, scaled first so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links_of_run(run: pa.Table, made: Projections, s: Settings, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of a run that are linked and that no earlier table has shown."""
    plan, at = made.plan, run.column("t")[0].as_py()
    crossing = run.column("u")[0].as_py() != run.column("v")[0].as_py()
    block = run.column("block").to_numpy()
    unit = unit_vectors(run.column("vector").to_pylist(), kind)
    place = unit @ made.sort[at]
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], place[order] + plan.window, side="right")
    counts = (unit @ made.count.T).astype(np.float32)
    lengths = ends - np.arange(len(order)) - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(order):
        # Windows of as many vectors as give about 2^17 pairs at a time.
        stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), 1 << 17, side="right")))
        span = lengths[start:stop]
        first = np.repeat(np.arange(start, min(stop, len(order))), span)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(span) - span, span)
        i, j = order[first], order[second]
        if crossing:
            other = block[i] != block[j]
            i, j = i[other], j[other]
        enough = (np.abs(counts[i] - counts[j]) <= plan.count_window).sum(axis=1) >= plan.least_count
        i, j = i[enough], j[enough]
        alike = np.einsum("ij,ij->i", unit[i], unit[j]) >= s.cosine
        found.append((i[alike], j[alike]))
        start = stop
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if at and len(i):
        rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        parts, sorts = made.parts(unit[rows]), unit[rows] @ made.sort.T
        a, b = back[:len(i)], back[len(i):]
        new = np.arange(len(i))
        for t in range(at):
            new = new[~((parts[a[new], t] == parts[b[new], t]) & (np.abs(sorts[a[new], t] - sorts[b[new], t]) <= plan.window))]
        i, j = i[new], j[new]
    return i, j


def near_duplicates(vectors: DataFrame, settings: Settings | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: other vectors linked directly, the smallest vec_id
    reachable over links, and whether it is the row's own.

    Links are pairs with cosine of at least the threshold, in double precision. A vector that is null, empty, zero or holds a
    null or non-finite component links with nothing, nor do vectors of different lengths, nor rows
    with a null vec_id (component null, kept). Equal vectors are always linked. Other columns are not read.
    """
    s = settings or Settings()
    wide = vectors.schema[vector].dataType.elementType.simpleString() != "float"
    kind, width = ("<f8", 8) if wide else ("<f4", 4)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>" if wide else "array<float>").alias("x"))
    fit = (F.col("vec_id").isNotNull() & F.coalesce(F.size("x") > 0, F.lit(False))
           & F.expr("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf')) AND exists(x, c -> c <> 0)"))
    marked = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    # -0.0 and 0.0 are equal: adding 0 makes them one.
    marked = marked.withColumn("x", F.when(F.col("fit"), F.transform("x", lambda c: c + F.lit(0).cast("double" if wide else "float"))))
    marked = marked.withColumns({"a": F.xxhash64("x"), "b": F.xxhash64(F.lit(1), "x")})
    reps = stored(marked.where("fit").groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                           F.first("x").alias("x")), "classes")
    plan = layout(reps.count(), s)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Projections] = {}
        for batch in batches:
            x = batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(kind)
            sizes = x.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            raw = [flat[e - n:e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            parts = np.zeros((len(raw), plan.tables), np.int64)
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                if n not in made:
                    made[n] = Projections(n, plan, s)
                parts[own] = made[n].parts(unit_vectors([raw[i] for i in own.tolist()], kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(raw) + 1, dtype=np.int32) * plan.tables), pa.array(parts.ravel()))],
                ["rep", "copies", "vector", "parts"])

    dealt = stored(reps.select("rep", "copies", "x").mapInArrow(deal, "rep bigint, copies bigint, vector binary, parts array<bigint>"), "parts")
    placed = dealt.select("rep", "copies", "vector", F.octet_length("vector").alias("bytes"), F.posexplode("parts").alias("t", "part"))
    # Parts beyond a block are dealt to several units; the table of them has a row for every block_rows rows at most.
    large = stored(placed.groupBy("t", "bytes", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.block_rows), "large")
    units = deal_units(placed.join(large, ["t", "bytes", "part"], "left"), "rep", F.coalesce(F.ceil(F.col("n") / s.block_rows), F.lit(1)))

    def link(runs: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Projections] = {}
        for run in runs:
            if run.num_rows < 2:
                continue
            n = run.column("bytes")[0].as_py() // width
            if n not in made:
                made[n] = Projections(n, plan, s)
            i, j = _links_of_run(run, made[n], s, kind)
            if not len(i):
                continue
            reps, copies = run.column("rep").to_numpy(), run.column("copies").to_numpy()
            links = np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))
            roots = smallest_of(reps, merge_edges(np.arange(len(reps)), i, j))
            keep = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(reps[keep]), pa.array(roots[keep]), pa.array(links[keep].astype(np.int64))], ["a", "b", "links"])

    linked = stored(map_runs(units.select("t", "bytes", "part", "u", "v", "block", "rep", "copies", "vector"),
                             ["t", "bytes", "part", "u", "v"], [], link, "a bigint, b bigint, links bigint"), "links")
    groups = components(linked.select("a", "b")).withColumnsRenamed({"node": "rep", "component": "smallest"})
    degrees = linked.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = (reps.select("a", "b", "rep", "copies").join(groups, "rep", "left").join(degrees, "rep", "left")
             .select("a", "b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("smallest", "rep").alias("smallest")))
    return (marked.select("vec_id", "fit", F.when(F.col("fit"), F.col("a")).alias("a"), F.when(F.col("fit"), F.col("b")).alias("b"))
            .join(named, ["a", "b"], "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("smallest", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


@query("op4_collision_projections")
def op4_collision_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
