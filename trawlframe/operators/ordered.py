"""Ordered per-key work: running numbers and sums that stay parallel when one key is huge, and sequential rules.

The order columns must identify a row within its key (end them with an id). Building a plan here starts no job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a slice, about; a key with fewer has one slice.
ROWS_PER_SLICE = 1_000_000
# Sampled rows a slice, about.
SAMPLES = 100
# All bounds of a table together; beyond, slices grow. This bounds the broadcast of bounds and of what a slice carries.
MOST_BOUNDS = 1 << 16
# Input of fewer bytes than so many a row of a slice holds no key that is worth cutting.
BYTES_PER_ROW = 64


def cannot_be_large(df: DataFrame, rows_per_slice: int) -> bool:
    """True if the optimizer takes the whole of ``df`` for less than one slice: then a plain window, or one task a key, is the better plan.

    Either plan gives the same rows. An estimate that is too small costs parallel work on one key, no memory: sorts spill.
    """
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < rows_per_slice * BYTES_PER_ROW


def slice_bounds(df: DataFrame, rows_per_slice: int) -> DataFrame:
    """(_cut, _bounds): for each key of more than about ``rows_per_slice`` rows the sorted orders at which a slice of it begins.

    They come from rows picked by a hash of key and order, so they are the same whenever a part of the plan is
    computed again. The samples of a key are numbered by a sort that spills and all but each slice's first leave at once, so no
    list of samples is ever made; what is left are ``MOST_BOUNDS`` rows at most.
    """
    every = max(1, rows_per_slice // SAMPLES)
    per_slice = max(1, rows_per_slice // every)
    picked = df.where(F.pmod(F.xxhash64("_key", "_order"), F.lit(every)) == 0).select("_key", "_order")
    # Slices of all keys grow alike where there would be too many.
    step = picked.agg((F.greatest(F.ceil(F.count(F.lit(1)) / (per_slice * MOST_BOUNDS)), F.lit(1)) * per_slice).alias("_step"))
    numbered = picked.withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy("_order")))
    return (numbered.where((F.col("_at") > 1) & ((F.col("_at") - 1) % step.scalar() == 0))
            .groupBy(F.col("_key").alias("_cut")).agg(F.array_sort(F.collect_list("_order")).alias("_bounds")))


def place_in(bounds: Column, order: Column) -> Column:
    """How many of the sorted ``bounds`` are not above ``order``, by binary search; 0 where there are none."""
    def halve(found: Column, _: Column) -> Column:
        low, high = found["low"], found["high"]
        middle = F.floor((low + high) / 2).cast("int")
        above = F.get(bounds, middle) > order
        open_ = low < high
        return F.struct(F.when(open_ & ~above, middle + 1).otherwise(low).alias("low"), F.when(open_ & above, middle).otherwise(high).alias("high"))

    steps = F.sequence(F.lit(1), F.floor(F.log2(F.greatest(F.size(bounds), F.lit(1)))).cast("int") + 1)
    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    return F.when(bounds.isNull(), 0).otherwise(F.aggregate(steps, start, halve, lambda found: found["low"]))


def _sliced(df: DataFrame, rows_per_slice: int) -> tuple[DataFrame, DataFrame]:
    """``df`` (with _key, _order) with _slice: the ranges of the order that its key is cut into; and only the rows of cut keys."""
    bounds = slice_bounds(df, rows_per_slice)

    def cut(how: str) -> DataFrame:
        # A struct equals another one with nulls in the same places, so null keys meet too.
        return (df.join(F.broadcast(bounds), F.col("_key") == F.col("_cut"), how)
                .withColumn("_slice", place_in(F.col("_bounds"), F.col("_order")))
                # Bounds are orders of rows: this one begins its slice.
                .withColumn("_begins", F.coalesce(F.get("_bounds", F.col("_slice") - 1) == F.col("_order"), F.lit(False))).drop("_cut", "_bounds"))
    return cut("left"), cut("inner")


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    *,
    count: str | None = None,
    sums: dict[str, Column] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Adds a 1-based row number and inclusive running sums per key.

    Equals ``row_number()`` / ``sum()`` over (partition by keys order by order); a sum is null until its
    first value that is not. Windows run over slices of a key, and what the earlier slices of a cut key add
    is joined on, a row for each slice.
    """
    measures = {name: expr for name, expr in (sums or {}).items()}
    if count:
        measures[count] = F.lit(1).cast("long")
    own = [c for c in df.columns if c not in measures]
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    named = df.select("*", *[expr.alias(f"_m_{name}") for name, expr in measures.items()],
                      F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k0")]).alias("_key"),
                      F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)]).alias("_order"))
    if cannot_be_large(df, rows_per_slice):
        whole = Window.partitionBy("_key").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return named.select(*own, *[F.sum(f"_m_{m}").over(whole).alias(m) for m in measures])
    rows, cut = _sliced(named, rows_per_slice)
    inside = Window.partitionBy("_key", "_slice").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (cut.groupBy("_key", "_slice").agg(*[F.sum(f"_m_{m}").alias(f"_t_{m}") for m in measures])
             .select(F.col("_key").alias("_ck"), F.col("_slice").alias("_cs"), *[F.sum(f"_t_{m}").over(earlier).alias(f"_c_{m}") for m in measures]))
    summed = rows.select(*own, "_key", "_slice", *[F.sum(f"_m_{m}").over(inside).alias(f"_l_{m}") for m in measures])
    # As small as the bounds: a row for each slice of a cut key.
    joined = summed.join(F.broadcast(carry), (F.col("_key") == F.col("_ck")) & (F.col("_slice") == F.col("_cs")), "left")

    def total(m: str) -> Column:
        local, before = F.col(f"_l_{m}"), F.col(f"_c_{m}").cast(summed.schema[f"_l_{m}"].dataType)
        return F.coalesce(local + before, local, before).alias(m)
    return joined.select(*own, *[total(m) for m in measures])


# Values of one key's consecutive rows and the state before them -> values of
# new columns (``_keep``: which rows stay) and the state after them.
Fold = Callable[[dict[str, np.ndarray], str | None], tuple[dict[str, np.ndarray], str | None]]


def starts(keys: pd.Series) -> np.ndarray:
    """Positions where a new key begins; null is a key like any other."""
    before = keys.shift()
    same = (keys == before).to_numpy(dtype=bool, na_value=False) | (keys.isna() & before.isna()).to_numpy()
    same[:1] = False
    return np.flatnonzero(~same)


def same_key(a, b) -> bool:
    return bool(pd.isna(a) and pd.isna(b)) or bool(not pd.isna(a) and not pd.isna(b) and a == b)


@dataclass(frozen=True)
class Rule:
    """A sequential rule that can be composed: what a slice makes of every state that may enter it is told by a small text.

    ``summary`` gives it from the values of a whole slice, ``through`` finds the state that leaves the slice for the one that enters.
    """

    fold: Fold
    summary: Callable[[dict[str, np.ndarray]], str]
    through: Callable[[str, str | None], str | None]


def _entries(cut: DataFrame, needs: list[str], rule: Rule) -> DataFrame:
    """(_ck, _cs, _entry): the state that enters each slice of a cut key.

    Every slice is summarised on its own, by a task that holds the needed columns of one slice. The summaries, a row for each slice, are
    then composed key by key.
    """
    summary, through = rule.summary, rule.through
    key = T.StructType.fromJson(cut.schema["_key"].dataType.jsonValue())

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held)
                text = summary({c: whole.column(c).to_numpy() for c in needs})
                yield pa.RecordBatch.from_arrays([held[0].column("_key").slice(0, 1), held[0].column("_slice").slice(0, 1), pa.array([text])],
                                                 ["_key", "_slice", "_summary"])
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, slices = batch.column("_code").to_numpy(), batch.column("_slice").to_numpy()
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (slices[1:] != slices[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if (codes[a], slices[a]) != at:
                    yield from close()
                    at = (codes[a], slices[a])
                held.append(batch.slice(a, b - a))
        yield from close()

    told = T.StructType([T.StructField("_key", key), T.StructField("_slice", T.IntegerType()), T.StructField("_summary", T.StringType())])
    coded = cut.withColumn("_code", F.xxhash64("_key"))
    slices = (coded.select("_key", "_slice", "_order", "_code", *needs).repartition("_key", "_slice")
              .sortWithinPartitions("_code", "_key", "_slice", "_order").select("_key", "_slice", "_code", *needs).mapInArrow(summarised, told))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, None
        for batch in batches:
            entries = []
            for k, text in zip(batch.column("_key").to_pylist(), batch.column("_summary").to_pylist(), strict=True):
                if k != before:
                    before, state = k, None
                entries.append(state)
                state = through(text, state)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_slice"), pa.array(entries, pa.string())], ["_ck", "_cs", "_entry"])

    named = T.StructType([T.StructField("_ck", key), T.StructField("_cs", T.IntegerType()), T.StructField("_entry", T.StringType())])
    return slices.repartition("_key").sortWithinPartitions("_key", "_slice").mapInArrow(composed, named)


def ordered_fold(df: DataFrame, key: str, order: list[str], needs: list[str], rule: Rule | Fold, schema: str,
                 rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Runs a sequential rule over each key's rows in order.

    The rule's fold gets the columns ``needs`` of consecutive rows of one key and the state left by the rows before them (None at the start
    of the key). A task streams through its sorted rows and carries one state from batch to batch: the memory of a batch; the sort spills.
    With a ``Rule`` a large key is cut into slices: they are summarised side by side, the summaries composed, and each slice is then folded
    from the state known to enter it. A plain fold cannot be composed; then a key is one task's work.
    """
    out = T.StructType.fromDDL(schema)
    names = out.names
    fold = rule.fold if isinstance(rule, Rule) else rule
    one = not isinstance(rule, Rule) or cannot_be_large(df, rows_per_slice)
    if one:
        rows = df.withColumns({"_slice": F.lit(0), "_entry": F.lit(None).cast("string")})
    else:
        named = df.withColumns({"_key": F.struct(F.col(key).alias("k0")), "_order": F.struct(*order)})
        sliced, cut = _sliced(named, rows_per_slice)
        # As small as the bounds: a row for each slice of a cut key.
        entries = _entries(cut, needs, rule)
        rows = sliced.join(F.broadcast(entries), F.col("_begins") & (F.col("_key") == F.col("_ck")) & (F.col("_slice") == F.col("_cs")), "left").drop(
            "_key", "_order", "_begins", "_ck", "_cs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_slice, state, first = None, None, None, True
        for rows in batches:
            if not len(rows):
                continue
            values = {c: rows[c].to_numpy() for c in needs}
            slices = rows["_slice"].to_numpy()
            cuts = np.union1d(starts(rows[key]), np.flatnonzero(slices[1:] != slices[:-1]) + 1).astype(int).tolist()
            made: dict[str, list[np.ndarray]] = {}
            for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                goes_on = a == 0 and not first and slices[0] == last_slice and same_key(last_key, rows[key].iloc[0])
                new, state = fold({c: v[a:b] for c, v in values.items()}, state if goes_on else rows["_entry"].iloc[a])
                for name, column in new.items():
                    made.setdefault(name, []).append(column)
            last_key, last_slice, first = rows[key].iloc[-1], slices[-1], False
            done = rows.assign(**{name: np.concatenate(parts) for name, parts in made.items()})
            yield (done[done["_keep"]] if "_keep" in made else done)[names]

    spread = rows.repartition(F.col(key)) if one else rows.repartition(F.col(key), F.col("_slice"))
    return spread.sortWithinPartitions(key, "_slice", *order).mapInPandas(run, out)
