"""A job as a list of named DataFrame -> DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class StepLog:
    """Row counts per step, filled in by the job's own action."""

    def __init__(self) -> None:
        self._counts: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str) -> DataFrame:
        self._counts[name] = Observation(f"rows_{name}")
        return df.observe(self._counts[name], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        return {name: int(seen.get["rows"]) for name, seen in self._counts.items()}


def run_steps(df: DataFrame, steps: dict[str, Step], log: StepLog | None = None) -> DataFrame:
    """The steps one after the other, as one plan; with a log each step's rows
    are counted on the way."""
    for name, step in steps.items():
        df = df.transform(step)
        if log is not None:
            df = log.watch(df, name)
    return df
