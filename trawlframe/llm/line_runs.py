"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, largest doc_ids first. A batch's line keys are reduced to one row a key and
merge-anti-joined with the runs written so far: keys that no run has are new, and their
largest holder in the batch is their largest of all. The batch then
adds its own run, sorted by key. Runs of a level are compacted into one of the next level as soon as
there are ``fanout`` of them, so a batch meets few runs. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import WHITE_SPACE, stored, table
from trawlframe.plans.registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """Keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose all lines but those of the largest."""

    least_chars: int = 20
    least_docs: int = 3
    batches: int = 4
    fanout: int = 2


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z lower-cased (only these, so lower() serves for plain ASCII)."""
    bare = F.btrim(line, F.lit(WHITE_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class Runs:
    """Levels of sorted runs (a, b, n_docs, keeper): the two halves of a key's hash, in
    how many documents of the run's batches it stands, and the largest of all documents that hold it (null
    unless that one is in these batches)."""

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    @staticmethod
    def _sorted(run: DataFrame, label: str) -> DataFrame:
        return stored(run.sortWithinPartitions("a", "b"), label)

    def add(self, keys: DataFrame) -> None:
        """``keys``: (a, b, n_docs, keeper) of a batch whose doc_ids are all smaller than those of earlier batches."""
        known = self.all()
        if known is not None:
            known = known.select("a", "b")
            fresh = keys.join(known.hint("merge"), ["a", "b"], "left_anti")
            again = keys.join(known.hint("merge"), ["a", "b"], "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            keys = fresh.unionByName(again)
        self.levels[0].append(self._sorted(keys, "run-0"))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = runs[0]
            for r in runs[1:]:
                merged = merged.unionByName(r)
            self.levels[level] = []
            self.levels[level + 1].append(self._sorted(self.totals(merged), f"run-{level + 1}"))

    @staticmethod
    def totals(runs: DataFrame) -> DataFrame:
        return runs.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def _dropped_lines(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, copy, dropped): the line numbers, from 1, that each document loses; ``copy`` tells rows of a doc_id apart."""
    found = docs.where("doc_id IS NOT NULL").select("doc_id", "copy", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keyed = found.select("doc_id", "copy", (F.col("at") + 1).alias("at"), line_key(F.col("line")).alias("key")).where(
        F.char_length("key") >= s.least_chars)
    # Batches are ranges of doc_id with about as many documents each.
    shares = [k / s.batches for k in range(1, s.batches)]
    cuts = sorted(set(docs.approxQuantile("doc_id", shares, 0.01))) if shares else []
    batch = sum((F.col("doc_id") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    lines = stored(keyed.select("doc_id", "copy", "at", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"),
                                batch.alias("batch")), "lines")
    runs = Runs(s.fanout)
    for k in range(len(cuts), -1, -1):
        mine = lines.where(F.col("batch") == k)
        runs.add(mine.select("a", "b", "doc_id").distinct().groupBy("a", "b")
                 .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")))
    frequent = runs.totals(runs.all()).where(F.col("n_docs") >= s.least_docs).select("a", "b", "keeper")
    return (lines.join(frequent, ["a", "b"]).where("doc_id <> keeper").groupBy("doc_id", "copy")
            .agg(F.collect_list("at").alias("dropped")))


def without_repeated_lines(docs: DataFrame, settings: Settings | None = None, counts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the text after line dedup, and n_lines and n_dropped (unless ``counts`` is off).

    A null or empty text is one empty line and becomes an empty text. Rows with the same
    doc_id count as one document; a row with a null doc_id neither counts nor loses lines. Other columns are
    kept as they are; with ``counts``, columns named n_lines or n_dropped are replaced.
    """
    s = settings or Settings()
    others = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    work = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"))
    dropped = _dropped_lines(work.select("doc_id", "text", "copy"), s)
    joined = work.join(dropped, ["doc_id", "copy"], "left").withColumn("lines", lines_of(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), "dropped")
    text = (F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit("")))
            .otherwise(F.array_join(F.transform(stay, lambda at: F.element_at("lines", at)), "\n")))
    made = (F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    return joined.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in others), *(made if counts else ()))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op8_line_runs", SQL)
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and a digest of what stays of each document."""
    out = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
