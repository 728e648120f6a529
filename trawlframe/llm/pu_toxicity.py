"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else is unlabelled, toxic texts among it. The risk of a
classifier is estimated from those two samples and the class prior:
prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1)), with the logistic loss, so
scores estimate the probability of label 1. While the second part is below zero its gradient is
followed backwards, which keeps the classifier from fitting the unlabelled sample. A member that would call texts without any
known word likelier toxic than the class prior gets the bias that makes the prior the mean score of the unlabelled sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import held_out, stored, table, text_slices
from trawlframe.llm.token_ids import built, ship
from trawlframe.plans.registry import query

WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features beside the words: inflected and compound forms share them.
STEMS = (3, 4, 5, 6)


def features(text: str) -> set[str]:
    """Distinct lower-case words of a whole text, and their beginnings, marked with a star."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the model; all documents are scored, whole."""

    positives: int = 8_000
    unlabelled: int = 16_000
    words: int = 512
    least_texts: int = 5
    least_z: float = 5.0
    members: int = 3
    steps: int = 300
    rate: float = 0.1
    penalty: float = 1e-3
    below: float = 0.1
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Words and, for each member, their weights and a bias. No words and no members: nothing was learned, all score 0."""

    words: tuple[str, ...]
    weights: np.ndarray
    biases: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.biases):
            return np.zeros(len(texts))
        place = {w: i for i, w in enumerate(self.words)}
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            at = sorted(place[w] for w in place.keys() & features(t))
            out[k] = np.mean(1 / (1 + np.exp(-(self.weights[:, at].sum(axis=1) + self.biases))))
        return out


def nnpu(rows: list[np.ndarray], positive: np.ndarray, n_words: int, prior: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the members; ``rows`` holds each text's word numbers."""
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)

    def shares(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights that make means of the positives and of the unlabelled."""
        return tuple(chosen * own / max(1.0, (chosen * own).sum()) for own in (positive, ~positive))

    weights, biases = [], []
    for member in range(s.members):
        draw = np.random.default_rng(s.seed + member).poisson(1.0, len(rows)).astype(float)  # a bootstrap of the rows
        (p, u), (p_left, u_left) = shares(draw), shares((draw == 0).astype(float))
        theta, mean, var = np.zeros(n_words + 1), np.zeros(n_words + 1), np.zeros(n_words + 1)
        theta[-1] = np.log(prior / (1 - prior))
        best, least = theta, np.inf  # the first step is judged too, so nothing worse than the constant is kept
        for step in range(1, s.steps + 1):
            f = np.bincount(owner, theta[flat], minlength=len(rows)) + theta[-1]
            sigma = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            as_positive, as_negative = np.logaddexp(0, -f), np.logaddexp(0, f)  # losses of calling a row so
            # The member keeps the step with the smallest risk on the rows that its bootstrap left out. An unlabelled part far below
            # zero counts against a step: cut at zero, calling everything positive would look best.
            rest = u_left @ as_negative - prior * (p_left @ as_negative)
            risk = prior * (p_left @ as_positive) + (rest if rest > 0 else -s.below * rest)
            if risk < least:
                best, least = theta, risk
            slope = (u - prior * p) * sigma
            slope = prior * p * (sigma - 1) + slope if u @ as_negative >= prior * (p @ as_negative) else -slope
            grad = np.append(np.bincount(flat, slope[owner], minlength=n_words) + s.penalty * theta[:-1], slope.sum())
            mean = 0.9 * mean + 0.1 * grad
            var = 0.999 * var + 0.001 * grad * grad
            theta = theta - s.rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.999 ** step)) + 1e-8)
        weights.append(best[:-1])
        # A text without a known word is no likelier toxic than any text; where training left it so, the bias is set anew.
        sums = np.bincount(owner, best[flat], minlength=len(rows))[~positive]
        biases.append(calibrated(sums, prior) if best[-1] > np.log(prior / (1 - prior)) else best[-1])
    return np.array(weights), np.array(biases)


def calibrated(sums: np.ndarray, prior: float) -> float:
    """The bias with which texts whose weights add up to ``sums`` have the prior as their mean score."""
    low, high = -60.0 - np.abs(sums).max(initial=0), 60.0 + np.abs(sums).max(initial=0)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-np.clip(sums + middle, -500, 500)))).mean() < prior else (low, middle)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, prior: float | None = None) -> Model:
    """Trains on documents and labels whose id is not held out.

    Positives: labels with toxic = 1. ``prior`` is the share of toxic texts; unless given, that of the label rows.
    Null ids, null labels and labels of unknown documents are ignored, repeated rows and exact copies of
    texts count once. Samples are the texts with the smallest hashed ids, at most
    ``positives`` and ``unlabelled`` of them; only their word numbers reach the driver. Without a positive
    (empty tables too) the model scores 0 everywhere.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    if prior is None:
        prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return Model((), np.zeros((0, 0)), np.zeros(0))
    prior = min(max(prior, 1e-4), 1 - 1e-4)

    def smallest(ids: DataFrame, n: int, positive: int) -> DataFrame:
        return (ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id").limit(n)
                .withColumn("positive", F.lit(positive)))

    ids = smallest(known.where("toxic = 1"), s.positives, 1).unionByName(smallest(texts, s.unlabelled, 0))
    # The ids are bounded by the two settings, so this side may be broadcast.
    sample = stored(texts.join(F.broadcast(ids), "doc_id").groupBy("positive", F.md5("text").alias("copy"))
                    .agg(F.min_by("text", "doc_id").alias("text")), "pu-sample")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_unl = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_unl:
        return Model((), np.zeros((0, 0)), np.zeros(0))

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                for positive, text in zip(batch.column("positive").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = sorted(features(text))
                    yield pa.RecordBatch.from_arrays([pa.array([positive] * len(words), pa.int32()), pa.array(words, pa.string())], ["positive", "word"])

    # Words whose share of texts differs most between the two samples, by the z-score of the difference.
    shares = (sample.mapInArrow(word_rows, "positive int, word string").groupBy("word")
              .agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u")).where(F.col("p") + F.col("u") >= s.least_texts)
              .withColumn("pool", (F.col("p") + F.col("u") + 1) / (n_pos + n_unl + 2))
              .withColumn("z", F.abs(F.col("p") / n_pos - F.col("u") / n_unl)
                          / F.sqrt(F.col("pool") * (1 - F.col("pool")) * (1 / n_pos + 1 / n_unl))))
    words = tuple(r["word"] for r in shares.where(F.col("z") >= s.least_z).orderBy(F.desc("z"), "word").limit(s.words).collect())
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for whole in batches:
            for batch in text_slices(whole, "text"):
                found = [np.array(sorted(place[w] for w in place.keys() & features(t)), dtype="<u2").tobytes()
                         for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("copy"), pa.array(found, pa.binary())],
                                                 ["positive", "copy", "words"])

    rows = sample.select("positive", "copy", "text").mapInArrow(numbers, "positive int, copy string, words binary").collect()
    rows.sort(key=lambda r: (r["positive"], r["copy"]))
    weights, biases = nnpu([np.frombuffer(r["words"], dtype="<u2") for r in rows], np.array([r["positive"] == 1 for r in rows]),
                           len(words), prior, s)
    return Model(words, weights, biases)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): 0 to 1 for every whole text, higher where label 1 is likelier. Null and empty texts
    get the score of a text without any known word. Rows that repeat, null keys included, give a row each."""
    kind = docs.schema[key].dataType.simpleString()
    shared = ship(docs.sparkSession, words=model.words, weights=model.weights, biases=model.biases)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = built(shared, Model)
        for whole in batches:
            for batch in text_slices(whole, "t"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), pa.array(own.score([t or "" for t in batch.column("t").to_pylist()]))], ["k", "score"])

    return (docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(work, f"k {kind}, score double")
            .withColumnRenamed("k", key))


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("t"))
    return score(rows, model, "row", "t").where(F.col("score") < threshold).select(
        *(F.col("row").getField(c).alias(c) for c in columns))


THRESHOLD = 0.3


@query("op1_pu_toxicity")
def op1_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
