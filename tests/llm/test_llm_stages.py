"""Pipeline stages on rows with extra columns whose names the operators use inside, and the toxicity model against plain programs."""

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trawlframe.llm import pu_toxicity
from trawlframe.llm.common import held_out

SF = "/root/testdata/sf0.001"
CLASHING = ["_id", "_digest", "digest", "row", "k", "t", "score", "n_lines", "n_dropped", "copies", "block", "component", "draw", "tokens", "a", "b", "lines", "dropped", "copy"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_all_columns(spark, name):
    """Every value of a row that stays is the caller's, maps and repeated rows too; the same rows stay as without the extra columns."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.unionByName(docs.where("doc_id < 5"))
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING}).withColumn("map", F.create_map(F.lit("id"), F.col("doc_id")))
    got, plain = stage(spark, wide, SF), stage(spark, docs, SF)
    if name == "encoding":
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        return
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING) and all(r["map"] == {"id": r["doc_id"]} for r in rows)
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, plain.collect())) and rows
    none = stage(spark, wide.where("false"), SF)
    assert none.count() == 0 and none.columns == wide.columns


def test_toxicity_with_few_labels_keeps_clean_documents(spark):
    """Nine positives: a text without known words is no likelier toxic than any, and the stage keeps nearly all documents."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = pu_toxicity.fit(docs, labels)
    prior = labels.where(~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    assert len(model.biases) and model.score(["", "qqq zzz"]).max() <= prior + 1e-6
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, SF).collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(kept) > 0.9 * docs.count() and len(clean & kept) >= 0.95 * len(clean)


def test_scores_like_a_plain_scorer(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = pu_toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in pu_toxicity.score(docs, model).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        words = pu_toxicity.features(text or "")
        scores = []
        for weights, bias in zip(model.weights, model.biases, strict=True):
            total = bias
            for word, weight in zip(model.words, weights, strict=True):
                if word in words:
                    total += weight
            scores.append(1 / (1 + math.exp(-total)))
        assert abs(got[i] - sum(scores) / len(scores)) < 1e-9


def test_training_like_a_plain_trainer():
    """One member over all rows, step by step, with sums in plain loops."""
    draw = np.random.default_rng(4)
    n_words, prior = 4, 0.3
    rows = [np.flatnonzero(draw.random(n_words) < (0.8 if i < 12 else 0.3)).astype(np.uint16) for i in range(60)]
    positive = np.arange(60) < 12
    s = pu_toxicity.Settings(members=1, steps=25)
    weights, biases = pu_toxicity.nnpu(rows, positive, n_words, prior, s)
    count = np.random.default_rng(s.seed).poisson(1.0, 60)
    theta, mean, var = [0.0] * n_words + [math.log(prior / (1 - prior))], [0.0] * (n_words + 1), [0.0] * (n_words + 1)
    best, least = list(theta), math.inf
    share = lambda own, chosen: {i: chosen[i] / max(1.0, sum(chosen[j] for j in own)) for i in own}
    groups = [[i for i in range(60) if positive[i] == p] for p in (True, False)]
    (p, u), (p_left, u_left) = [[share(g, c) for g in groups] for c in (count.tolist(), [float(c == 0) for c in count])]
    for step in range(1, s.steps + 1):
        f = [theta[-1] + sum(theta[w] for w in r) for r in rows]
        as_pos, as_neg = [math.log1p(math.exp(-x)) for x in f], [math.log1p(math.exp(x)) for x in f]
        rest = sum(w * as_neg[i] for i, w in u_left.items()) - prior * sum(w * as_neg[i] for i, w in p_left.items())
        risk = prior * sum(w * as_pos[i] for i, w in p_left.items()) + (rest if rest > 0 else -s.below * rest)
        if risk < least:
            best, least = list(theta), risk
        train = sum(w * as_neg[i] for i, w in u.items()) - prior * sum(w * as_neg[i] for i, w in p.items())
        grad = [s.penalty * t for t in theta[:-1]] + [0.0]
        for i, r in enumerate(rows):
            sigma = 1 / (1 + math.exp(-f[i]))
            slope = sigma * (u.get(i, 0.0) - prior * p.get(i, 0.0))
            slope = slope + prior * p.get(i, 0.0) * (sigma - 1) if train >= 0 else -slope
            for w in [*r, n_words]:
                grad[w] += slope
        for w in range(n_words + 1):
            mean[w], var[w] = 0.9 * mean[w] + 0.1 * grad[w], 0.999 * var[w] + 0.001 * grad[w] ** 2
            theta[w] -= s.rate * mean[w] / (1 - 0.9 ** step) / (math.sqrt(var[w] / (1 - 0.999 ** step)) + 1e-8)
    assert np.allclose(weights[0], best[:-1], atol=1e-6) and (abs(biases[0] - best[-1]) < 1e-6 or best[-1] > math.log(prior / (1 - prior)))


def test_calibration_meets_the_prior():
    sums = np.random.default_rng(5).normal(size=500) * 4
    for prior in (1e-4, 0.1, 0.9):
        assert abs((1 / (1 + np.exp(-(sums + pu_toxicity.calibrated(sums, prior))))).mean() - prior) < 1e-9


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from trawlframe import build_session
spark = build_session("shipping", "local[2]", **{{"spark.sql.shuffle.partitions": 2, "spark.ui.enabled": "false"}})
for name in [n for n in entry.queries() if n.startswith(("op1_", "op2_", "op7_", "op9_", "op11_", "op12_", "op13_"))]:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_queries_run_from_elsewhere(tmp_path):
    """Workers get what they need with the job: the package is on the driver's path only."""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(corpus_pipeline.__file__).resolve().parent)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
