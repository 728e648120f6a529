"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trawlframe.llm import (anchor_pii, chosen_path, collision_projections, huffman_ids, impact_search, line_runs, pair_index_bpe, pu_toxicity,
                            temperature_mix, text_density)
from trawlframe.llm.common import stored
from trawlframe.llm.components import components
from trawlframe.session import scratch_path

LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = " ".join(f"b{i}" for i in range(60))
DOCS = [(1, "Mail me@x.org now"), (2, None), (3, ""), (4, LONG), (5, BASE), (6, BASE), (7, BASE + " end"), (8, BASE.upper() + " end"), (9, "one"), (10, "ONE"),
        (11, " \t\n"), (12, "Mail me@x.org now"), (None, BASE), (12, "Mail me@x.org now"), (13, "é" * 10 + " " + BASE)]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(DOCS, SCHEMA)
    return df.selectExpr("doc_id", "text", "'s' AS source", "1 AS k", "2 AS t", "3 AS row", "4 AS ids", "5 AS copies", "6 AS block", "7 AS rep", "8 AS score",
                         "9 AS component_id", "10 AS tokens")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", source string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_bpe(docs, none):
    bpe = pair_index_bpe.load(pair_index_bpe.tokenizer_path("word_bpe_49k.json"))
    library = Tokenizer.from_file(pair_index_bpe.tokenizer_path("word_bpe_49k.json"))
    both = pair_index_bpe.decode(pair_index_bpe.encode(docs, bpe), bpe)
    want = []
    for i, t in DOCS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), bytearray(np.array(ids, "<u4").tobytes()), library.decode(ids, skip_special_tokens=False)))
    assert rows(both, "doc_id", "n_tokens", "ids", "text") == sorted(want, key=repr)
    assert pair_index_bpe.decode(pair_index_bpe.encode(none, bpe), bpe).count() == 0


def test_bpe_round_trip(docs, none, monkeypatch):
    """One worker a task, with a few words remembered and slices of a few texts too."""
    bpe = pair_index_bpe.load(pair_index_bpe.tokenizer_path("word_bpe_49k.json"))
    columns = ("doc_id", "n_tokens", "ids", "text")
    both = pair_index_bpe.round_trip(docs, bpe)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert rows(both, *columns) == rows(pair_index_bpe.decode(pair_index_bpe.encode(docs, bpe), bpe), *columns)
    assert pair_index_bpe.round_trip(none, bpe).count() == 0
    texts = [t or "" for _, t in DOCS]
    whole = bpe.encode(texts)
    monkeypatch.setattr(pair_index_bpe, "REMEMBERED", 3)
    assert [x for t in texts for x in pair_index_bpe.PairIndexBPE(bpe.spec).encode([t])] == whole


def test_huffman_files(spark, docs, none):
    with open(pair_index_bpe.tokenizer_path("byte_bpe_50k.json")) as f:
        spec = f.read()
    path = scratch_path(spark, "test-huffman")
    huffman_ids.write_ids(docs, spec, path, huffman_ids.Settings(block_ids=64))
    back = huffman_ids.read_ids(spark, path).orderBy("start").collect()
    library = Tokenizer.from_str(spec)
    ids = {(i, t): np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for i, t in DOCS}
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in back), key=repr) == sorted(((i, ids[i, t]) for i, t in DOCS), key=repr)
    assert [r["doc_id"] for r in back] == sorted((i for i, _ in DOCS), key=lambda i: -1 if i is None else i)
    sizes = [r["n_tokens"] for r in back]
    assert [r["start"] for r in back] == (np.cumsum(sizes) - sizes).tolist()
    for empty in (none, none.unionByName(none)):
        path = scratch_path(spark, "test-huffman")
        huffman_ids.write_ids(empty, spec, path)
        assert huffman_ids.read_ids(spark, path).count() == 0


def test_pii(docs, none):
    found = {(r["doc_id"]): r["spans"] for r in anchor_pii.find_spans(docs).collect()}
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in found[1]] == [("email", 5, 13, True)]
    assert found[2] == found[3] == [] and len(found) == 14
    assert anchor_pii.find_spans(docs).count() == len(DOCS) and anchor_pii.find_spans(none).count() == 0


def test_near_duplicates(spark, docs, none):
    got = rows(chosen_path.near_duplicates(docs, chosen_path.Settings(words=2)), "doc_id", "n_shingles", "component_id", "kept")
    want = [(1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 29_999, 4, True), (5, 59, 5, True), (6, 59, 5, False), (7, 60, 5, False), (8, 60, 5, False),
            (9, 1, 9, True), (10, 1, 9, False), (11, 0, 11, True), (12, 2, 1, False), (None, 59, None, True), (12, 2, 1, False), (13, 60, 5, False)]
    assert got == sorted(want, key=repr)
    assert chosen_path.near_duplicates(none).count() == 0


def test_one_row_of_each_group_where_ids_repeat(spark):
    """A copy under a repeated id takes no other text with it, sets with the same smallest id are apart, equal rows are one."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdx"}
    near = lambda k: text[k] + " end"
    given = [(3, text["a"]), (5, near("a")), (5, text["b"]), (9, near("b")), (20, text["c"]), (20, text["d"]), (21, near("c")), (22, near("d")),
             (12, text["x"]), (12, text["x"]), (13, near("x")), (14, None), (14, ""), (None, text["a"]), (15, "  ")]
    df = spark.createDataFrame(given, SCHEMA).withColumn("source", F.lit("s"))
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    want = [(3, text["a"]), (5, text["b"]), (20, text["c"]), (20, text["d"]), (12, text["x"]), (14, None), (14, ""), (None, text["a"]), (15, "  ")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_near_duplicates_against_all_pairs(spark):
    """Groups of near copies, chains, blocks of a large group: the same components as comparing all pairs."""
    draw = np.random.default_rng(4)
    texts = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(80)]
        for _ in range(4 + 40 * (g == 0)):
            texts.append(" ".join(w if draw.random() > 0.02 else f"x{draw.integers(1e9)}" for w in words))
    texts += [" ".join(f"r{draw.integers(2_000)}" for _ in range(60)) for _ in range(100)]
    sets = [set(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for s in (chosen_path.Settings(words=2), chosen_path.Settings(words=2, small_node=4, block_rows=8)):
        got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_duplicates(df, s).collect()}
        assert [got[i] for i in range(len(texts))] == label


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (None, 1), (20, 11), (11, 30), (30, 4), *((100, i) for i in range(101, 180))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 20, 11, 30), 1), 8: 8, 9: 8, **dict.fromkeys(range(100, 180), 100)}
    line = spark.range(1, 200).selectExpr("id AS a", "id + 1 AS b")
    assert {r["component"] for r in components(line).collect()} == {1}
    assert components(line.where("a < 0")).count() == 0


def test_line_runs(spark, docs, none):
    line, other = "This line stands in many documents.", "A line of its own, in just two of them."
    data = [(1, f"{line}\nshort\n{other}"), (2, f"  {line.upper()} \nshort\n"), (3, f"x\n{line}\n{line}"), (4, f"{other}\nshort"), (5, None), (6, ""), (3, "x"),
            (None, line), (7, "É" * 25), (8, "É" * 25 + "\t"), (9, "é" * 25), (10, "É" * 25), *((k, f"{k}") for k in range(11, 60))]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"copy": F.lit(1), "lines": F.lit(2), "n_lines": F.lit(3)})
    for s in (line_runs.Settings(), line_runs.Settings(batches=1), line_runs.Settings(batches=9, fanout=3)):
        got = line_runs.without_repeated_lines(df, s)
        assert got.columns == ["doc_id", "text", "copy", "lines", "n_lines", "n_dropped"]
        out = rows(got.where("doc_id < 11 OR doc_id IS NULL"), "doc_id", "text", "n_lines", "n_dropped")
        want = [(1, f"short\n{other}", 3, 1), (2, "short\n", 3, 1), (3, f"x\n{line}\n{line}", 3, 0), (4, f"{other}\nshort", 2, 0), (5, "", 1, 0), (6, "", 1, 0),
                (3, "x", 1, 0), (None, line, 1, 0), (7, "", 1, 1), (8, "", 1, 1), (9, "é" * 25, 1, 0), (10, "É" * 25, 1, 0)]
        assert out == sorted(want, key=repr)
    assert line_runs.without_repeated_lines(none).count() == 0


def test_mixture(spark, none):
    data = [(i, "w " * 10, "large") for i in range(400)] + [(1_000 + i, "w " * 10, None) for i in range(40)] + [(2_000, None, "empty")]
    df = spark.createDataFrame(data, SCHEMA + ", source string").withColumns({"copies": F.lit(7), "block": F.lit(8), "draw": F.lit(9)})
    s = temperature_mix.Settings(repeats=1.5, block_tokens=50)
    sources = {r["source"]: r for r in temperature_mix.plan(df, s).collect()}
    assert sources["large"]["budget"] == 4_000 and abs(sources[""]["budget"] - 600) <= 1
    out = temperature_mix.mixture(df, s)
    assert out.columns == df.columns and {r["copies"] for r in out.collect()} == {7}
    per = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per["large"] == 400 and per["empty"] == 1 and 55 <= per[None] <= 65
    # A target entropy: budgets of a mixture as large as the corpus reach it.
    s = temperature_mix.Settings(entropy=0.8, repeats=100.0, budget=1.0, block_tokens=50)
    budget = [r["budget"] for r in temperature_mix.plan(df, s).collect()]
    p = np.array(budget) / sum(budget)
    assert abs(-(p * np.log(p)).sum() / np.log(2) - 0.8) < 0.01 and abs(sum(budget) - 4_400) <= 1
    assert temperature_mix.mixture(none, s).count() == 0


VECTORS = [(1, [1.0, 0.0]), (2, [0.95, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
           (9, [None, 1.0]), (10, []), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, [-0.0, 1e-30]), (13, [2.0, 0.0]), (50, [1.0, 1.0])]


def test_embedding_groups(spark):
    df = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>").withColumns({"x": F.lit(1), "rep": F.lit(2), "a": F.lit(3)})
    got = rows(collision_projections.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    linked = {1: 3, 2: 3, 4: 3, 13: 3, 3: 1, 12: 1}
    group = {2: 1, 4: 1, 13: 1, 12: 3}
    assert got == sorted(((i, linked.get(i, 0), group.get(i, i), i not in group) for i, _ in VECTORS), key=repr)
    assert collision_projections.near_duplicates(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("settings", [collision_projections.Settings(), collision_projections.Settings(part_rows=8, block_rows=16)])
def test_embedding_links_against_all_pairs(spark, settings):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((700, 32))
    x[:60] = x[0] + 0.3 * draw.standard_normal((60, 32))
    x[60:80] = x[60]
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = collision_projections.near_duplicates(df, settings).orderBy("vec_id").toPandas()
    assert (got.n_links.values <= links.sum(1)).all() and got.n_links.sum() >= 0.97 * links.sum()


def test_top_k(spark):
    df = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>").withColumns({"block": F.lit(1), "v": F.lit(2), "length": F.lit(3)})
    valid = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in VECTORS
             if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for i, q in valid:
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in valid if j != i and len(v) == len(q))[:3]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    for s in (impact_search.Settings(k=3), impact_search.Settings(k=3, block_rows=2, rescore=0)):
        got = rows(impact_search.top_k(df, F.lit(True), s), "query_id", "rank", "vec_id", "score")
        assert got == sorted(want, key=repr)
    assert impact_search.top_k(df.where("vec_id < 0"), F.lit(True)).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "")], "page_id bigint, url string, html string")
    df = df.withColumns({"row": F.lit(1), "text": F.lit("old"), "n_chars": F.lit(5)})
    got = text_density.extract(df)
    assert rows(got, "page_id", "url", "row", "text", "n_chars") == sorted([(1, "u", 1, "a", 1)] * 2 + [(None, None, 1, "", 0), (2, "v", 1, "", 0)], key=repr)
    assert text_density.extract(df.where("page_id < 0")).count() == 0


def test_toxicity(spark, docs, none):
    data = [(i, " ".join(f"w{(i * 7 + j * j) % 90}" for j in range(12)) + (" vilest" if i % 5 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame([*data, (600, None), (601, ""), (None, "vilest"), (0, data[0][1])], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400)] + [(None, 1), (7, None), (10_000, 1), (0, 1)], "doc_id bigint, toxic int")
    model = pu_toxicity.fit(df, labels)
    out = pu_toxicity.score(df, model).collect()
    assert len(out) == 604 and all(0 <= r["score"] <= 1 for r in out)
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 600)
    kept = pu_toxicity.keep(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    untaught = pu_toxicity.fit(df, labels.where("toxic = 0"))
    assert {r["score"] for r in pu_toxicity.score(df, untaught).collect()} == {0.0}
    assert pu_toxicity.score(none, pu_toxicity.fit(none, labels)).count() == 0


def test_held_out_labels_are_not_learned(spark):
    """Flipping the labels of held-out rows changes no score."""
    data = [(i, f"a{i % 50} b{i % 30} " + ("vilest" if i % 5 == 0 else "fine")) for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    held = {i for i, _ in data if zlib.crc32(str(i).encode()) % 4 == 2}
    a = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in data], "doc_id bigint, toxic int")
    b = spark.createDataFrame([(i, int((i % 5 == 0) != (i in held))) for i, _ in data], "doc_id bigint, toxic int")
    assert rows(pu_toxicity.score(df, pu_toxicity.fit(df, a)), "doc_id", "score") == rows(pu_toxicity.score(df, pu_toxicity.fit(df, b)), "doc_id", "score")


def test_stored_tables_live_in_the_checkpoint_folder(spark, docs):
    files = stored(docs.select("doc_id"), "probe").inputFiles()
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert files and all(folder in f for f in files)


def test_pipeline_rejects_what_the_operator_calls_toxic(spark, monkeypatch):
    """A text that scores 0.4 is toxic for operator 1 (from 0.3) and so for the pipeline."""
    at = lambda p: float(np.log(p / (1 - p)))
    model = pu_toxicity.Model(("fair", "bad"), np.array([[at(0.4) - at(0.1), at(0.9) - at(0.1)]]), np.array([at(0.1)]))
    monkeypatch.setattr(pu_toxicity, "fit", lambda docs, labels: model)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: None)
    df = spark.createDataFrame([(1, "good"), (2, "fair"), (3, "bad")], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.toxicity(spark, df, "").collect()] == [1]
