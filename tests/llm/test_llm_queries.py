"""The registered queries on the smallest tables: against their SQL, or against brute force."""

import hashlib
import re
import subprocess
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from test_llm_helpers import plain_spans
from tools.check_oracle import TABLES, rows_of
from trawlframe.llm.anchor_pii import KINDS
from trawlframe.llm.common import merge_edges, smallest_of
from trawlframe.llm.pair_index_bpe import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


def result(spark, prefix):
    name = next(n for n in entry.queries() if n.startswith(prefix))
    return entry.queries()[name](spark, SF)


@pytest.mark.parametrize("prefix", ["op5_", "op7_", "op8_"])
def test_same_as_sql(spark, con, prefix):
    name = next(n for n in entry.queries() if n.startswith(prefix))
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_op1(spark, docs):
    got = result(spark, "op1_").collect()
    assert sorted(r["doc_id"] for r in got) == list(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_op1_on_held_out_rows(spark):
    """Held-out accuracy on a larger table."""
    sf = "/root/testdata/sf0.1"
    name = next(n for n in entry.queries() if n.startswith("op1_"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = entry.queries()[name](spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.toxic == 1).sum() > 0.9 and hit / (held.predicted == 1).sum() > 0.7


def test_op2(spark, docs):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, start = {}, 0
    for i, t in docs.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, "op2_").collect()} == want


def test_op3(spark, docs):
    for r in result(spark, "op3_").collect():
        spans = plain_spans(docs[r["doc_id"]])
        listed = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS[:4]] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in KINDS[:4]] == listed


def test_op4(spark, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    groups = smallest_of(np.array([i for i, _ in rows]), merge_edges(np.arange(len(rows)), *np.nonzero(links)))
    got = result(spark, "op4_").orderBy("vec_id").toPandas()
    assert got.n_links.tolist() == links.sum(1).tolist() and got.component_id.tolist() == groups.tolist()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def test_op6(spark, docs):
    sets = [shingles(t, 2) for t in docs.values()]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    ids = np.array(list(docs))
    groups = smallest_of(ids, merge_edges(np.arange(len(ids)), *(np.array(x, int) for x in zip(*pairs, strict=True)))) if pairs else ids
    got = result(spark, "op6_").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got] == [
        (i, len(s), g, i == g) for i, s, g in zip(ids.tolist(), sets, groups.tolist(), strict=True)]


def test_op9(spark, docs):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result(spark, "op9_").collect()} == want


def test_op10(spark, con):
    """These pages hold their article in one element: its headings and paragraphs are the text."""
    import html

    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    got = result(spark, "op10_").collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pipeline(spark, docs):
    """Each stage on what its predecessor kept, with its decisions checked by plain code."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = df.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(stage(spark, df, SF).toPandas())
        kept[name] = [r.asDict() for r in df.collect()]
        assert df.columns == columns or name == "encoding"
    ids = {n: {r["doc_id"] for r in rows} for n, rows in kept.items()}
    assert ids["toxicity"] <= set(docs) and all(r["text"] == docs[r["doc_id"]] for r in kept["toxicity"])
    assert ids["line_dedup"] == ids["toxicity"] and all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in kept["line_dedup"]}
    alike = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(alike(a, b) for a in ids["near_dedup"] for b in ids["near_dedup"] if a < b)
    assert all(any(alike(a, b) for b in sets if b < a) for a in ids["line_dedup"] - ids["near_dedup"])
    assert ids["mixing"] == ids["near_dedup"] == ids["encoding"] and len(kept["encoding"]) == len(kept["mixing"])
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in kept["encoding"])
    assert entry.queries()["pipeline"](spark, SF).count() == len(kept["encoding"])


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.__file__).parent
    found = subprocess.run(["grep", "-rlE", r"trawlframe[. ]+(import )?llm|corpus_pipeline", "--include=*.py", "."], cwd=root, capture_output=True, text=True).stdout
    assert all(f.startswith(("./trawlframe/llm/", "./tests/llm/")) or f in ("./__spark_entry__.py", "./corpus_pipeline.py") for f in found.split())
