"""Alignment, hard negatives and packing against plain programs, on odd rows and on the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tools.check_oracle import rows_of
from trawlframe.llm import certified_packing as packing
from trawlframe.llm import identity_alignment as alignment
from trawlframe.llm import multi_index
from trawlframe.llm.pair_index_bpe import tokenizer_path
from trawlframe.llm.token_ids import BYTE_LETTERS

SF = "/root/testdata/sf0.001"
ODD = [(1, "The cat <|endoftext|> sat </s>."), (1, "The cat sat."), (2, None), (3, ""), (4, " "), (5, "a\x00b▁c"), (6, "日本語 😀 é é"),
       (7, "The cat sat."), (None, "The cat sat."), (8, "wörd " * 3_000), (9, "\n\n  tab\there"), (10, "x" * 5_000), (7, "The cat sat."), (11, "▁")]


@pytest.fixture(scope="module")
def files():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns({"n_a": F.lit("x"), "kind": F.lit(1), "uid": F.lit(None).cast("int")})


def plain_alignment(docs, files):
    """Alignment by one dictionary of ends for each text."""
    a_lib = Tokenizer.from_str(files[0])
    a_lib.encode_special_tokens = True
    b_lib = SentencePieceProcessor(model_proto=files[1])
    code = {c: i for i, c in enumerate(BYTE_LETTERS)}
    out, linked, counts = [], [], Counter()
    for _, text in docs:
        row, links, groups = (0, 0), [], []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            a_bytes = [bytes(code[c] for c in a_lib.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                row = (len(a), len(b))
                at_a, at_b = ({e: k for k, e in enumerate(np.cumsum([len(x) for x in tokens]).tolist())} for tokens in (a_bytes, b_bytes))
                i = j = 0
                for end in sorted(at_a.keys() & at_b.keys()):
                    links.append((a[at_a[end]], b[at_b[end]]))
                    groups.append(",".join(map(str, a[i:at_a[end] + 1])) + "|" + ",".join(map(str, b[j:at_b[end] + 1])))
                    i, j = at_a[end] + 1, at_b[end] + 1
        counts.update(links)
        linked.append(links)
        out.append((*row, len(links), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if row[0] else ""))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter((i, *row[:4], sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), row[4])
                   for (i, _), row, links in zip(docs, out, linked, strict=True))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("chunk", [1, 1 << 25])
def test_alignment_of_odd_texts(odd, files, chunk):
    got = alignment.align(odd, *files, alignment.Settings(chunk_bytes=chunk))
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == plain_alignment(ODD, files)
    assert alignment.align(odd.where("false"), *files).count() == 0


def test_alignment_of_documents(spark, files):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op11_identity_alignment"](spark, SF)
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == plain_alignment(docs, files)


def test_identity_table(files):
    own = alignment.Aligner(*files)
    pairs = [(i, j) for i, j in enumerate(own.same.tolist()) if j >= 0]
    assert len(pairs) > 10_000 and all(own.tokens_a[i] == own.tokens_b[j] for i, j in pairs)


def plain_negatives(rows, k=5):
    """All scores in Python integers; beyond 64 bits the nearest number that fits."""
    rows = [(i, y, [int(np.floor(256.0 * np.float64(c))) for c in x]) for i, y, x in rows
            if i is not None and y is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    out = Counter()
    for own, mine, q in {(i, y, tuple(x)) for i, y, x in rows if i % 10 == 0}:
        scored = sorted((-min(max(sum(a * b for a, b in zip(q, x, strict=True)), 1 - 2 ** 63), 2 ** 63 - 1), i, y) for i, y, x in rows if i != own and len(x) == len(q))
        for p, positive, _ in [t for t in scored if t[2] == mine][:k]:
            window = [(n, i) for n, i, y in scored if y != mine and -80 * p <= -100 * n <= -100 * p][:k]
            out.update((own, positive, rank, i, -p, -n) for rank, (n, i) in enumerate(window, 1))
    return out


def vectors(spark, rows):
    rows = [(i, y, x and [None if c is None else float(c) for c in x]) for i, y, x in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    return df.withColumns({"cell": F.lit("x"), "unit": F.lit(1), "score": F.lit(2), "x": F.lit(None).cast("int")})


def drawn(n, seed, labels=3, dims=6, scale=1.0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(4, dims))
    return [(i, int(draw.integers(labels)), (scale * (middle[i % 4] + 0.3 * draw.normal(size=dims))).tolist()) for i in range(n)]


@pytest.mark.parametrize("unit_rows", [7, 1_000])
def test_hard_negatives_of_odd_vectors(spark, unit_rows):
    rows = drawn(120, 1)
    rows += [(10, 1, rows[0][2]), (10, 1, rows[0][2]), (5, 2, rows[5][2]), (None, 1, rows[1][2]), (200, None, rows[1][2]), (210, 1, None), (220, 1, []),
             (230, 1, [1.0, None, 1, 1, 1, 1]), (240, 1, [1.0, float("nan"), 1, 1, 1, 1]), (250, 1, [float("inf")] * 6), (260, 1, [0.5]), (261, 2, [0.5]),
             (263, 1, [0.5]), (270, 2, [0.0] * 6), (280, 1, [3e6, 1e6, 0, 0, 0, 0]), (281, 1, [2e6, 1e6, 1, 0, 0, 0]), (283, 2, [2e6, 1e6, 0.5, 0, 0, 0]),
             (290, 1, [0, 0, 0, 0, 0, 1e300]), (291, 1, [0, 0, 0, 0, 1, 1e200]), (292, 2, [0, 0, 0, 0, 0, 1e200])]
    got = multi_index.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, multi_index.Settings(unit_rows=unit_rows))
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert Counter(map(tuple, got.select(*names).collect())) == plain_negatives(rows)


def test_hard_negatives_of_nothing_and_of_one_label(spark):
    every = F.col("vec_id") % 10 == 0
    assert multi_index.hard_negatives(vectors(spark, []), every).count() == 0
    assert multi_index.hard_negatives(vectors(spark, drawn(30, 2, labels=1)), every).count() == 0


def test_heap_visits_all_pairs_in_order():
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=7), draw.normal(size=5)
    seen = list(multi_index.heap_order(a, b))
    assert [s for s, _, _ in seen] == sorted((x + y for x in a for y in b), reverse=True) and len({t[1:] for t in seen}) == 35


def test_bounds_hold_and_stop_the_search():
    """Clustered vectors: bounds are never too small, and most cells are left out."""
    v = np.floor(256 * np.array([x for _, _, x in drawn(3_000, 4, dims=16, scale=3.0)]))
    words = multi_index.codebook(v[:, :8], 8, 0), multi_index.codebook(v[:, 8:], 8, 1)
    cell, r1, r2 = multi_index.Books({16: words}).place(v)
    radii = tuple(np.array([r[c == i].max(initial=0) for i in range(8)]) for r, c in ((r1, cell // 8), (r2, cell % 8)))
    counts = np.bincount(cell, minlength=64)
    books = multi_index.Books({16: words}, {16: (np.arange(64), counts, None, radii)})
    unit = multi_index.Unit(books, cell, np.arange(len(v)), np.zeros(len(v), np.int64), v)
    read = []
    inner = unit.scores
    unit.scores = lambda rows, *rest: read.append(rows.stop - rows.start) or inner(rows, *rest)
    for q in v[:20]:
        first, second = books.bounds(q)
        assert (v @ q <= first[cell // 8] + second[cell % 8]).all()
        best = unit.positives(-1, 0, q, -np.inf, 5)
        assert [m for m, _ in best] == np.sort(-(v @ q))[:5].astype(int).tolist()
    assert sum(read) < 0.7 * 20 * len(v)


def test_hard_negatives_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = entry.queries()["op12_multi_index"](spark, SF)
    cursor = con.execute(entry.oracle_sql()["op12_multi_index"])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def least_bins(lengths, capacity):
    """The optimum by search."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1:])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("capacity", [1, 2, 9, 10, 31])
def test_bounds_are_below_the_optimum(capacity):
    draw = np.random.default_rng(capacity)
    for _ in range(60):
        lengths = draw.integers(1, capacity + 1, draw.integers(1, 8))
        bins, offsets = packing.best_fit_decreasing(lengths, capacity)
        assert packing.fewest_bins(lengths, capacity) <= least_bins(lengths.tolist(), capacity) <= bins.max() + 1
        for b in range(bins.max() + 1):
            own = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][own]) - lengths[bins == b][own] == np.sort(offsets[bins == b])).all()
            assert lengths[bins == b].sum() <= capacity
    # Bounds beyond the plain sum: three pieces of six need three sequences of ten.
    assert packing.fewest_bins(np.array([6, 6, 6]), 10) == 3 and packing.fewest_bins(np.array([4, 4, 4, 4, 4]), 11) == 3


def check_packing(rows, docs, spec, capacity, end):
    library, want, sums = Tokenizer.from_str(spec), Counter(), defaultdict(list)
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        sums[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sums.values():
        ends = np.cumsum([n for _, n in sorted(placed)]).tolist()
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(sums)


@pytest.mark.parametrize("part_rows", [2, 1_000])
def test_packing_of_odd_texts(odd, files, part_rows):
    s = packing.Settings(capacity=16, part_rows=part_rows)
    rows = packing.pack(odd, files[0], s).collect()
    used = check_packing(rows, ODD, files[0], 16, 2)
    assert used <= packing.fewest_bins(np.array([r["length"] for r in rows]), 16) + (1 if part_rows > 2 else 5)
    assert packing.pack(odd.where("false"), files[0]).count() == 0


def test_packing_of_documents(spark, files):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = entry.queries()["op13_certified_packing"](spark, SF).collect()
    used = check_packing(rows, docs, files[0], 1024, 2)
    assert used <= packing.fewest_bins(np.array([r["length"] for r in rows]), 1024) + 1


def test_partitions_with_a_gap_exchange(spark, files):
    """Pieces dealt two to a partition leave gaps that one exchange closes."""
    docs = spark.createDataFrame([(i, "a " * (5 if i % 2 else 9)) for i in range(40)], "doc_id bigint, text string")
    apart = packing.pack(docs, files[0], packing.Settings(capacity=16, part_rows=3, rounds=0)).select("sequence_id").distinct().count()
    met = packing.pack(docs, files[0], packing.Settings(capacity=16, part_rows=3, rounds=6)).select("sequence_id").distinct().count()
    assert met <= apart
