"""The per-row and per-batch parts of the operators against plain versions."""

import random
import re
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from trawlframe.llm import anchor_pii, chosen_path, common, huffman_ids, impact_search, pair_index_bpe, pu_toxicity, text_density
from trawlframe.llm.common import merge_edges, row_slices, smallest_of


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    draw, anchors = random.Random(3), anchor_pii.automaton()
    for _ in range(20_000):
        t = "".join(draw.choice("01234567890123456789..@@++ -()ab-é١IBAN%") for _ in range(draw.randrange(1, 60)))
        if draw.random() < 0.3:
            t = re.sub("[^0-9 +-]", "4", t)
        assert [s for s in anchor_pii.spans_of(t, anchors) if s[1] < 4] == plain_spans(t), t


def test_method_adds_spans_behind_schemes_and_cues():
    text = "see https://a.example/x?y=1. IBAN: GB82 WEST 1234 5698 7654 32 and account no. 12345678, myaccount 99999999"
    found = {anchor_pii.KINDS[k]: text[a:b] for a, k, b in anchor_pii.spans_of(text, anchor_pii.automaton())}
    assert found["url"] == "https://a.example/x?y=1" and found["iban"] == "GB82 WEST 1234 5698 7654 32" and found["account"] == "12345678"


def test_spans_of_hostile_texts_take_linear_time():
    anchors, started = anchor_pii.automaton(), time.process_time()
    for t in ("a@" * 200_000, "+1" + " " * 200_000, "1." * 200_000, "1 " * 200_000, "account " * 50_000, "http://" * 50_000):
        anchor_pii.spans_of(t, anchors)
    assert time.process_time() - started < 20


def odd_texts(seed, n=400):
    draw = random.Random(seed)
    some = ["".join(chr(draw.choice([draw.randrange(1, 0x530), draw.randrange(9, 128)])) for _ in range(80)) for _ in range(n)]
    return [*some, "", " ", "<|endoftext|>", "a<|endoftext|>B'S ΑΣ İ ß", "\x1c\x1d a\x85b", "aaaaaaaaaaaaaaaaaaaaaaaa don't I'LL", "日本語 ok", "x" * 5_000]


def test_pair_index_equals_the_library():
    path = pair_index_bpe.tokenizer_path("word_bpe_49k.json")
    own, library = pair_index_bpe.load(path), Tokenizer.from_file(path)
    texts = odd_texts(1)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_words_through_the_library_equal_whole_texts():
    with open(pair_index_bpe.tokenizer_path("byte_bpe_50k.json")) as f:
        spec = f.read()
    texts = odd_texts(2) + ["a" + chr(i) + " " + chr(i) + "1" for i in range(1, 0x260)]
    got = [np.frombuffer(x, "<u4").tolist() for x in huffman_ids.LibraryIds(spec).encode(texts)]
    assert got == [e.ids for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n, bits", [(1, 20), (2, 20), (5, 3), (8, 3), (300, 20), (300, 9), (5_000, 13)])
def test_huffman_round_trip(n, bits):
    draw = np.random.default_rng(n + bits)
    counts = np.maximum(1, (1e6 / np.arange(1, n + 1) ** 1.3)).astype(np.int64)
    draw.shuffle(counts)
    lengths = huffman_ids.code_lengths(counts, bits)
    assert lengths.min() >= 1 and lengths.max() <= bits and (n == 1 or abs((0.5 ** lengths).sum() - 1) < 1e-9)
    ids = np.sort(draw.choice(60_000, n, replace=False))
    code = huffman_ids.Code(ids, lengths, bits)
    texts = [ids[draw.choice(n, m)] for m in (0, 1, 511, 512, 513, 3_000)]
    coded = [code.encode(t, 512) for t in texts]
    back = code.decode([c[0] for c in coded], [c[1] for c in coded], [len(t) for t in texts], 512)
    assert all(np.array_equal(a, b) for a, b in zip(texts, back, strict=True))


def test_code_lengths_are_optimal_where_the_limit_does_not_bind():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 40])
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (counts * huffman_ids.code_lengths(counts, 20)).sum() == cost
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(9, np.int64), 3)


PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<![foo[x]]><p>y", "y"), ("<!--", ""), ("<body", ""), ("a<b", "a"),
    ("<p>a<p>b&amp;&eacute;&#x41; \n c", "a\n\nb&éA c"),
    ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>Some <b>long</b> text here.<p>x<br>y</article><footer>f</footer>", "T\n\nSome long text here.\n\nx y"),
    ("<body><header>Site</header><div class='cookie-notice'>We use cookies, many of them, all the time</div><div id=main><h1>Title</h1>"
     "<div class=entry><p>First paragraph of the text, fairly long.<p>Second paragraph of the text, also long.</div></div>"
     "<div class=sidebar>Sidebar text</div><section id=comments><article class=comment><p>I do not agree at all with any of this.</article></section>",
     "Title\n\nFirst paragraph of the text, fairly long.\n\nSecond paragraph of the text, also long."),
    ("<body class='with-sidebar'><article><section><p>One one one one.</section><section><p>Two two.<p>Three three three three three.</section>"
     "<form>Search<input></form><script>if (a<b) x()</script><style>p{}</style><p>End.</article>",
     "One one one one.\n\nTwo two.\n\nThree three three three three.\n\nEnd."),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert text_density.main_text(page) == text


def test_hostile_pages_end_soon():
    started = time.process_time()
    for page in ("<div>" * 50_000 + "x", "<a " * 100_000, '<a href="x' * 50_000, "<i>" + "<b>" * 50_000 + "</i>" * 50_000, "<li><div>" * 30_000):
        text_density.main_text(page)
    assert time.process_time() - started < 30


def test_pu_learning_finds_the_words():
    draw = random.Random(0)
    words = [f"w{i}" for i in range(300)]

    def text(toxic):
        own = draw.sample(words, 30) + (draw.sample(["vile1", "vile2", "vile3"], 2) if toxic else [])
        return " ".join(own)

    positives = [text(True) for _ in range(200)]
    unlabelled = [text(draw.random() < 0.1) for _ in range(1_000)]
    place = {w: i for i, w in enumerate([*words, "vile1", "vile2", "vile3"])}
    rows = [np.array([place[w] for w in t.split()]) for t in positives + unlabelled]
    weights, biases = pu_toxicity.nnpu(rows, np.arange(1_200) < 200, len(place), 0.1, pu_toxicity.Settings())
    model = pu_toxicity.Model(tuple(place), weights, biases)
    toxic, clean = model.score([text(True) for _ in range(200)]), model.score([text(False) for _ in range(200)])
    assert (toxic > 0.3).mean() > 0.95 and (clean < 0.3).mean() > 0.95
    assert 0 <= model.score([""])[0] < 0.3


def test_shingle_sets():
    hashes = chosen_path.WordHashes()
    made = lambda t, n=2: chosen_path.shingle_set(t, n, hashes).tolist()
    assert made("") == [] == made(" \t\r\n") and len(made("one")) == 1 and made("One") == made("one") != made("one one")
    assert made("É a") != made("é a") and len(made("a b a b a")) == 2 and len(made("a b c d", 5)) == 1


def test_merge_edges_and_smallest():
    labels = merge_edges(np.arange(6), np.array([5, 1, 4]), np.array([3, 3, 2]))
    assert labels.tolist() == [0, 1, 2, 1, 2, 1]
    assert smallest_of(np.array([9, 8, 7, 6, 5, 4]), labels).tolist() == [9, 4, 5, 4, 5, 4]


def test_row_slices_cover_everything_once():
    assert list(row_slices(np.array([5, 5, 20, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(row_slices(np.array([]), 10)) == []


@pytest.mark.parametrize("rescore", [0, 8])
def test_block_search_is_exact(rescore):
    draw = np.random.default_rng(1)
    values = draw.integers(-80, 80, (500, 16))
    values[100:140] = values[7]
    ids = draw.permutation(500)
    values = values.astype(float)
    index = impact_search.BlockIndex(ids, values, impact_search.Settings(rescore=rescore))
    for i in range(0, 200, 7):
        scores = values @ values[i]
        want = sorted((-int(s), int(d)) for s, d in zip(scores, ids, strict=True) if d != ids[i])[:5]
        *got, scored = index.search(int(ids[i]), values[i])
        assert [(-int(s), int(d)) for d, s in zip(*got, strict=True)] == want


def test_proof_leaves_few_rows_to_score():
    """Unstructured vectors, the worst case: still less than a tenth of a block is scored, in every other block less than in the first."""
    draw = np.random.default_rng(2)
    unit = draw.normal(size=(4_000, 64))
    values = np.floor(256 * unit / np.linalg.norm(unit, axis=1, keepdims=True))
    ids, s = np.arange(4_000), impact_search.Settings()
    first, second = (impact_search.BlockIndex(ids[a:a + 2_000], values[a:a + 2_000], s) for a in (0, 2_000))
    for i in range(0, 2_000, 100):
        found, scores, scored = first.search(i, values[i])
        assert scored < 400
        floor = float(scores[-1])
        more, higher, scored = second.search(i, values[i], floor)
        assert scored < 400
        want = values[2_000:] @ values[i]
        assert sorted(higher[higher >= floor].tolist()) == sorted(want[want >= floor].tolist())[-5:]


def test_scores_are_exact_for_any_size():
    values = np.array([[3.0, -5.0], [2.0 ** 40 + 1, 2.0 ** 40 - 3], [1e300, 1.0], [-1e300, 2.0]])
    got = common.integer_scores(values, common.norms_of(values), np.array([2.0 ** 20 + 1, 7.0]), float(common.norms_of(np.array([2.0 ** 20 + 1, 7.0]))))
    exact = [sum(int(a) * b for a, b in zip(v, (2 ** 20 + 1, 7), strict=True)) for v in values]
    assert got.tolist() == [min(max(x, 1 - 2 ** 63), 2 ** 63 - 1) for x in exact]
