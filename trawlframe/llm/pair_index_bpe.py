"""BPE encoding and decoding over a pair occurrence index.

Texts are cut into words; the distinct words of a batch of rows lie one after the other in one
symbol array. A pair occurrence index maps each pair of neighbouring symbols to
all its positions there. Active pairs are merged in ascending rank, each at all
its positions at once, and the lists of the pairs left and right of a merge are
updated. Any vocabulary file of the ``tokenizers`` library that has a BPE model
over byte-level words with a word-end suffix can be given; it is read on the
driver and travels with the job (a few MB, independent of the data). Classes and lower case of
letters that Unicode has added since version 16 are those of the installed Python and ``regex``.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import table, text_slices
from trawlframe.llm.token_ids import built, ship
from trawlframe.plans.registry import query

#: Unicode White_Space, which the vocabulary's rules call \\s.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Words whose ids are remembered by a Python worker; others are encoded again when they return. Bounds memory, not results.
REMEMBERED = 200_000
#: Bytes of text, about, whose words are encoded together.
SLICE = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder for one vocabulary file's JSON text."""

    def __init__(self, spec: str):
        self.spec = spec

    def __reduce__(self):
        return type(self), (self.spec,)

    @cached_property
    def _model(self) -> dict:
        return json.loads(self.spec)

    @cached_property
    def vocab(self) -> dict[str, int]:
        return self._model["model"]["vocab"]

    @cached_property
    def tokens(self) -> list[str]:
        size = max([*self.vocab.values(), *(t["id"] for t in self._model["added_tokens"])]) + 1
        names = [""] * size
        for name, i in self.vocab.items():
            names[i] = name
        for t in self._model["added_tokens"]:
            names[t["id"]] = t["content"]
        return names

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """Pair of ids, as one number, → (rank, merged id).

        A pair's parts are made by lower ranks, so going through the ranks in
        ascending order once equals the word-by-word rule "always the lowest
        rank, leftmost first". That property is checked here.
        """
        vocab, out, made = self.vocab, {}, {}
        for rank, pair in enumerate(self._model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if max(made.get(left, -1), made.get(right, -1)) > rank:
                raise ValueError(f"merge {pair} uses a symbol of a later merge")
            made[left + right] = min(rank, made.get(left + right, rank))
            out.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        return out

    @cached_property
    def _first(self) -> tuple[list, list]:
        """Ids of a byte inside a word and at its end (None: not in the vocabulary, the byte gives nothing)."""
        end = self._model["model"].get("end_of_word_suffix") or ""
        return ([self.vocab.get(s) for s in byte_symbols()], [self.vocab.get(s + end) for s in byte_symbols()])

    @cached_property
    def _cutters(self):
        special = [t["content"] for t in self._model["added_tokens"]]
        pattern = next(p["pattern"]["Regex"] for p in self._model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", SPACES)  # it only stands in brackets
        return (regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None,
                regex.compile(pattern), regex.compile(f"[{SPACES}]+"))

    @cached_property
    def _known(self) -> dict[str, bytes]:
        return {t["content"]: np.uint32(t["id"]).tobytes() for t in self._model["added_tokens"]}

    def words(self, text: str) -> list[str]:
        """Normalised words of a text, the vocabulary's special tokens among them."""
        special, word, spaces = self._cutters

        def plain(part: str) -> list[str]:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                part = spaces.sub(" ", part).replace("Σ", "σ")  # lower case letter by letter: no final sigma
            return word.findall(part.lower())

        if special is None or not special.search(text):
            return plain(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += plain(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + plain(text[at:])

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, by one pair occurrence index over all of them."""
        inside, last = self._first
        symbols: list[int] = []
        ends = []
        for w in words:
            raw = w.encode("utf-8", "replace")
            symbols += [i for i in map(inside.__getitem__, raw[:-1]) if i is not None]
            if raw and last[raw[-1]] is not None:
                symbols.append(last[raw[-1]])
            ends.append(len(symbols))
        n = len(symbols)
        # Links to the neighbours in the same word; -1 at a word's ends. Removed symbols become -1.
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends:
            if e:
                nxt[e - 1] = -1
            if e < n:
                prv[e] = -1
        merges = self.merges
        where: dict[int, list[int]] = defaultdict(list)
        for i in range(n):
            if nxt[i] >= 0:
                where[symbols[i] << 32 | symbols[i + 1]].append(i)
        active = [(merges[p][0], p) for p in where if p in merges]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            positions = where.pop(pair, None)
            if positions is None:
                continue
            left, right, merged = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
            fresh = set()
            for i in sorted(positions):
                j = nxt[i]
                if symbols[i] != left or j < 0 or symbols[j] != right:
                    continue  # the position has since been merged with a neighbour
                symbols[i], symbols[j] = merged, -1
                nxt[i] = k = nxt[j]
                if k >= 0:
                    prv[k] = i
                    key = merged << 32 | symbols[k]
                    if key in merges:
                        where[key].append(i)
                        fresh.add(key)
                h = prv[i]
                if h >= 0:
                    key = symbols[h] << 32 | merged
                    if key in merges:
                        where[key].append(h)
                        fresh.add(key)
            for key in fresh:
                heapq.heappush(active, (merges[key][0], key))
        ids = np.array(symbols, dtype=np.int64)
        left_of = np.concatenate([[0], np.cumsum(ids >= 0)])
        ids = ids[ids >= 0].astype("<u4")
        cuts = left_of[np.array([0, *ends])]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.words(t) for t in texts]
        known = self._known
        distinct = set().union(*cut)
        new = [w for w in distinct if w not in known]
        found = dict(zip(new, (x.tobytes() for x in self.encode_words(new)), strict=True))
        if len(known) + len(found) <= REMEMBERED:
            known.update(found)
            return [b"".join(map(known.__getitem__, ws)) for ws in cut]
        both = {w: known[w] if w in known else found[w] for w in distinct}
        return [b"".join(map(both.__getitem__, ws)) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the tokens' own strings with a space between, as a vocabulary without a decoder gives."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def load(path: str) -> PairIndexBPE:
    with open(path, encoding="utf-8") as f:
        return PairIndexBPE(f.read())


def _encoded(own: PairIndexBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n_tokens, ids) of batches of (k, t), in runs of rows whose texts take about ``SLICE`` bytes."""
    for whole in batches:
        for batch in text_slices(whole, "t", SLICE):
            ids = own.encode([t or "" for t in batch.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["k", "n_tokens", "ids"])


def _decoded(own: PairIndexBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n_tokens, ids, text) of batches with k and ids."""
    for whole in batches:
        for batch in text_slices(whole, "ids", SLICE):
            rows = [np.frombuffer(x or b"", dtype="<u4") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([len(x) for x in rows], pa.int64()), batch.column("ids"),
                 pa.array([own.decode(x) for x in rows], pa.string())], ["k", "n_tokens", "ids", "text"])


def encode(docs: DataFrame, bpe: PairIndexBPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): ids of every whole text, as a binary of little-endian
    unsigned 32-bit integers.

    A null text counts as empty; an empty one gives no ids. Rows that repeat, null keys included,
    give a row each. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = ship(docs.sparkSession, spec=bpe.spec)
    return (docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
            .mapInArrow(lambda batches: _encoded(built(shared, PairIndexBPE), batches), f"k {kind}, n_tokens bigint, ids binary")
            .withColumnRenamed("k", key))


def decode(encoded: DataFrame, bpe: PairIndexBPE, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, n_tokens, ids, text): ids as :func:`encode` gives them, and the text they decode to. Null ids decode to an empty text."""
    kind = encoded.schema[key].dataType.simpleString()
    shared = ship(encoded.sparkSession, spec=bpe.spec)
    return (encoded.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
            .mapInArrow(lambda batches: _decoded(built(shared, PairIndexBPE), batches), f"k {kind}, n_tokens bigint, ids binary, text string")
            .withColumnRenamed("k", key))


def round_trip(docs: DataFrame, bpe: PairIndexBPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, text): what :func:`decode` gives of what :func:`encode` gives, in one Python worker
    a task: two steps in a row would be two workers, each with a vocabulary of its own."""
    kind = docs.schema[key].dataType.simpleString()
    shared = ship(docs.sparkSession, spec=bpe.spec)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = built(shared, PairIndexBPE)
        return _decoded(own, _encoded(own, batches))

    return (docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
            .mapInArrow(work, f"k {kind}, n_tokens bigint, ids binary, text string").withColumnRenamed("k", key))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; read on the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_bpe_pair_index")
def op9_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    bpe = load(tokenizer_path("word_bpe_49k.json"))
    both = round_trip(table(spark, sf_dir, "documents"), bpe)
    return both.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
