"""Token ids by public tokenizers, shared by the operators that only need the ids."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import cached_property
from typing import Any

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession


def ship(spark: SparkSession, **plain: Any) -> Broadcast:
    """A broadcast of plain values (text, bytes, numbers, arrays). Broadcasts name classes by their module, which
    workers need not have; so workers build objects themselves, with ``built``."""
    return spark.sparkContext.broadcast(plain)


def built(shared: Broadcast, make: Callable[..., Any]) -> Any:
    """``make(**values)`` of a shipped broadcast, made once for each Python worker."""
    values = shared.value
    if "_built" not in values:
        values["_built"] = make(**values)
    return values["_built"]


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


BYTE_LETTERS = _byte_letters()
SPACE_LETTER = BYTE_LETTERS[32]


class LibraryIds:
    """Ids of texts by the ``tokenizers`` library for a byte-level BPE vocabulary given as its file's JSON text.

    Byte-level rules cut a text into words before any merge, so the library's ids of a text are those of its
    words one after the other. Texts in basic and extended Latin letters without a special token are cut here, and their
    distinct words go through the library's merge model; all other texts go through the library whole. ``plain_special``: strings
    of special tokens in a text are text like any other.
    """

    #: Words remembered by a Python worker; bounds memory, not results.
    REMEMBERED = 500_000
    # The byte-level cutting rule, its classes written out for characters below U+0250.
    LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
    CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    OTHER = re.compile("[ɐ-\U0010ffff]")

    #: To the byte-level letters, from bytes read as Latin-1.
    MAPPED = dict(enumerate(BYTE_LETTERS))

    def __init__(self, spec: str, plain_special: bool = False, width: int = 4):
        self.spec, self.plain_special, self.kind = spec, plain_special, f"<u{width}"

    @cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.spec)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = self.plain_special
        return made

    @cached_property
    def special(self) -> re.Pattern | None:
        names = [] if self.plain_special else [t.content for t in self.library.get_added_tokens_decoder().values()]
        return re.compile("|".join(map(re.escape, names))) if names else None

    @cached_property
    def known(self) -> dict[str, bytes]:
        model, code = self.library.model, {"<u2": "H", "<u4": "I"}[self.kind]

        class Known(dict):
            """Ids of words; a word not met before is remembered while there is room."""

            def __missing__(known, word: str) -> bytes:  # noqa: N805
                if word.isascii() and (bare := word.removeprefix(" ")).isalnum():
                    mapped = word if bare is word else SPACE_LETTER + bare
                else:
                    mapped = word.encode().decode("latin-1").translate(self.MAPPED)
                ids = array(code, [t.id for t in model.tokenize(mapped)])
                if sys.byteorder == "big":
                    ids.byteswap()
                ids = ids.tobytes()
                if len(known) < self.REMEMBERED:
                    known[word] = ids
                return ids

        return Known()

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``width`` bytes."""
        out: list[bytes | None] = [None] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            odd = not t.isascii() and self.OTHER.search(t) or self.special and self.special.search(t)
            (other if odd else plain).append(i)
        ids_of = self.known.__getitem__
        for i in plain:
            out[i] = b"".join(map(ids_of, self.CUT.findall(texts[i])))
        for i, ids in zip(other, self._library_ids([texts[i] for i in other]), strict=True):
            out[i] = ids
        return out
