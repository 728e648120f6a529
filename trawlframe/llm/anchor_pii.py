"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes
and identifier cues. Deterministic local parsers expand each anchor to the left and right,
and validate what they get. Every parser goes on behind what it has read, so a
text takes time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import table, text_slices
from trawlframe.plans.registry import query

# Kinds in the order in which spans of the same start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE_KINDS = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
AFTER_CUE = re.compile(r"(?:[ \t]{0,2}(?:number|no\.?|nr\.?|#|:|=|is)){0,3}[ \t]{0,2}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}(?![0-9])")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in DIGITS)]:
        found.add_word(word, (kind, 1))
    for words, kind in ((SCHEMES, "scheme"), (CUES, "cue")):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted; positions in code points."""
    out = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (kind, length) in anchors.iter(text):
        at = last - length + 1
        if kind == "0":
            if at >= ip_end:
                ip_end = _addresses(text, at, out)
            if at >= card_end:
                m = SPACED.match(text, at)
                card_end = m.end() if m else at + 1
                if m and m.end() - at >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, m.end()))
        elif kind == "@":
            m = DOMAIN.match(text, at + 1)
            if m:
                start = at
                while start > email_end and text[start - 1] in LOCAL_PART:
                    start -= 1
                if start < at:
                    out.append((start, 0, m.end()))
                    email_end = m.end()
        elif kind == "+":
            m = PHONE.match(text, at) if at >= phone_end else None
            if m:
                phone_end = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, phone_end))
        elif kind == "scheme":
            m = URL_REST.match(text, at + length) if at >= url_end else None
            if m:
                url_end = m.end()
                end = at + len(text[at:url_end].rstrip(".,;:!?)]"))
                if end > at + length:
                    out.append((at, 4, end))
        elif at >= account_end and not (at and text[at - 1].isalnum()):
            account_end = max(account_end, _account(text, at + length, out))
    return sorted(out)


def _addresses(text: str, at: int, out: list) -> int:
    """IP addresses in the dotted numbers at ``at``, taken four by four; the position behind them."""
    region = DOTTED.match(text, at)
    parts = region[0].split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k:k + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
            out.append((at, 1, end))
        at = end + 1
    return region.end()


def _account(text: str, at: int, out: list) -> int:
    """An IBAN or account number that follows a cue ending at ``at``; the position up to which was read."""
    start = AFTER_CUE.match(text, at).end()
    m = IBAN.match(text, start)
    if m:
        # The pattern may run on into the next word: the longest prefix with valid check digits is the number.
        for end in range(m.end(), start + 14, -1):
            if text[end - 1] != " " and iban_valid(text[start:end]):
                out.append((start, 5, end))
                return end
    m = ACCOUNT.match(text, start)
    if m:
        out.append((start, 6, m.end()))
        return m.end()
    return at


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): personal data in every whole text, as an array of (kind, start, end, base)
    in order of start, then of KINDS; code points, end exclusive.

    ``base`` marks the four base kinds; URLs behind a scheme, IBANs and account numbers behind a cue are
    added by the method and never displace a base span. A null or empty text has no
    spans (an empty array). Rows that repeat, null keys included, give a row each; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        names = pa.array(KINDS)
        for whole in batches:
            for batch in text_slices(whole, "t", 8 << 20):
                found = [spans_of(t, anchors) if t else [] for t in batch.column("t").to_pylist()]
                flat = np.array([s for spans in found for s in spans], dtype=np.int32).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [names.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2]), pa.array(flat[:, 1] < 4)],
                    ["kind", "start", "end", "base"])
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(offsets), spans)], ["k", "spans"])

    return (docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
            .mapInArrow(work, f"k {kind}, spans array<struct<kind: string, start: int, end: int, base: boolean>>")
            .withColumnRenamed("k", key))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_anchor_pii")
def op3_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, a digest of the base spans, and all spans of every document."""
    found = find_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
