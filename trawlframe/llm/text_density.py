"""Main text of HTML pages by composite text density.

For every node of the page's tree: characters per tag, weighed down where links hold the
characters or the tags. The node whose children have the largest sum of densities is the heart of the article;
the smallest density on its path from the body is the threshold for what else stands beside that path.
Elements that are never article text, by their tag, role or a word of their class or
id, are left out beforehand, so they lend no density to the nodes around them.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm.common import table, text_slices
from trawlframe.plans.registry import query

# Element names by what the HTML standard says of them, and cues in the order of the contract's list.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption head html legend option optgroup tbody td tfoot th thead title tr".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("table",),
         "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_TEXT_TAGS = frozenset(
    "nav menu footer aside form script style noscript template title head textarea button select option iframe object svg canvas dialog "
    "input label fieldset audio video noembed noframes xmp map".split())
NO_TEXT_WORDS = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar notice cookie cookies consent banner popup modal "
    "overlay alert ad ads advert adverts advertisement advertising sponsor sponsored promo form search login signup newsletter subscribe "
    "comment comments reply replies disqus share sharing social related recommended recommendations pagination pager toolbar widget".split())
NO_TEXT_ROLES = frozenset("navigation menu menubar banner contentinfo complementary search form dialog alert alertdialog".split())
NEGATED = frozenset("with has no without".split())

TAG_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
TAG_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """The tree of a page: parallel lists with a place for each node, in document order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.cues = ["#root"], [-1], [False]
        self.pieces: list[tuple[int, int, str]] = []  # (node, number of the block of running text, text)
        self._stack, self._places = [0], defaultdict(list)
        self._blocks_open = [0]
        self._block = 0
        self._read(source)
        self.ends = [0] * len(self.tags)
        self._measure()

    # Reading: what no closing tag closes ends with its parent; positions of open elements by name keep every step short.

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self._close_last(("p",), ("table", "td", "th", "button", "caption", "object"))
        if tag in SAME_LEVEL:
            self._close_last(SAME_LEVEL[tag], HOLDS[tag])
        if tag == "body":
            self._close_last(("head",), ())
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.cues.append(self._is_cue(tag, attributes))
        if tag in BLOCKS:
            self._block += 1
        if tag not in VOID:
            place = len(self._stack)
            self._places[tag].append(place)
            self._stack.append(len(self.tags) - 1)
            if tag in BLOCKS:
                self._blocks_open.append(place)

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            tag = self.tags[self._stack.pop()]
            self._places[tag].pop()
            if self._blocks_open[-1] == len(self._stack):
                self._blocks_open.pop()
                self._block += 1

    def _close_last(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Closes the outermost open element of ``tags`` inside the last open one of ``within``."""
        floor = max((self._places[t][-1] for t in within if self._places[t]), default=0)
        open_ones = [p for t in tags for p in self._places[t][-1:] if p > floor]
        if open_ones:
            self._pop_to(min(open_ones))

    def _close(self, tag: str) -> None:
        places = self._places[tag]
        # An inline end tag does not close blocks opened since; those end on their own.
        if places and (tag in BLOCKS or places[-1] > self._blocks_open[-1]):
            self._pop_to(places[-1])

    @staticmethod
    def _is_cue(tag: str, attributes: str) -> bool:
        if tag in NO_TEXT_TAGS:
            return True
        if not attributes or tag in ("html", "body", "main"):
            return False
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                for part in value.split():
                    words = WORDS.findall(CAMEL.sub("-", part).lower())
                    if not NO_TEXT_WORDS.isdisjoint(words) and NEGATED.isdisjoint(words):
                        return True
            elif (name == "role" and value.lower() in NO_TEXT_ROLES or name == "hidden"
                  or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()):
                return True
        return False

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self._stack[-1], self._block, html.unescape(raw) if "&" in raw else raw))

    def _read(self, source: str) -> None:
        at, n, missing = 0, len(source), set()
        while at < n:
            m = TAG_START.search(source, at)
            if not m:
                self._text(source[at:])
                break
            self._text(source[at:m.start()])
            if m[1]:
                end = source.find("-->", m.end() - 2)
                at = n if end < 0 else end + 3
                continue
            end = self._tag_end(source, m.end(), missing)
            if end < 0:
                break  # the page ends within a tag
            at = end + 1
            if m[2]:
                continue
            tag = m[4].lower()
            if m[3]:
                self._close(tag)
                continue
            self._open(tag, source[m.end():end])
            if tag == "br":
                self.pieces.append((self._stack[-1], self._block, " "))
            elif tag in RAW:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                stop = close.start() if close else n
                if tag not in NO_TEXT_TAGS:
                    self._text(source[at:stop])
                at = stop

    @staticmethod
    def _tag_end(source: str, at: int, missing: set[str]) -> int:
        """Place of the > that ends a tag; quotes count after an equals sign, if they are closed at all."""
        while True:
            m = TAG_STOP.search(source, at)
            if not m or m[0] == ">":
                return m.start() if m else -1
            at = m.end()
            if m[0] not in missing and source[max(0, m.start() - 8):m.start()].rstrip().endswith("="):
                close = source.find(m[0], at)
                if close < 0:
                    missing.add(m[0])
                else:
                    at = close + 1

    # Densities

    def _measure(self) -> None:
        n = len(self.tags)
        tags, parents = self.tags, self.parents
        ends = self.ends
        for i in range(n):
            ends[i] = i + 1
        for i in range(n - 1, 0, -1):
            ends[parents[i]] = max(ends[parents[i]], ends[i])
        # A cue on a wrapper of the article itself says nothing: it holds an uncued article or the main heading.
        keeps = [t == "main" or t == "h1" or t == "article" and not c for t, c in zip(tags, self.cues, strict=True)]
        in_article = [False] * n
        for i in range(1, n):
            in_article[i] = in_article[parents[i]] or tags[i] == "article" and not self.cues[i]
        held = keeps[:]
        for i in range(n - 1, 0, -1):
            held[parents[i]] |= held[i]
        gone = [False] * n
        for i in range(1, n):
            cue = self.cues[i] and (tags[i] in NO_TEXT_TAGS or not held[i]) or tags[i] == "header" and not in_article[i]
            gone[i] = gone[parents[i]] or cue
        self.gone = gone
        chars, linked, count, links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parents[i]] or tags[i] == "a"
        for node, _, text in self.pieces:
            if not gone[node]:
                size = len(text.strip())
                chars[node] += size
                if in_link[node]:
                    linked[node] += size
        for i in range(n - 1, 0, -1):
            if gone[i]:
                continue
            p = parents[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            count[p] += count[i] + 1
            links[p] += links[i] + (tags[i] == "a")
        self.body = next((i for i in range(n) if tags[i] == "body"), 0)
        ratio = linked[self.body] / max(1, chars[self.body])
        density = [0.0] * n
        for i in range(n):
            if chars[i] and not gone[i]:
                c, lc, t, lt = chars[i], linked[i], count[i] + 1, links[i] + (tags[i] == "a")
                base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
                density[i] = c / t * math.log1p(c / max(1, lc) * t / max(1, lt)) / base
        self.density, self.chars, self.linked = density, chars, linked
        sums = [0.0] * n
        for i in range(1, n):
            sums[parents[i]] += density[i]
        self.sums = sums

    def regions(self) -> list[tuple[int, int]]:
        """Ranges of nodes whose text is the article, in page order."""
        n = len(self.tags)
        inside = range(self.body, self.ends[self.body]) if self.body else range(n)
        heart = max(inside, key=lambda i: (self.sums[i], -i))
        path = [heart]
        while path[-1] != self.body and self.parents[path[-1]] >= 0:
            path.append(self.parents[path[-1]])
        threshold = min(self.density[i] for i in path)
        on_path = set(path)
        articles = [i for i in path if self.tags[i] in ("article", "main")]
        top = articles[-1] if articles else path[-1]
        out = []
        # From the top of the path down: what stands beside it belongs to the article if it is dense enough; headings, and
        # all within an article element, unless links fill them; text of the path's own nodes belongs too.
        todo = [top]
        children = defaultdict(list)
        for i in range(top + 1, self.ends[top]):
            if self.parents[i] in on_path:
                children[self.parents[i]].append(i)
        while todo:
            node = todo.pop()
            if node == heart:
                out.append((node, self.ends[node]))
                continue
            out.append((node, node + 1))
            for child in children[node]:
                if child in on_path:
                    todo.append(child)
                elif (self.density[child] >= threshold or (articles or self.tags[child] in HEADINGS)
                      and 2 * self.linked[child] < self.chars[child]):
                    out.append((child, self.ends[child]))
        return sorted(out)

    def text(self) -> str:
        if not self.pieces:
            return ""
        wanted = bytearray(len(self.tags))
        for a, b in self.regions():
            wanted[a:b] = b"\x01" * (b - a)
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.pieces:
            if wanted[node] and not self.gone[node]:
                blocks.setdefault(block, []).append(text)
        cleaned = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n\n".join(t for t in cleaned if t)


def main_text(source: str | None) -> str:
    """The article of a page; empty for a null or empty page or one without text."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` without the html column and with text and n_chars (code points), a row for each row.

    A null or empty page has an empty text; broken markup never fails. Columns named text or n_chars are replaced, others kept.
    """
    others = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    kept = pages.select(F.struct(*others).alias("row"), F.col(source).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "html"):
                found = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                                 ["row", "text", "n_chars"])

    return (kept.mapInArrow(work, f"row {kept.schema['row'].dataType.simpleString()}, text string, n_chars bigint")
            .select(*(F.col("row").getField(c).alias(c) for c in others), "text", "n_chars"))


@query("op10_text_density")
def op10_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
