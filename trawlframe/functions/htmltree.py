"""Small per-page helper: one parse, then any number of selectors.

Elements are numbered in document order, so the descendants of an element and
its text are index ranges. CSS selectors and location paths compile to
alternatives of (steps, kind of value, attribute); a step is (axis, tag, predicates). A step takes time
linear in the part of the page it looks at.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# HTML's void elements, and which start tags end an open element.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split())
_ENDED_BY = {"p": _ENDS_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
             "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}
_SCOPES = frozenset("table td th ul ol dl div article section body html nav select".split())
_RAW = frozenset(("script", "style", "template"))


class Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.last = ["#document"], [{}], [-1], [0]
        self.texts, self.text_from, self.text_to = [], [0], [0]
        self._open, self._children = [0], None
        self.error: str | None = None
        try:
            self.feed(html)
            self.close()
        except Exception as e:  # what was read so far stays usable, and other pages are not concerned
            self.error = f"{type(e).__name__}: {e}"
        self._shut(0)

    def parse_marked_section(self, i, report=1):
        """``<![...`` outside of foreign content is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _shut(self, depth: int) -> None:
        while len(self._open) > depth:
            node = self._open.pop()
            self.last[node], self.text_to[node] = len(self.tag) - 1, len(self.texts)

    def handle_starttag(self, tag, attrs):
        for depth in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[depth]]
            if tag in _ENDED_BY.get(name, ()):
                self._shut(depth)
                break
            if name in _SCOPES:
                break
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.parent.append(self._open[-1])
        self.last.append(len(self.tag) - 1)
        self.text_from.append(len(self.texts))
        self.text_to.append(len(self.texts))
        if tag not in VOID:
            self._open.append(len(self.tag) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[depth]] == tag:
                self._shut(depth)
                return

    def handle_data(self, data):
        self.texts.append((self._open[-1], data))

    def text(self, node: int) -> str:
        """Stripped text pieces joined without a separator."""
        own_raw = self.tag[node] in _RAW
        return "".join(t.strip() for owner, t in self.texts[self.text_from[node]:self.text_to[node]]
                       if own_raw or self.tag[owner] not in _RAW)

    def own_texts(self, node: int) -> list[str]:
        return [t for owner, t in self.texts[self.text_from[node]:self.text_to[node]] if owner == node]

    @property
    def children(self) -> list[list[int]]:
        if self._children is None:
            self._children = [[] for _ in self.tag]
            for n in range(1, len(self.tag)):
                self._children[self.parent[n]].append(n)
        return self._children

    def _place(self, node: int, backwards: bool = False) -> int:
        """Place of an element among its siblings, from 1; told once for all siblings."""
        if not hasattr(self, "_places"):
            self._places = [0] * len(self.tag)
            for nodes in self.children:
                for place, n in enumerate(nodes, 1):
                    self._places[n] = place
        place = self._places[node]
        return len(self.children[self.parent[node]]) + 1 - place if backwards else place

    def _compare(self, have: str, op: str, value: str) -> bool:
        return {"=": have == value, "!=": have != value, "~=": value in have.split(), "^=": have.startswith(value), "$=": have.endswith(value),
                "*=": value in have, "|=": have == value or have.startswith(value + "-")}[op]

    def _holds(self, node: int, predicate) -> bool:
        what, *rest = predicate
        if what == "attr":
            name, op, value = rest
            return name in self.attrs[node] and (op == "has" or self._compare(self.attrs[node][name], op, value))
        if what == "tag":
            return self.tag[node] == rest[0]
        if what == "not":
            return not all(self._holds(node, p) for p in rest[0])
        if what == "text":
            return any(self._compare(t, *rest) for t in self.own_texts(node))
        if what == "string":
            return self._compare(self.text(node), *rest)
        step, offset, backwards = rest  # "place": n = step * k + offset for some k >= 0
        n = self._place(node, backwards) - offset
        return n == 0 if step == 0 else n % step == 0 and n // step >= 0

    def _keep(self, nodes: list[int], predicates) -> list[int]:
        """Nodes with one parent that pass the predicates, applied as written; numbers count what is left so far."""
        for p in predicates:
            if p[0] == "nth":
                nodes = nodes[p[1] - 1:p[1]] if p[1] else nodes[-1:]
            else:
                nodes = [n for n in nodes if self._holds(n, p)]
        return nodes

    def _step(self, current: list[int], axis: str, tag: str, predicates) -> set[int]:
        fits = lambda n: tag == "*" or self.tag[n] == tag
        reached: set[int] = set()
        if axis == "parent":
            groups = [[n] for n in {self.parent[n] for n in current if self.parent[n] > 0}]
        elif axis == "descendant":
            by_parent: dict[int, list[int]] = {}
            upto = -1
            for node in sorted(current):  # an element inside an earlier one adds nothing
                for n in range(max(node, upto) + 1, self.last[node] + 1):
                    by_parent.setdefault(self.parent[n], []).append(n)
                upto = max(upto, self.last[node])
            groups = by_parent.values()
        elif axis == "within":
            for node in sorted(current):
                if node not in reached:
                    reached.update(range(node, self.last[node] + 1))
            return reached
        elif axis == "child":
            groups = [self.children[node] for node in current]
        elif axis == "next":
            groups = [self.children[self.parent[n]][self._place(n):][:1] for n in current if n]
        elif any(p[0] == "nth" for p in predicates):
            groups = [self.children[self.parent[n]][self._place(n):] for n in current if n]
        else:  # later siblings: those of the first one hold those of the others
            first: dict[int, int] = {}
            for n in sorted(current):
                if n:
                    first.setdefault(self.parent[n], n)
            groups = [self.children[p][self._place(n):] for p, n in first.items()]
        for group in groups:
            reached.update(self._keep([n for n in group if fits(n)], predicates))
        return reached

    def find(self, steps, context: int = 0) -> list[int]:
        """Elements reached from ``context``, in document order, each once."""
        current = [context]
        for step in steps:
            current = sorted(self._step(current, *step))
        return current

    def nodes(self, rule, context: int = 0) -> list[int]:
        return sorted({n for steps, _, _ in rule for n in self.find(steps, context)})

    def values(self, rule, context: int = 0) -> list[str]:
        """Texts or attribute values a compiled rule selects, in document order; alternatives of one
        element in the order of the rule."""
        out = []
        for place, (steps, kind, name) in enumerate(rule):
            found = self.find(steps, context)
            if kind == "count":
                out.append((-1, place, [str(len(found))]))
            for n in found if kind != "count" else ():
                if kind == "attr":
                    out.append((n, place, [self.attrs[n][name]] if self.attrs[n].get(name) else []))
                elif kind == "own":
                    out.append((n, place, [t.strip() for t in self.own_texts(n)]))
                else:
                    out.append((n, place, [self.text(n)]))
        same = {}
        for n, place, values in sorted(out, key=lambda x: x[:2]):
            same.setdefault((n, rule[place][1:]), values)  # one element by two alternatives of a kind counts once
        return [v for values in same.values() for v in values]


_QUOTED = r"""(?:"[^"]*"|'[^']*')"""
_SIMPLE = re.compile(
    rf"""\s*(?P<link>[>+~])?\s*(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:\#[\w-]+|\.[\w-]+|\[(?:{_QUOTED}|[^\]"'])*\]|:[a-z-]+(?:\((?:{_QUOTED}|[^()"'])*\))?)*)""")
_QUALIFIER = re.compile(
    rf"""\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<value>{_QUOTED}|[^\]"'\s]*))?\s*\]"""
    rf"""|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:{_QUOTED}|[^()"'])*)\))?""")
_COMMA = re.compile(rf"""((?:{_QUOTED}|\((?:{_QUOTED}|[^()"'])*\)|[^,"'(])*)(?:,|$)""")
_LINKS = {None: "descendant", ">": "child", "+": "next", "~": "following"}
_PLACE = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|(\d+))\s*$")


def _unquoted(value: str) -> str:
    return value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value


def _place_predicate(text: str, backwards: bool):
    m = _PLACE.match(text)
    if not m:
        raise ValueError(f"place not supported: {text!r}")
    word, step, sign, offset, plain = m.groups()
    if word:
        return ("place", 2, 1 if word == "odd" else 0, backwards)
    if plain:
        return ("place", 0, int(plain), backwards)
    step = int(step + "1" if step in ("", "+", "-") else step)
    return ("place", step, int((sign or "+") + (offset or "0")), backwards)


def _qualifiers(text: str) -> list:
    out, at = [], 0
    for m in _QUALIFIER.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        if m["id"]:
            out.append(("attr", "id", "=", m["id"]))
        elif m["cls"]:
            out.append(("attr", "class", "~=", m["cls"]))
        elif m["attr"]:
            out.append(("attr", m["attr"].lower(), m["op"] or "has", _unquoted(m["value"] or "")))
        elif m["pseudo"] in ("first-child", "last-child") and m["arg"] is None:
            out.append(("place", 0, 1, m["pseudo"] == "last-child"))
        elif m["pseudo"] in ("nth-child", "nth-last-child") and m["arg"]:
            out.append(_place_predicate(m["arg"], m["pseudo"] == "nth-last-child"))
        elif m["pseudo"] == "not" and m["arg"]:
            one = _SIMPLE.fullmatch(m["arg"].strip())
            if not one or one["link"]:
                raise ValueError(f"selector not supported: {text!r}")
            out.append(("not", [*([("tag", one["tag"].lower())] if one["tag"] and one["tag"] != "*" else []), *_qualifiers(one["rest"])]))
        else:
            raise ValueError(f"selector not supported: {text!r}")
    if at != len(text):
        raise ValueError(f"selector not supported: {text!r}")
    return out


def _alternatives(text: str, separator: re.Pattern) -> list[str]:
    out, at = [], 0
    while at <= len(text):
        m = separator.match(text, at)
        if not m:
            raise ValueError(f"rule not supported: {text!r}")
        out.append(m[1])
        if m.end() == len(text) and not m[0].endswith((",", "|")):
            break
        at = m.end()
    return out


def compile_css(selector: str):
    """``tag#id.class[attr=v]:not(…):nth-child(…) > child + next ~ later descendant, other``, each with an optional ``::text``
    or ``::attr(name)`` at its end; the last one's holds for those without."""
    rule = []
    for one in _alternatives(selector, _COMMA):
        one, kind, name = one.strip(), None, None
        ending = re.search(r"::(?:(text)|attr\(([^)]*)\))\s*$", one)
        if ending:
            kind, name = ("text", None) if ending[1] else ("attr", ending[2].strip().lower())
            one = one[:ending.start()].rstrip()
        steps, at = [], 0
        while at < len(one):
            m = _SIMPLE.match(one, at)
            if m.end() == at or not (m["tag"] or m["rest"]) or not steps and m["link"] in ("+", "~"):
                raise ValueError(f"selector not supported: {selector!r}")
            steps.append((_LINKS[m["link"]], (m["tag"] or "*").lower(), tuple(_qualifiers(m["rest"]))))
            at = m.end()
        if not steps:
            raise ValueError(f"selector not supported: {selector!r}")
        rule.append((tuple(steps), kind, name))
    last = rule[-1][1:] if rule[-1][1] else ("text", None)
    return tuple((steps, *((kind, name) if kind else last)) for steps, kind, name in rule)


_BAR = re.compile(rf"""((?:{_QUOTED}|[^|"'])*)(?:\||$)""")
_STEP = re.compile(
    rf"""(//?)(following-sibling::)?(@[\w-]+|text\(\)|\.\.|\*|[A-Za-z][\w-]*)((?:\[(?:{_QUOTED}|[^\]"'])*\])*)""")
_BRACKET = re.compile(rf"""\[((?:{_QUOTED}|[^\]"'])*)\]""")
_AND = re.compile(rf"""((?:{_QUOTED}|(?!\sand\s)[^"'])*)(?:\sand\s|$)""")
_SUBJECT = r"(?:@(?P<attr>[\w-]+)|(?P<text>text\(\))|(?P<dot>\.))"
_TEST = re.compile(
    rf"""\s*(?:(?P<n>\d+)|(?P<end>last\(\))|position\(\)\s*=\s*(?:(?P<pn>\d+)|(?P<pend>last\(\)))"""
    rf"""|(?P<fn>contains|starts-with)\(\s*{_SUBJECT}\s*,\s*(?P<part>{_QUOTED})\s*\)|(?P<neg>not\()?"""
    rf"""{_SUBJECT.replace("<attr>", "<attr2>").replace("<text>", "<text2>").replace("<dot>", "<dot2>")}\s*(?:(?P<op>!?=)\s*(?P<value>{_QUOTED}))?(?(neg)\)))\s*""")


def _tests(raw: str, path: str) -> list:
    """Predicates of a step in the order in which they are written."""
    out = []
    for bracket in _BRACKET.findall(raw):
        parts = [x for x in _alternatives_and(bracket)]
        numbers = [_TEST.fullmatch(x) for x in parts]
        if not all(numbers) or len(parts) > 1 and any(m["n"] or m["end"] or m["pn"] or m["pend"] for m in numbers):
            raise ValueError(f"path not supported: {path!r}")
        for m in numbers:
            if m["n"] or m["pn"]:
                if not int(m["n"] or m["pn"]):
                    raise ValueError(f"path not supported: {path!r}")
                out.append(("nth", int(m["n"] or m["pn"])))
            elif m["end"] or m["pend"]:
                out.append(("nth", 0))
            else:
                attr, text = m["attr"] or m["attr2"], m["text"] or m["text2"]
                op = {"contains": "*=", "starts-with": "^="}[m["fn"]] if m["fn"] else m["op"] or "has"
                value = _unquoted(m["part"] or m["value"] or "")
                if not attr and op == "has":
                    raise ValueError(f"path not supported: {path!r}")
                test = ("attr", attr.lower(), op, value) if attr else ("text" if text else "string", op, value)
                out.append(("not", [test]) if m["neg"] else test)
    return out


def _alternatives_and(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _AND.match(text, at)
        out.append(m[1])
        at = m.end() if m.end() > at else len(text) + 1
    return out


def compile_xpath(path: str):
    """``//tag[@a='v'][2]/child/..//*[contains(@b,'w') and not(@c)]/text()``, ``…/@attr``, ``//text()``, ``following-sibling::tag``,
    ``last()``, ``position()=n``, ``starts-with``, ``text()='v'``; ``count(…)`` gives a number; ``|`` joins paths."""
    rule = []
    for one in _alternatives(path, _BAR):
        one, kind, name = one.strip(), "text", None
        counted = re.fullmatch(r"count\((.*)\)", one, re.S)
        if counted:
            one, kind = counted[1].strip(), "count"
        one = one[1:] if one.startswith(("./", ".//")) else one
        steps, at = [], 0
        while at < len(one):
            m = _STEP.match(one, at)
            if not m or kind in ("attr", "own"):
                raise ValueError(f"path not supported: {path!r}")
            axis, sibling, test, raw = m.groups()
            at = m.end()
            if test[0] == "@" or test == "text()":
                if raw or counted or sibling:
                    raise ValueError(f"path not supported: {path!r}")
                if axis == "//":
                    steps.append(("within", "*", ()))
                kind, name = ("attr", test[1:].lower()) if test[0] == "@" else ("own", None)
                continue
            if sibling and axis == "//":
                steps.append(("within", "*", ()))
            step = "following" if sibling else "parent" if test == ".." else "child" if axis == "/" else "descendant"
            if test == ".." and axis == "//":
                steps.append(("within", "*", ()))
            steps.append((step, "*" if test == ".." else test.lower(), tuple(_tests(raw, path))))
        if not steps:
            raise ValueError(f"path not supported: {path!r}")
        rule.append((tuple(steps), kind, name))
    return tuple(rule)


def compile_rule(selector: str, selector_type: str):
    compilers = {"css": compile_css, "xpath": compile_xpath}
    if selector_type.lower() not in compilers:
        raise ValueError(f"selector type not supported: {selector_type}")
    return compilers[selector_type.lower()](selector)
