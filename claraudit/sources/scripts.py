"""Listeners that inline scripts add, as rows, and the elements they listen on.

A script is cut into tokens in Arrow batches (comments, strings, templates and regular expressions are told apart), and calls
of addEventListener and assignments of on... properties are read from them with what they are called on: the document, an
element found by id or selector, directly or by a variable, or each of a list. Their selectors meet elements by the joins of
style sheets. Nothing is run: a target that the source doesn't name stays unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claraudit.sources import css
from claraudit.sources.html import CHARS_MADE, ROWS_MADE, attr, few

_JS = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|[=!]==?|.)""", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => == === != !== return".split())
_FINDERS = ("getElementById", "querySelector", "querySelectorAll", "getElementsByClassName", "getElementsByTagName")
_PAIRS = {")": "(", "]": "[", "}": "{"}
Target = tuple[str, str | None]


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, place) of each token that isn't blank or a comment."""
    out, at = [], 0
    while at < len(source):
        if source[at] == "/" and (not out or out[-1][1] in _BEFORE_REGEX) and (m := _REGEX.match(source, at)):
            out.append(("regex", m[0], at))
        else:
            m = _JS.match(source, at)
            if m.lastgroup != "skip":
                out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out


def _partners(toks: list) -> dict[int, int]:
    """Where each bracket closes or opens."""
    out, stack = {}, []
    for i, (kind, x, _) in enumerate(toks):
        if kind == "sign" and x in "([{":
            stack.append(i)
        elif kind == "sign" and x in _PAIRS:
            while stack and toks[stack[-1]][1] != _PAIRS[x]:
                stack.pop()
            if stack:
                out[i] = stack[-1]
                out[stack.pop()] = i
    return out


class _Script:
    def __init__(self, source: str):
        self.source, self.toks = source, tokens(source)
        self.partner = _partners(self.toks)
        self.known: dict[str, Target] = {}
        self.functions: dict[str, str] = {}

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i][1] in texts and self.toks[i][0] != "text"

    def slice(self, i: int, j: int) -> str:
        """The source from token i up to token j."""
        end = self.toks[j][2] if j < len(self.toks) else len(self.source)
        return self.source[self.toks[i][2] : end].strip() if i < len(self.toks) else ""

    def found(self, name: int) -> Target:
        """What a finder's call at token `name` finds."""
        if not (self.is_(name + 1, "(") and name + 2 < len(self.toks) and self.toks[name + 2][0] == "text"):
            return "unknown", None
        word, finder = self.toks[name + 2][1][1:-1], self.toks[name][1]
        return "selector", {"getElementById": "#" + word, "getElementsByClassName": "." + word}.get(finder, word)

    def target(self, i: int) -> Target:
        """What the expression that ends at token i names."""
        if i < 0:
            return "unknown", None
        kind, x, _ = self.toks[i]
        if x in ("]", "}"):
            return "unknown", None
        if x == ")":
            name = self.partner.get(i, 0) - 1
            return self.found(name) if name >= 0 and self.toks[name][1] in _FINDERS else ("unknown", None)
        if kind == "name":
            if x in ("document", "window", "globalThis"):
                return "document", None
            if x in ("body", "documentElement") and self.is_(i - 1, "."):
                return "document", None
            return self.known.get(x, ("unknown", None))
        return "unknown", None

    def learn(self) -> None:
        """Variables that hold elements, parameters that run over lists of them, and functions by name."""
        for i, (kind, x, _) in enumerate(self.toks):
            if kind != "name":
                continue
            if x in _FINDERS and (end := self.partner.get(i + 1)) is not None:
                start = i
                while self.is_(start - 1, ".") and start >= 2 and self.toks[start - 2][0] == "name":
                    start -= 2
                if self.is_(start - 1, "=") and start >= 2 and self.toks[start - 2][0] == "name" and not self.is_(end + 1, "."):
                    self.known[self.toks[start - 2][1]] = self.found(i)
                self._each(end + 1, self.found(i))
            elif x == "function" and i + 1 < len(self.toks) and self.toks[i + 1][0] == "name":
                self._function(self.toks[i + 1][1], i + 2)
            elif self.is_(i + 1, "=") and (self.is_(i + 2, "function", "async", "(") or self.is_(i + 3, "=>")):
                self._function(x, i + 2)
            if x in self.known:
                self._each(i + 1, self.known[x])

    def _each(self, i: int, target: Target) -> None:
        """`.forEach(x => ...)` behind a list: x stands for its elements."""
        if not (self.is_(i, ".") and self.is_(i + 1, "forEach") and self.is_(i + 2, "(")):
            return
        j = i + 3
        while self.is_(j, "function", "(", "async"):
            j += 1
        if j < len(self.toks) and self.toks[j][0] == "name":
            self.known[self.toks[j][1]] = target

    def _function(self, name: str, i: int) -> None:
        """What a function does: its block, or an arrow's expression."""
        j = i
        while j < len(self.toks) and not self.is_(j, "{", ";", "=>"):
            j = self.partner[j] + 1 if self.is_(j, "(") and j in self.partner else j + 1
        if self.is_(j, "=>"):
            j += 1
            if not self.is_(j, "{"):
                self.functions.setdefault(name, self.slice(j, self._argument(j, len(self.toks))))
                return
        if self.is_(j, "{") and j in self.partner:
            self.functions.setdefault(name, self.slice(j, self.partner[j] + 1))

    def body(self, i: int, j: int) -> str:
        """The handler between tokens i and j; a function's name stands for what it does."""
        if j == i + 1 and self.toks[i][0] == "name" and self.toks[i][1] in self.functions:
            return self.functions[self.toks[i][1]]
        return self.slice(i, j)

    def listeners(self) -> Iterator[tuple[Target, str, str]]:
        self.learn()
        for i, (kind, x, _) in enumerate(self.toks):
            if kind != "name" or not self.is_(i - 1, "."):
                if kind == "name" and x == "addEventListener" and (end := self.partner.get(i + 1)) and i + 2 < len(self.toks) and self.toks[i + 2][0] == "text":
                    yield ("document", None), self.toks[i + 2][1][1:-1].lower(), self.body(i + 4, self._argument(i + 4, end))
                continue
            if x == "addEventListener" and (end := self.partner.get(i + 1)) and self.toks[i + 2][0] == "text":
                yield self.target(i - 2), self.toks[i + 2][1][1:-1].lower(), self.body(i + 4, self._argument(i + 4, end))
            elif re.fullmatch(r"on[a-z]+", x) and self.is_(i + 1, "=") and i + 2 < len(self.toks):
                yield self.target(i - 2), x[2:], self.body(i + 2, self._argument(i + 2, len(self.toks)))

    def _argument(self, i: int, end: int) -> int:
        """Where the expression that begins at token i ends."""
        while i < end and not self.is_(i, ",", ";", ")"):
            i = self.partner[i] + 1 if self.is_(i, "(", "[", "{") and i in self.partner else i + 1
        return min(i, end)


def listeners_of(source: str) -> list[tuple[Target, str, str]]:
    """((kind, selector), event, handler's source) of each listener that a script adds; kind: document, selector, unknown."""
    return list(_Script(source).listeners())


LISTENER = f"{css.RULE}, event string, kind string"
_ARROW = pa.schema([*css.ARROW, ("event", pa.string()), ("kind", pa.string())])


def _listeners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page, pos, source in few(batch):
            rows, size = [], 0
            for n, ((kind, selector), event, body) in enumerate(_Script(source).listeners()):
                parts = css.split_selectors(selector) if kind == "selector" else [None]
                for s in parts:
                    steps = css.steps_of(s) if s else None
                    rows.append({"page_id": page, "pos": pos, "rule": n, "selector": s, "steps": steps[0] if steps else None, "weight": 0, "media": [], "applies": True, "declared": [], "css": body, "event": event, "kind": kind})
                    size += len(body)
                    # handlers are whole, and those inside of others repeat their source
                    if len(rows) == ROWS_MADE or size >= CHARS_MADE:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def listeners(els: DataFrame) -> DataFrame:
    """A row for each listener (and selector of a list) of each page's inline scripts; css holds its source."""
    own = els.filter("tag = 'script' and content is not null").filter(attr("src").isNull() & ~F.coalesce(F.lower(attr("type")).rlike("json|template|html"), F.lit(False)))
    return own.select("page_id", "pos", "content").mapInArrow(_listeners, LISTENER)


def handlers(els: DataFrame, added: DataFrame) -> DataFrame:
    """page_id, pos (null: the whole document), event, body, source ('inline' or 'script'): attributes of elements and
    listeners of scripts. els: css.placed() elements, added: listeners()."""
    inline = els.select("page_id", "pos", F.explode(F.map_entries("attrs")).alias("a")).filter(F.col("a.key").rlike("^on[a-z]+$"))
    inline = inline.select("page_id", "pos", F.substr("a.key", F.lit(3)).alias("event"), F.col("a.value").alias("body"), F.lit("inline").alias("source"))
    met = css.matches(els, added).select("page_id", "pos", F.col("sheet").alias("_script"), "rule").distinct()
    own = added.select("page_id", F.col("pos").alias("_script"), "rule", "event", F.col("css").alias("body")).distinct()
    by_element = met.join(own, ["page_id", "_script", "rule"]).select("page_id", "pos", "event", "body", F.lit("script").alias("source"))
    everywhere = added.filter("kind = 'document'").select("page_id", F.lit(None).cast("int").alias("pos"), "event", F.col("css").alias("body"), F.lit("script").alias("source"))
    return inline.unionByName(by_element).unionByName(everywhere)
