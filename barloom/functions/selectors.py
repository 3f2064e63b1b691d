"""Texts, attributes and links of the elements that CSS selectors name, over nested and badly closed markup.

Selectors have type, ``*``, class, id and attribute tests (``=``, ``~=``, ``^=``, ``$=``, ``*=`` or mere presence), the
descendant and child combinators, and lists with commas. Each selector's steps run along as sets while tags open: an
element reaches a step if it passes its tests and the element or some element above it reached the step before, so a
page is read once whatever the selectors, in time that doesn't grow with its depth.

End tags close the nearest open element of their name and all in it; end tags of none are ignored; void elements hold
nothing. Text in script, style and template elements, and comments, is no text. Elements are given in page order.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without content, and those whose text isn't the page's.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
UNREAD = frozenset(["script", "style", "template"])

_STEP = re.compile(r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""")
_WORD = re.compile(r"""(?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|[^\s>\[])+|>""")
_AMPERSAND = re.compile(r"&(?:(#(?:\d+|[xX][0-9a-fA-F]+);)|([a-zA-Z][a-zA-Z0-9]*;))?")
_TESTS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
}


@dataclass
class Step:
    """Tests of one element, and whether the step before must be its parent."""

    child: bool
    tag: str = "*"
    attrs: list[tuple[str, str, str]] = field(default_factory=list)

    def passes(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag not in ("*", tag):
            return False
        return all(name in attrs and (not op or _TESTS[op](attrs[name], value)) for name, op, value in self.attrs)


@functools.lru_cache(4096)
def compiled(selector: str) -> tuple[tuple[Step, ...], ...]:
    """The steps of each alternative; ValueError for what isn't understood."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        steps, child = [], False
        if _WORD.sub("", one).strip():
            raise ValueError(f"selector {selector!r}")
        for word in _WORD.findall(one):
            if word == ">":
                if child or not steps:
                    raise ValueError(f"selector {selector!r}")
                child = True
                continue
            step, at = Step(child), 0
            while at < len(word):
                m = _STEP.match(word, at)
                if not m or (m["tag"] and at):
                    raise ValueError(f"selector {selector!r}")
                if m["tag"]:
                    step.tag = m["tag"].lower()
                elif m["cls"]:
                    step.attrs.append(("class", "~=", m["cls"]))
                elif m["id"]:
                    step.attrs.append(("id", "=", m["id"]))
                else:
                    value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
                    step.attrs.append((m["attr"].lower(), m["op"] or "", value))
                at = m.end()
            steps.append(step)
            child = False
        if child or not steps:
            raise ValueError(f"selector {selector!r}")
        out.append(tuple(steps))
    return tuple(out)


class Reader(HTMLParser):
    """Reads a page once and keeps, for each selector, its elements' attributes and places in the page's text."""

    def __init__(self, selectors: list[str]):
        super().__init__(convert_charrefs=True)
        self.chains = [(n, steps) for n, selector in enumerate(selectors) for steps in compiled(selector)]
        self.found: list[list[list]] = [[] for _ in selectors]
        self.text: list[str] = []
        nothing = [0] * len(self.chains)
        self.open, self.names, self.unread = [("", nothing, nothing, [])], Counter(), 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = {k: v or "" for k, v in attrs}
        _, above, parent, _ = self.open[-1]
        exact, mine = [], {}
        for (n, steps), over, direct in zip(self.chains, above, parent, strict=True):
            reached = 0
            for i, step in enumerate(steps):
                if (not i or (direct if step.child else over) >> (i - 1) & 1) and step.passes(tag, have):
                    reached |= 1 << i
            exact.append(reached)
            if reached >> (len(steps) - 1) & 1 and n not in mine:
                mine[n] = [have, len(self.text), len(self.text)]
                self.found[n].append(mine[n])
        if tag in VOID:
            return
        self.open.append((tag, [a | b for a, b in zip(above, exact, strict=True)], exact, list(mine.values())))
        self.names[tag] += 1
        self.unread += tag in UNREAD

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        while self.names[tag]:
            name, *_, found = self.open.pop()
            self.names[name] -= 1
            self.unread -= name in UNREAD
            for element in found:
                element[2] = len(self.text)
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.text.append(data)

    def read(self, html: str) -> list[list[tuple[dict, str]]]:
        """For each selector, attributes and text of its elements; white space in texts is single blanks."""
        self.feed(html)
        self.close()
        while len(self.open) > 1:
            self.handle_endtag(self.open[-1][0])
        return [[(have, " ".join(" ".join(self.text[a:b]).split())) for have, a, b in elements] for elements in self.found]


def whole_references(html: str) -> str:
    """``html`` in which only character references that end in a semicolon are references; other ampersands are text."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:], html)


def elements(html: str | None, selectors: list[str], bare: bool = True) -> list[list[tuple[dict, str]]]:
    """Attributes and text of the elements of each selector. As in HTML, references may lack their semicolon, unless not ``bare``."""
    html = html or ""
    return Reader(selectors).read(html if bare else whole_references(html))


def map_pages(pages: DataFrame, columns: list[str], ddl: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Rows that ``rows`` makes of each page's ``columns``, in Arrow batches."""
    names = [part.split()[0] for part in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c) for c in columns]
            held = []
            for i in range(batch.num_rows):
                held += rows(*(v[i].as_py() for v in values))
                if len(held) >= 2000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in ddl.split(", ")])
    return pages.select(*columns).mapInArrow(run, ddl)
