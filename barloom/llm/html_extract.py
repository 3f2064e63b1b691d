"""Main text of HTML pages: site templates go by recurrence, what recurs too rarely goes by name.

Each page is read into nested elements. Every element's subtree is hashed twice: with its text, and as a shape of tags and
classes without text (equal neighbours counted once, digits left out of names), since menus and adverts keep their shape
while their words change. Spark counts, per host, on how many different pages a subtree occurs, so that copies of a page
aren't recurrence, and which place in the page (the path of tags and classes) holds most of the host's text: its main
container. Subtrees whose text recurs on a large share of a host's pages are template and are deleted; inside the
article or main container only those on most pages, so that passages which several articles share stay. Block elements
outside the main container whose shape recurs are template too; headings and paragraphs never go by shape.

Names (tags, classes and roles of furniture, article and main elements) decide on hosts with too few pages and remove
what recurrence left; ``named=False`` switches them off.

Defined cases: null html is an empty page with the text ""; a page without the host's main container loses nothing by
shape; a page without an article or main element is taken whole; unclosed tags end where their parent ends; pages with a
null or odd url form one host ""; pages of a host with equal html count as one; other columns than url and html pass
through (internal ones start with ``_h_``).
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, spread_join

#: A template recurs on at least so many different pages, and on this share of its host's pages: anywhere, inside an article.
PAGES, SHARE, ARTICLE_SHARE = 8, 0.1, 0.5
#: A main container stands on this share of the host's pages and holds this share of their text.
MAIN_PAGES, MAIN_TEXT = 0.5, 0.6
#: Hosts with more rows than HOT, or than 1 in HOTS of all, are dealt over several tasks when templates are joined.
HOT, HOTS = 4096, 8192

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"br", "option", "p", "body", "html"}
_FURNITURE = frozenset("head script style noscript template nav footer aside form button select textarea input iframe svg canvas object menu dialog label".split())
_FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_UNSEEN = frozenset("head script style noscript template".split())
#: Block elements that hold the text itself, and never go by shape.
_TEXTUAL = frozenset("html body article main p h1 h2 h3 h4 h5 h6 pre blockquote br hr".split())
_DIGITS = re.compile(r"[0-9]+")


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _name(tag: str, attrs: str) -> str:
    """The tag and its class, id and role without digits."""
    found = [f"{m[1].lower()}={_DIGITS.sub('', m[2] or m[3] or m[4] or '')}" for m in _ATTR.finditer(attrs)] if "=" in attrs else ()
    return " ".join([tag, *sorted(found)])


class _Element:
    __slots__ = ("tag", "inside", "dropped", "blocks", "run", "parts", "name", "slot", "shapes", "chars", "main", "holds", "headed")

    def __init__(self, tag: str, inside: bool, dropped: bool, blocks: int, run: int, attrs: str, slot: int = 0, main: bool = False):
        self.tag, self.inside, self.dropped, self.blocks, self.run, self.parts = tag, inside, dropped, blocks, run, [tag, attrs]
        self.name, self.shapes, self.chars, self.main, self.holds, self.headed = _name(tag, attrs), [], 0, main, False, False
        self.slot = hash((slot, _mark(self.name)))


def _furniture(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _FURNITURE or (tag == "header" and not inside):
        return True
    for m in _ATTR.finditer(attrs) if "=" in attrs else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in _FURNITURE_ROLES:
                return True
        elif tag not in ("html", "body", "article", "main") or "comment" in value:
            if not _FURNITURE_WORDS.isdisjoint(_SPLIT.split(value)):
                return True
    return False


class Page:
    """Reads a page once. ``seen`` has its subtrees' hashes, ``slots`` its places; ``text`` its main text without ``templates``."""

    def __init__(self, html: str, templates: dict[int, float] | None = None, main_slot: int | None = None, named: bool = True):
        self.templates, self.main_slot, self.named, self.seen = templates or {}, main_slot, named, set()
        self.slots: dict[int, tuple[int, int, bool]] = {}  # depth, characters, whether the page's heading is in it
        self.title, self.found_main = "", False
        self.blocks: list[str] = []
        self.shaped: list[bool] = []  # blocks in elements whose shape is template
        self.main: list[tuple[int, int]] = []
        self.run: list[str] = []
        self.stack = [_Element("#page", False, False, 0, 0, "")]
        at = 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self.add(html[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                else:
                    self.start(tag, m[3])
                    if tag in _RAW and not m[3].endswith("/"):
                        stop = _RAW[tag].search(html, at)
                        self.add(html[at : stop.start()])
                        if tag == "title":
                            self.title = " ".join(entities.unescape(html[at : stop.start()]).split())
                        at = stop.end()
                        self.end(tag)
        if at < len(html):
            self.add(html[at:])
        while len(self.stack) > 1:
            self.close()
        self.flush()
        self.total = self.stack[0].chars

    def add(self, raw: str) -> None:
        top = self.stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        top.parts.append(text)
        if not top.dropped or top.tag not in _UNSEEN:
            size = len(text.strip())
            top.chars += size
            if size and (not top.shapes or top.shapes[-1]):
                top.shapes.append(0)
        if not top.dropped:
            self.run.append(text)

    def flush(self) -> None:
        if self.run:
            if text := " ".join("".join(self.run).split()):
                self.blocks.append(text)
                self.shaped.append(False)
            self.run.clear()

    def start(self, tag: str, attrs: str) -> None:
        if tag in _VOID:
            self.stack[-1].parts.append(f"<{tag}>")
            if tag in _BLOCK:
                self.flush()
            return
        closes = _CLOSES.get(tag, {"p"} if tag in _ENDS_P else ())
        while closes and self.stack[-1].tag in closes:
            self.close()
        if closes and any(e.tag == "p" for e in self.stack[-6:]) and "p" in closes:  # a p left open below inline elements
            while any(e.tag == "p" for e in self.stack[-6:]):
                self.close()
        if tag in _BLOCK:
            self.flush()
        top = self.stack[-1]
        inside = top.inside or tag in ("article", "main")
        dropped = top.dropped or tag in _UNSEEN or (self.named and _furniture(tag, attrs, top.inside))
        e = _Element(tag, inside, dropped, len(self.blocks), len(self.run), attrs, top.slot, top.main)
        if e.slot == self.main_slot:
            e.main = e.holds = self.found_main = True
        self.stack.append(e)

    def end(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                while len(self.stack) > depth:
                    self.close()
                return
            if self.stack[depth].tag in ("article", "main", "body", "td", "table") and tag not in ("html", "body", "article", "main", "table", "tr"):
                return

    def close(self) -> None:
        e = self.stack.pop()
        if e.tag in _BLOCK:
            self.flush()
        mark, above = _mark("\0".join(e.parts)), self.stack[-1]
        above.parts.append(f"<{mark}>")
        shape = _mark(f"{e.name}{e.shapes}")
        if not above.shapes or above.shapes[-1] != shape:
            above.shapes.append(shape)
        above.chars, above.holds = above.chars + e.chars, above.holds or e.holds
        if e.tag in _BLOCK and e.chars:
            if e.tag in ("h1", "h2") and self.title and len(self.blocks) > e.blocks:
                e.headed = self.blocks[e.blocks][:30] in self.title
            above.headed = above.headed or e.headed
            if e.tag not in _TEXTUAL or e.tag in ("article", "main"):
                self.slots[e.slot] = (-1, 0, False) if e.slot in self.slots else (len(self.stack), e.chars, e.headed)
        if e.dropped:
            return
        has_text = len(self.blocks) > e.blocks or len(self.run) > e.run
        if has_text and e.tag not in ("html", "body", "article", "main") and (e.tag in _BLOCK or not e.inside):
            self.seen.add(mark)
            share = self.templates.get(mark, 0.0)
            if share >= ARTICLE_SHARE or (share and not e.inside and not e.main):
                del self.blocks[e.blocks :], self.shaped[e.blocks :]
                del self.run[e.run if len(self.run) >= e.run else 0 :]
                self.main = [(a, min(b, e.blocks)) for a, b in self.main if a < e.blocks]
        if has_text and e.tag in _BLOCK and e.tag not in _TEXTUAL:
            self.seen.add(shape)
            if shape in self.templates and not e.main and not e.holds:
                self.shaped[e.blocks :] = [True] * (len(self.blocks) - e.blocks)
        if self.named and e.tag in ("article", "main") and not self.stack[-1].inside:
            self.main.append((e.blocks, len(self.blocks)))

    def text(self) -> str:
        kept = [not (x and self.found_main) for x in self.shaped]
        if any(b > a for a, b in self.main):
            return " ".join(x for a, b in self.main for x, k in zip(self.blocks[a:b], kept[a:b], strict=True) if k)
        return " ".join(x for x, k in zip(self.blocks, kept, strict=True) if k)


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, named: bool = True) -> DataFrame:
    """One row per host: _h_host, _h_rows, _h_marks and _h_shares (null without templates), _h_main (null without container).

    Per host there are at most 1 / SHARE times as many marks as a page has elements.
    """

    def subtrees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [Page(t or "", named=named) for t in frame["html"]]
            contents = [hashlib.blake2b((t or "").encode("utf-8", "replace"), digest_size=16).digest() for t in frame["html"]]
            slots = [[(slot, *facts) for slot, facts in p.slots.items() if facts[0] >= 0] for p in read]
            yield pd.DataFrame({"_h_host": frame["_h_host"], "content": contents, "marks": [list(p.seen) for p in read], "slots": slots, "total": [p.total for p in read]})

    rows = pages.select(host_of("url").alias("_h_host"), "html").mapInPandas(subtrees, "_h_host string, content binary, marks array<long>, slots array<struct<slot long, depth int, chars long, headed boolean>>, total long")
    seen = rows.groupBy("_h_host", "content").agg(F.first(F.struct("marks", "slots", "total")).alias("page"), F.count("*").alias("rows"))
    seen = materialize(seen.select("_h_host", "page.*", "rows"), "html-subtrees")
    sizes = seen.groupBy("_h_host").agg(F.count("*").alias("pages"), F.sum("rows").alias("_h_rows"), F.sum("total").alias("total"))
    counts = seen.select("_h_host", F.explode("marks").alias("mark")).groupBy("_h_host", "mark").count().where(F.col("count") >= PAGES)
    share = F.col("count") / F.col("pages")
    found = counts.join(sizes, "_h_host").where(share >= SHARE).select("_h_host", "mark", share.alias("share"))
    marks = found.groupBy("_h_host").agg(F.collect_list(F.struct("mark", "share")).alias("t")).select("_h_host", F.col("t.mark").alias("_h_marks"), F.col("t.share").alias("_h_shares"))
    places = seen.select("_h_host", F.explode("slots").alias("s")).select("_h_host", "s.*").groupBy("_h_host", "slot")
    places = places.agg(F.count("*").alias("on"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.count_if("headed").alias("headed")).where(F.col("on") >= PAGES)
    held = (F.col("on") >= MAIN_PAGES * F.col("pages")) & (F.col("chars") >= MAIN_TEXT * F.col("total"))
    main = places.join(sizes, "_h_host").where(held).groupBy("_h_host").agg(F.max_by("slot", F.struct((2 * F.col("headed") >= F.col("on")).alias("h"), "depth", "chars", "slot")).alias("_h_main"))
    return sizes.select("_h_host", "_h_rows").join(marks, "_h_host", "left").join(main, "_h_host", "left")


def extract_text(pages: DataFrame, name: str = "text", named: bool = True) -> DataFrame:
    """``pages`` with the main text of every row's html."""
    templates = materialize(site_templates(pages, named), "html-templates")
    entries, total = templates.agg(F.coalesce(F.sum(F.greatest(F.size("_h_marks"), F.lit(1))), F.lit(0)), F.coalesce(F.sum("_h_rows"), F.lit(0))).first()
    rows = pages.withColumn("_h_host", host_of("url"))
    if entries <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(templates), "_h_host")
    else:
        rows = spread_join(rows.withColumn("_h_by", F.xxhash64("url", "html")), templates, "_h_host", "_h_rows", "_h_by", max(HOT, total // HOTS)).drop("_h_by")

    @F.pandas_udf("string")
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, marks, shares, mains in parts:
            out = [Page(t or "", dict(zip(m, s, strict=True)) if m is not None else {}, None if pd.isna(x) else int(x), named).text() for t, m, s, x in zip(htmls, marks, shares, mains, strict=True)]
            yield pd.Series(out, dtype=object)

    return rows.withColumn(name, read("html", "_h_marks", "_h_shares", F.col("_h_main").cast("string"))).drop("_h_host", "_h_rows", "_h_marks", "_h_shares", "_h_main")
