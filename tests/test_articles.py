"""Selectors against a plain tree walk, addresses against urllib, extraction rounds and crawls on small fixtures."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from barloom.functions import selectors, text
from barloom.operators import articles

SETTINGS = "name string, type string, max_items int, article_link_include array<string>, article_link_exclude array<string>, ticker_keywords array<string>, content_extract_mode string, content_extract_fallback boolean, title_selector string, time_selector string, content_selector string, rss_use_article_content boolean"


class Tree(HTMLParser):
    """A tree of [tag, attributes, parent, children and strings]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.now = ["", {}, None, []]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, self.now, []]
        self.now[3].append(node)
        if tag not in selectors.VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in selectors.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.now
        while node is not None and node[0] != tag:
            node = node[2]
        if node is not None and node[2] is not None:
            self.now = node[2]

    def handle_data(self, data):
        self.now[3].append(data)


def walk(node):
    for child in node[3]:
        if isinstance(child, list):
            yield child
            yield from walk(child)


def strings(node):
    for child in node[3]:
        if isinstance(child, str):
            if not any(a[0] in selectors.UNREAD for a in above(node)):
                yield child
        else:
            yield from strings(child)


def above(node):
    while node is not None:
        yield node
        node = node[2]


def suits(node, steps):
    if node is None or node[2] is None or not steps[-1].passes(node[0], node[1]):
        return False
    if len(steps) == 1:
        return True
    return suits(node[2], steps[:-1]) if steps[-1].child else any(suits(a, steps[:-1]) for a in above(node[2]))


def by_tree(html, selector):
    nodes = [n for n in walk(Tree(html).root) if any(suits(n, list(steps)) for steps in selectors.compiled(selector))]
    return [(n[1], " ".join(" ".join(strings(n)).split())) for n in nodes]


@pytest.mark.parametrize("selector", ["p", "div p", "div > p", "div div > p b", "div.a.b p", "#m", "[data-k]", "p[data-k^='v']", "p[class~=b], b", "*", "div>p>p", "i[data-k$='2'] , p[data-k*=v]", "script", "section div > p", "[data-k='v, 2']"])
def test_selectors_against_a_tree_walk(selector):
    dice = random.Random(selector)
    bits = ["<div>", '<div class="a b">', "<div id=m>", "</div>", "<p>", '<p data-k="v1" class="b c">', '<p data-k="v, 2">', "</p>", "<b>", "</b>", "<i data-k=v2>", "</i>", "x ", " y&amp;z ", "<br>", "<br/>", "<p/>", "<script>q<b></script>", "<!-- c -->", "</section>", "<section>", "\n"]
    for _ in range(300):
        html = "".join(dice.choice(bits) for _ in range(dice.randrange(30)))
        assert selectors.elements(html, [selector])[0] == by_tree(html, selector), html


@pytest.mark.parametrize("bad", ["", "a:hover", "a + b", "> a", "a >", "a >> b", "a..b", "[x"])
def test_selectors_that_are_not_understood(bad):
    with pytest.raises(ValueError):
        selectors.compiled(bad)


def test_deep_pages_in_linear_time():
    html = "<div><p>x</b>" * 60_000
    (found,) = selectors.elements(html, ["div > p > div"])
    assert len(found) == 59_999 and selectors.elements(None, ["p"]) == [[]]


def test_addresses_against_the_standard(spark):
    dice = random.Random(3)
    bits = ["", "/", "..", ".", "a/b.html", "//h2", "?q=1", "#f", "http:", "https:", "mailto:x", "g/", "../", "./", ";p", "?", "#", "http://o/x", "HTTP://O/y/../z", " ", "\t"]
    bases = ["http://h/a/b/c.html?x=1#y", "https://h", "https://h/", "http://h/a/b/", "http://h/a//b/c", "ftp://h/x", "mailto:b"]
    rows = [(dice.choice(bases), "".join(dice.choice(bits) for _ in range(dice.randrange(5)))) for _ in range(3000)]
    got = spark.createDataFrame([*rows, (None, "a"), ("http://h", None)], "b string, l string").select("b", "l", text.absolute_link(F.col("b"), F.col("l")).alias("r")).collect()
    assert [(r.b, r.l, r.r) for r in got if r.b and r.l is not None] == [(b, x, urljoin(b, x)) for b, x in rows]
    assert [r.r for r in got if r.b is None or r.l is None] == [None, None]


PAGE = '<html><head><meta property="og:title" content=" From  the head "><title>T</title></head><body><h1>{h}</h1><time datetime="2024-01-02T03:04:05Z">x</time><p>one &lt;two&gt;<p>three</p></p></body></html>'


def test_fields_fall_back(spark):
    rows = [(1, PAGE.format(h="Head")), (2, PAGE.format(h=" ... ")), (3, PAGE.format(h="")), (4, "<h1></h1><time> 2024/05/06 </time>"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "key long, html string").select("*", F.lit("h1").alias("title_selector"), F.lit("time").alias("time_selector"), F.lit("p").alias("content_selector"), F.lit("own").alias("title"))
    got = {r["key"]: tuple(r)[1:] for r in articles.article_fields(df).collect()}
    both = ("2024-01-02T03:04:05Z", "one <two> three three")
    assert got == {1: ("Head", *both), 2: ("From the head", *both), 3: ("From the head", *both), 4: ("", "2024/05/06", ""), 5: ("", "", "")}


def tables(spark):
    long = "words " * 8
    remote = {
        "r.jina.ai": spark.createDataFrame([("u1", f"# One\n{long}"), ("u2", "# short"), ("u6", f"# Six\n{long}")], "url string, body string"),
        "markdown.new": spark.createDataFrame([("u2", f"# Two\n{long}"), ("u1", f"# not asked\n{long}"), (None, "x")], "url string, body string"),
    }
    pages = spark.createDataFrame([(f"u{i}", f"<h1>H{i}</h1><p>{long}</p>") for i in range(1, 9)] + [("u3", ""), ("u4", "zz"), (None, long)], "url string, body string")
    return remote, pages


def test_later_rounds_see_only_what_earlier_ones_left(spark):
    remote, pages = tables(spark)
    asks = [("u1", "auto", True), ("u2", None, True), ("u3", "auto", True), ("u4", "auto", False), ("u5", "html", False), ("u6", "markdown-new", True), ("u7", "R_JINA_AI ", False), (None, "html", True), ("gone", "html", True), ("u1", "auto", True)]
    df = spark.createDataFrame(asks, "url string, content_extract_mode string, content_extract_fallback boolean").select("*", F.lit("h1").alias("title_selector"), F.lit("time").alias("time_selector"), F.lit("p").alias("content_selector"), F.lit(1).alias("key"))
    got = sorted((r["url"] or "", r["strategy"], r["title"]) for r in articles.cascade(df, remote, pages).collect())
    assert got == [("", None, ""), ("gone", None, ""), ("u1", "r.jina.ai", "One"), ("u1", "r.jina.ai", "One"), ("u2", "markdown.new", "Two"), ("u3", "html", "H3"), ("u4", None, ""), ("u5", "html", "H5"), ("u6", "html", "H6"), ("u7", None, "")]
    assert articles.cascade(df.where("false"), remote, pages).count() == 0


def test_feeds_and_lists_are_followed(spark):
    remote, pages = tables(spark)
    base = (10, ["^u"], ["u8"], None, "html", True, "h1", "time", "p")
    sources = spark.createDataFrame([("feed", "rss", *base, True), ("plain", "rss", *base, False), ("web", "html", *base, False)], SETTINGS)
    about = "a description that is long enough to stand alone"
    items = [("feed", "u1", 1, "Feed 1", about, "2024"), ("feed", "gone", 2, "Feed 2", about, None), ("feed", "http://no", 3, "Feed 3", about, None), ("plain", "u2", 1, "Plain", about, None), ("plain", "u3", 11, "Late", about, None), ("plain", "u4", 2, "", about, None)]
    items += [("web", "u5", 1, None, None, None), ("web", "unknown", 2, None, None, None), ("web", "u8", 3, None, None, None), ("web", "u5", 4, None, None, None)]
    got = articles.crawl(spark.createDataFrame(items, "source string, link string, n int, title string, description string, published_at string"), sources, remote, pages)
    rows = {(r["source"], r["n"]): (r["status"], r["headline"], r["strategy"], r["lost"]) for r in got.collect()}
    assert rows == {
        ("feed", 1): ("kept", "H1", "html", False), ("feed", 2): ("filtered", "Feed 2", None, False), ("feed", 3): ("filtered", "Feed 3", None, False), ("plain", 1): ("kept", "Plain", None, False),
        ("plain", 2): ("filtered", "", None, False), ("web", 1): ("kept", "H5", "html", False), ("web", 2): ("error", "", None, True), ("web", 3): ("filtered", "", None, False), ("web", 4): ("deduped", "H5", "html", False),
    }
    counts = {r["source"]: tuple(r)[1:] for r in articles.crawl_counts(got).collect()}
    assert counts["web"] == (1, 1, 1, 1) and counts["plain"] == (1, 0, 1, 0)


def test_links_in_page_order_once(spark):
    lists = spark.createDataFrame([("s", "http://h/b/", None, '<a href="x">1</a><a href="./x">2</a><a>3</a><a href="">4</a><a href="/y">5</a>', "a", 2), ("s", "http://h/a", None, '<a href="b/x">0</a><a href="z">9</a>', "a", 2), ("t", "http://h/a", "http://base/p/", '<div class=k><a href="q">1</a></div><a href="r">2</a>', "div.k a", 5), ("e", "http://h", None, None, "a", 5)], "source string, url string, base_url string, html string, article_link_selector string, max_items int")
    got = sorted((r["source"], r["n"], r["link"]) for r in articles.list_links(lists).collect())
    assert got == [("s", 1, "http://h/b/x"), ("s", 2, "http://h/z"), ("t", 1, "http://base/p/q")]


def same_as_sql(spark, tmp_path, name):
    """Rows of a registered query and of its SQL over pages whose titles are cut inside a reference."""
    import duckdb

    import __spark_entry__ as registry

    cut = ["&a", "&am", "&amp", "&quo", "&quot", "&amp;", "&amp;&amp", "&copy;"]
    html = "<head><title>T{0} x{1}</title></head><body><article><h1>T{0} x{1}</h1><p>the thing is long enough to be kept {1}</p></article><footer>f {1}</footer></body>"
    rows = [(i, f"https://h{i % 3}.example/{i}", html.format(i, cut[i % len(cut)])) for i in range(48)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = db.execute(registry.oracle_sql()[name]).fetchall()
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert len(want) > 20 and sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_article_fields_of_cut_references_are_as_in_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "article_fields")


def test_references_without_a_semicolon_are_read_as_html_has_them_unless_told_otherwise():
    html = '<p title="a&ampb">x &amp y &lt; &#65; &nosuch; &copy</p>'
    read = lambda bare: [(have["title"], text) for have, text in selectors.elements(html, ["p"], bare)[0]]
    assert read(True)[0][1] == "x & y < A &nosuch; ©"
    assert read(False) == [("a&ampb", "x &amp y < A &nosuch; &copy")]


def test_cascade_of_cut_references_is_as_in_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "extraction_cascade")


def test_crawl_of_cut_references_is_as_in_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "two_hop_crawl")
