"""Articles and links by each source's selectors, extraction strategies in rounds, and crawls over two hops.

Pages are given as tables (url, body): downloads happen elsewhere. A source's settings are rows of ``read_sources`` and
reach its pages by a join, so one plan serves all sources.

Defined cases: null or empty html has no elements; a null url matches no page; pages that repeat a url give one answer, the
smallest body; sources that repeat a name give their rows' pages each; empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import selectors
from ..functions.dates import any_date
from ..functions.text import absolute_link, compact, markdown_text, markdown_title, record_id

#: Names of the remote extraction services, how settings spell them, and titles that are no article's.
PROVIDERS = ("r.jina.ai", "markdown.new")
MODE_NAMES = {"r.jina.ai": ["r.jina.ai", "rjina", "r_jina_ai", "r-jina-ai"], "markdown.new": ["markdown.new", "markdown_new", "markdown-new", "markdown"], "html": ["html"], "auto": ["auto"]}
PORTAL_TITLES = ["Yahoo股市", "Yahoo奇摩股市"]
LEAST = 30
#: Parts of a source whose first links are chosen apart.
SALTS = 64


def extract_mode(raw: Column) -> Column:
    """A setting's extraction mode; unknown and missing ones are auto."""
    name = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.lit("auto")
    for mode, spelled in MODE_NAMES.items():
        out = F.when(name.isin(spelled), mode).otherwise(out)
    return out


def _article(key: int, html: str | None, title: str, time: str, content: str, bare: bool = True) -> Iterator[tuple]:
    if html is None:
        return
    titles, times, contents, og = selectors.elements(html, [title, time, content, "meta[property='og:title']"], bare)
    head = titles[0][1] if titles else ""
    if head in ("", "...") and og and "content" in og[0][0]:
        head = " ".join(og[0][0]["content"].split())
    at = ""
    if times:
        have, text = times[0]
        at = " ".join(have["datetime"].split()) if "datetime" in have else text
    yield key, head, at, " ".join(" ".join(t for _, t in contents).split())


def article_fields(pages: DataFrame, key: str = "key", bare: bool = True) -> DataFrame:
    """``key`` (long), title, time text and content of pages with columns html, title_selector, time_selector, content_selector.

    The title falls back on the page's og:title where it is empty or "...", the time is the element's datetime attribute
    or its text. Rows whose html is null have no row. Not ``bare``: character references without a semicolon stay text.
    """
    needed = [key, "html", "title_selector", "time_selector", "content_selector"]
    return selectors.map_pages(pages, needed, f"{key} long, title string, time_text string, content string", functools.partial(_article, bare=bare))


def _anchors(source: str, url: str, base: str | None, html: str | None, selector: str) -> Iterator[tuple]:
    for pos, (have, _) in enumerate(selectors.elements(html, [selector])[0]):
        if have.get("href"):
            yield source, url, base or url, pos, have["href"]


def list_links(lists: DataFrame) -> DataFrame:
    """source, link, n: links of list pages (source, url, html) with article_link_selector, base_url and max_items.

    Each link once per source, numbered by page address and place; the first ``max_items`` stay.
    """
    found = selectors.map_pages(lists, ["source", "url", "base_url", "html", "article_link_selector"], "source string, url string, base string, pos long, href string", _anchors)
    links = found.select("source", "url", "pos", absolute_link(F.col("base"), F.col("href")).alias("link"))
    first = links.groupBy("source", "link").agg(F.min(F.struct("url", "pos")).alias("at"))
    most = lists.groupBy("source").agg(F.max("max_items").alias("_most"))
    some = Window.partitionBy("source", F.pmod(F.xxhash64("link"), F.lit(SALTS))).orderBy("at", "link")
    few = first.join(most, "source").withColumn("n", F.row_number().over(some)).where(F.col("n") <= F.col("_most"))  # so that a source sends a bounded number on
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("at", "link")))
    return ranked.where(F.col("n") <= F.col("_most")).select("source", "link", "n")


def _one_each(fetched: DataFrame, name: str) -> DataFrame:
    return fetched.where("url is not null and body is not null and body <> ''").groupBy(F.col("url").alias("_url")).agg(F.min("body").alias(name))


def cascade(requests: DataFrame, remote: dict[str, DataFrame], pages: DataFrame, least: int = LEAST, bare: bool = True) -> DataFrame:
    """``requests`` with title, time_text, content and strategy: the first extraction that gives ``least`` characters.

    Requests have url, content_extract_mode, content_extract_fallback and the three selectors. Rounds go through the
    services of ``remote`` (name to a table of url and markdown body) that the mode allows; each round joins only rows that
    no earlier one has answered: answered rows carry a key that no page has, spread like the addresses. What is left goes
    to the html of ``pages`` (url, body), if the mode is html or falls back; only those rows' html goes to Python. Rows without an
    answer have empty title and content, and a null strategy. ``bare`` is as in ``article_fields``.
    """
    mode = extract_mode(F.col("content_extract_mode"))
    rows = requests.withColumns({"_mode": mode, "_done": F.lit(None).cast("string"), "title": F.lit(""), "content": F.lit("")})
    spread = F.concat(F.lit("\x00"), F.coalesce("url", F.lit("")))
    for name in PROVIDERS:
        asks = F.col("_done").isNull() & F.col("_mode").isin("auto", name) & F.col("url").isNotNull()
        body = _one_each(remote[name], "_body")
        rows = rows.withColumn("_key", F.when(asks, F.col("url")).otherwise(spread)).join(body, F.col("_key") == F.col("_url"), "left")
        text = F.coalesce(markdown_text(F.col("_body")), F.lit(""))
        rows = rows.withColumn("_text", text).withColumn("_won", F.length("_text") >= least)
        rows = rows.withColumns({"title": F.when(F.col("_won"), F.coalesce(markdown_title(F.col("_body")), F.lit(""))).otherwise(F.col("title")), "content": F.when(F.col("_won"), F.col("_text")).otherwise(F.col("content")), "_done": F.when(F.col("_won"), F.lit(name)).otherwise(F.col("_done"))})
        rows = rows.drop("_key", "_url", "_body", "_text", "_won")
    asks = F.col("_done").isNull() & ((F.col("_mode") == "html") | F.coalesce("content_extract_fallback", F.lit(True))) & F.col("url").isNotNull()
    rows = rows.withColumn("_key", F.when(asks, F.col("url")).otherwise(spread)).join(_one_each(pages, "_html"), F.col("_key") == F.col("_url"), "left").drop("_key", "_url")
    own = [c for c in rows.columns if c not in ("_html",)]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
    at = {c: own.index(c) for c in ("title", "content", "_done", "title_selector", "time_selector", "content_selector")}

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            html, columns = batch.column(len(own)), [batch.column(i) for i in range(len(own))]
            got = {c: columns[at[c]].to_pylist() for c in at}
            times: list[str | None] = [None] * batch.num_rows
            for i in range(batch.num_rows):
                if html[i].is_valid:
                    for _, title, time, content in _article(i, html[i].as_py(), *(got[c][i] for c in ("title_selector", "time_selector", "content_selector")), bare):
                        got["title"][i], times[i], got["content"][i], got["_done"][i] = title, time, content, "html"
            for c in ("title", "content", "_done"):
                columns[at[c]] = pa.array(got[c], pa.string())
            yield pa.record_batch([*columns, pa.array(times, pa.string())], names=[*own, "time_text"])

    out = rows.select(*own, "_html").mapInArrow(read, f"{kinds}, time_text string")
    return out.withColumnRenamed("_done", "strategy").drop("_mode")


def crawl(items: DataFrame, sources: DataFrame, remote: dict[str, DataFrame], pages: DataFrame, least: int = LEAST, bare: bool = True) -> DataFrame:
    """Records of followed links with their status: kept, filtered, deduped or error.

    ``items`` are links of list pages or feeds: source, link, n, and for feeds title, description and published_at (null
    where there are none). ``sources`` have the columns of ``read_sources``; n within max_items counts. Links go if a source's
    patterns don't allow them; the others are extracted by ``cascade`` where the source is no feed, or is one that asks for
    it. A page without content is an error, for feeds as well, though their description stands in. Then come the rules on
    titles, length and keywords, and each id stays once, where it comes first by order of sources and place. ``bare`` is as
    in ``article_fields``.
    """
    wants = F.when(F.col("type") == "rss", F.col("rss_use_article_content") | (extract_mode(F.col("content_extract_mode")) != "html")).otherwise(F.lit(True))
    settings = sources.select(F.col("name").alias("source"), "type", "max_items", "article_link_include", "article_link_exclude", "ticker_keywords", "content_extract_mode", "content_extract_fallback", "title_selector", "time_selector", "content_selector", wants.alias("_wants"))
    rows = items.select("source", F.col("link").alias("url"), "n", *(F.col(c).alias(f"_{c}") for c in ("title", "description", "published_at"))).join(settings, "source").where(F.col("n") <= F.col("max_items"))
    some = lambda patterns: F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.regexp_like(F.col("url"), p))
    allowed = F.coalesce((F.size(F.coalesce("article_link_include", F.array().cast("array<string>"))) == 0) | some(F.col("article_link_include")), F.lit(True)) & ~some(F.col("article_link_exclude"))
    rows = rows.withColumn("_allowed", F.coalesce(allowed, F.lit(False)))
    asked = rows.withColumns({"_url": F.col("url"), "url": F.when(F.col("_allowed") & F.col("_wants"), F.col("url"))}).withColumnRenamed("_url", "address")
    got = cascade(asked, remote, pages, least, bare)
    feed, found = F.col("type") == "rss", F.col("content") != ""
    title = F.when(feed, F.when(found & (F.col("title") != ""), F.col("title")).otherwise(F.coalesce("_title", F.lit("")))).otherwise(F.col("title"))
    content = F.when(feed & ~found, F.coalesce("_description", F.lit(""))).otherwise(F.col("content"))
    at = F.date_format(any_date(F.nullif("time_text", F.lit(""))), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    got = got.withColumns({"headline": compact(title), "_body": content, "published_at": F.coalesce(F.when(found, at), F.col("_published_at"))}).withColumn("content", F.col("_body"))
    good = (F.col("headline") != "") & ~F.col("headline").isin(PORTAL_TITLES) & (F.length(compact("content")) >= least)
    text = F.lower(compact(F.concat_ws(" ", "headline", "content")))
    words = F.coalesce("ticker_keywords", F.array().cast("array<string>"))
    good = good & ((F.size(words) == 0) | F.exists(words, lambda w: F.contains(text, F.lower(w))))
    lost = F.col("_allowed") & F.col("_wants") & ~found
    got = got.withColumns({"url": F.col("address"), "id": record_id(F.col("address"), F.col("headline"), F.col("published_at")), "lost": lost})
    early = F.when(~F.col("_allowed"), "filtered").when(lost & ~feed, "error").when(~F.coalesce(good, F.lit(False)), "filtered")
    got = got.withColumn("_early", early)
    nth = F.row_number().over(Window.partitionBy("id", F.col("_early").isNull()).orderBy("source", "n"))
    status = F.coalesce("_early", F.when(nth > 1, "deduped").otherwise("kept"))
    return got.withColumn("status", status).select("id", "source", "n", "url", "headline", "content", "published_at", "strategy", "lost", "status")


def crawl_counts(records: DataFrame) -> DataFrame:
    """Per source: fetched (kept), deduped, filtered, and errors, which count feed items that lost their page but stayed."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return records.groupBy("source").agg(is_("kept").alias("fetched"), is_("deduped").alias("deduped"), is_("filtered").alias("filtered"), F.count_if("lost").alias("errors"))
