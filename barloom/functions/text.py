"""Text column functions for news, names and pages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Share classes that lists append after a hyphen, instruments that aren't shares, and white space.
_CLASS_SUFFIX = r"(?i)\s*-\s*(Common Stock.*|Class [A-Z].*|Ordinary Shares.*|American Depositary Shares.*|Depositary Shares.*|Warrant.*|Unit.*|Preferred.*|Right.*)$"
_NOT_SHARES = r"(?i)(\bwarrants?\b|\brights?\b|\bunits?\b|%\s*notes\b|depositary share, each)"
_BLANKS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def compact(text: Column) -> Column:
    """Runs of any white space, ideographic too, as one space."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility forms folded and marks composed. ASCII texts don't leave the JVM, as nothing in them changes; others
    go through the standard's tables in Arrow batches. Null stays null."""
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, text).otherwise(_composed(F.when(~plain, text)))


def normal_query(text: Column) -> Column:
    """Compatibility forms folded, single-spaced, without market prefixes, upper case."""
    return F.upper(F.trim(F.regexp_replace(compact(nfkc(text)), r"^(TW:)?(US:)?", "")))


def record_id(url: Column, headline: Column, published: Column) -> Column:
    """SHA-256 of url|headline|published, null parts as empty."""
    parts = [F.coalesce(p, F.lit("")) for p in (url, headline, published)]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword occurs, whatever its case; no keywords let everything pass."""
    low = F.lower(text)
    return F.lit(True) if not keywords else F.coalesce(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, F.lower(k))), F.lit(False))


def link_allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Some include pattern matches, if there are any, and no exclude pattern does."""
    ok = F.lit(not include)
    for p in include:
        ok = ok | url.rlike(p)
    for p in exclude:
        ok = ok & ~url.rlike(p)
    return F.coalesce(ok, F.lit(False))


def meaningful(title: Column, content: Column, junk: list[str], least: int) -> Column:
    """A title that isn't a placeholder, and enough text."""
    t = compact(F.coalesce(title, F.lit("")))
    return (t != "") & ~F.lower(t).isin([j.lower() for j in junk]) & (F.length(compact(F.coalesce(content, F.lit("")))) >= least)


def markdown_title(md: Column) -> Column:
    """The first line that starts with #, without the leading marks."""
    lines = F.transform(F.split(md, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: compact(x))
    first = F.get(F.filter(lines, lambda x: x.startswith("#")), F.lit(0))
    return F.nullif(compact(F.regexp_replace(first, r"^[# ]+", "")), F.lit(""))


def markdown_text(md: Column) -> Column:
    """Plain text: no code fences or images, links as their text, no markup characters."""
    t = F.regexp_replace(md, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return compact(F.regexp_replace(t, r"[`*_>#\-]", " "))


def html_title(html: Column) -> Column:
    return F.nullif(compact(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_paragraphs(html: Column) -> Column:
    """Texts of p elements, without tags, joined by spaces."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return compact(F.array_join(F.transform(raw, lambda p: F.regexp_replace(p, r"<[^>]*>", " ")), " "))


def html_links(html: Column) -> Column:
    """href values in page order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)))


#: Scheme, host, path, query and fragment of an address; a part that is there but empty counts as absent.
_ADDRESS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Schemes whose links can be relative.
_RELATIVE = ["", "http", "https", "ftp", "file"]


def resolved_path(parts: Column) -> Column:
    """Path parts with "." and ".." worked off in one fold, as a path that begins with a slash."""
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).when(p == ".", acc).otherwise(F.array_append(acc, p)))
    path = F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def absolute_link(base: Column, link: Column) -> Column:
    """A link on a page as an absolute address: dot segments, queries and fragments alone, hosts without a scheme.

    Addresses with a host of their own or another scheme stay as they are; an empty link is the page itself. A null base
    or link gives null.
    """
    clean = F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda x, i: F.regexp_extract(x, _ADDRESS, i)
    scheme, host, whole, query, fragment = (part(clean, i) for i in range(1, 6))
    extra = F.regexp_extract(whole, r";[^/]*$", 0)  # parameters of the last part
    path = F.regexp_replace(whole, r";[^/]*$", "")
    over = F.lower(part(base, 1))
    own = F.when(scheme == "", over).otherwise(F.lower(scheme))
    folder = F.split(part(base, 3), "/")
    folder = F.when(F.element_at(folder, -1) == "", folder).otherwise(F.slice(folder, 1, F.size(folder) - 1))
    below = F.concat(folder, F.split(path, "/"))
    below = F.filter(below, lambda p, i: (p != "") | (i == 0) | (i == F.size(below) - 1))
    parts = F.when(path.startswith("/"), F.split(path, "/")).otherwise(below)
    mark = lambda sign, text: F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(sign), text))
    root = lambda h: F.concat(own, F.when(own == "", F.lit("")).otherwise(F.lit(":")), F.when(h == "", F.lit("")).otherwise(F.concat(F.lit("//"), h)))
    slashed = F.when((whole == "") | whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))
    tail = F.concat(mark("?", query), mark("#", fragment))
    return (
        F.when(link == "", base)
        .when((own != over) | ~own.isin(*_RELATIVE), link)
        .when(host != "", F.concat(root(host), slashed, tail))
        .when(whole == "", F.concat(root(part(base, 2)), part(base, 3), mark("?", F.when(query == "", part(base, 4)).otherwise(query)), mark("#", fragment)))
        .otherwise(F.concat(root(part(base, 2)), resolved_path(parts), extra, tail))
    )


def trimmed_name(name: Column) -> Column:
    """A security's name without the share class after a hyphen."""
    return F.btrim(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), _CLASS_SUFFIX, ""), F.lit(" -"))


def is_share(name: Column) -> Column:
    """No whole word of the name says warrant, right or unit, nor does it offer notes at a percentage."""
    return ~F.coalesce(name, F.lit("")).rlike(_NOT_SHARES)


def ticker_root(ticker: Column) -> Column:
    return F.split(F.upper(ticker), r"\.").getItem(0)


def encoded(text: Column) -> Column:
    """Text for use in an address: slashes and ~ stay, blanks are %20."""
    out = F.url_encode(text)
    for said, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(said), F.lit(wanted))
    return out


def filled(template: str | Column, ticker: Column, query: Column) -> Column:
    """A template with {ticker}, {query} and {query_encoded} filled in; one that names anything else stays as it is."""
    raw = F.lit(template) if isinstance(template, str) else template
    parts = F.transform(F.split(raw, r"(?=\{[A-Za-z_]+\})|(?<=\})"), lambda p: F.when(p == "{ticker}", ticker).when(p == "{query}", query).when(p == "{query_encoded}", encoded(query)).otherwise(p))
    return F.when(raw.rlike(r"\{(?!(ticker|query|query_encoded)\})[A-Za-z_]+\}"), raw).otherwise(F.array_join(parts, ""))


def safe_ticker(raw: Column) -> Column:
    return F.substring(F.regexp_replace(F.upper(raw), r"[^A-Z0-9._\-]", ""), 1, 16)


def safe_query(raw: Column) -> Column:
    return F.substring(F.regexp_replace(compact(raw), r"^-+", ""), 1, 120)
