"""Removal of repeated byte strings by suffix arrays, built shard by shard with induced sorting.

Every string of ``LENGTH`` bytes has one anchor: the ``GRAM``-byte gram in it with the smallest hash. Equal strings have
equal anchors, so strings can be dealt to shards by anchor hash and still meet all their copies.

1. Each document's anchors go to buckets, which find the anchors that occur in two documents or more. Those that do within
   what a task holds at a time are known to, so they go straight to their documents' groups, and their bucket gets just
   two of them from each such batch: a bucket's rows grow with the batches that hold an anchor, not with its copies.
2. Those anchors go back to their documents, grouped; each group cuts out the context of every such anchor (all the
   strings it stands for) and sends each distinct context once, with its smallest doc_id, to the anchor's shard.
3. A shard concatenates its contexts and builds their suffix array: suffixes are classified, leftmost-smaller (LMS)
   substrings are induced, named and sorted by doubling, and the array is induced from them. The permuted
   common prefixes tell which neighbours share ``LENGTH`` bytes; each run of such neighbours has a smallest doc_id.
4. That id goes back, for each start in a context, to the groups that asked, which mark what each document loses.

Texts and messages travel compressed. A group of documents sends a context once, however many of its documents hold it;
a shard's size does grow with the different contexts of one anchor.

Defined cases: null texts are empty; rows with a null doc_id neither lose bytes nor make others lose any; rows that
repeat a doc_id are one document, so they don't make each other lose bytes; texts shorter than ``LENGTH`` bytes stay;
an empty table gives an empty result; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .minhash import mix, powers

LENGTH, GRAM = 50, 16  # a gram is two 8-byte words
#: Bytes: of text a task reads before it sends anchors, of a segment, of a group's texts, of a shard's contexts.
BATCH, SEGMENT, GROUP, SHARD = 8 << 20, 4 << 20, 8 << 20, 2 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pack(*arrays: object) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the array is padded with zeros."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw),), "<u8", padded.data, strides=(1,)).copy()


def anchors(raw: np.ndarray, edges: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last start, and place of the anchor, of each run of strings with one anchor. Strings don't cross ``edges``."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    w = words8(raw)
    full = mix(w[: n - gram + 1] * _A + w[8 : n - gram + 9] * _B)
    low = (full & ~np.uint64(0xFFFFFF)) | np.arange(len(full), dtype=np.uint64)  # ties: leftmost
    span, wide = length - gram + 1, 1
    while 2 * wide <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if span > wide:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = np.ones(len(at), bool)
    for e in edges[1:-1]:
        ok[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(ok)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) > 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1 if len(first) else first
    return full[at[first]], starts[first], starts[last], at[first]


def _classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type); the last, a unique smallest symbol, is."""
    change = np.flatnonzero(text[:-1] != text[1:])
    upto = np.repeat(change, np.diff(change, prepend=-1))  # the last symbol is unique, so this covers all but it
    return np.append(text[upto] < text[upto + 1], True)


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that LMS suffixes, in the order given, induce; bucket by bucket, whole batches at a time."""
    before = np.concatenate([np.array([-1], np.int16), text[:-1].astype(np.int16)])
    before_small = np.concatenate([[False], small[:-1]])
    bounds = np.searchsorted(text[lms][order := np.argsort(text[lms], kind="stable")], np.arange(symbols + 1))
    seeds = lms[order]
    heads: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def deal(suffixes: np.ndarray, into: list[list[np.ndarray]]) -> None:
        symbol = text[suffixes]
        order = np.argsort(symbol, kind="stable")
        suffixes, symbol = suffixes[order], symbol[order]
        cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(suffixes)], strict=True):
            into[symbol[a]].append(suffixes[a:b])

    large: list[np.ndarray] = []
    nothing = np.zeros(0, np.int32)
    for c in range(symbols):
        parts, batch = [], np.concatenate(heads[c]) if heads[c] else nothing
        heads[c] = []
        while len(batch):
            parts.append(batch)
            go = batch[(before[batch] >= c) & ~before_small[batch]]
            same = before[go] == c
            if len(out := go[~same] - 1):
                deal(out, heads)
            batch = go[same] - 1
        large.append(np.concatenate(parts) if parts else nothing)
        mine = seeds[bounds[c] : bounds[c + 1]]
        if len(out := mine[before[mine] > c] - 1):
            deal(out, heads)
    tails: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    out_parts: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        parts, batch = [], np.concatenate(tails[c]) if tails[c] else nothing
        tails[c] = []
        if c == 0:
            batch = np.array([len(text) - 1], np.int32)
        while len(batch):
            parts.append(batch)
            go = batch[(before[batch] <= c) & (before[batch] >= 0) & before_small[batch]]
            same = before[go] == c
            if len(out := go[~same] - 1):
                deal(out, tails)
            batch = go[same] - 1
        if parts:
            out_parts.append(np.concatenate(parts))
        back = large[c][::-1]
        out_parts.append(back)
        if len(out := back[before_small[back]] - 1):
            deal(out, tails)
    return np.concatenate(out_parts)[::-1]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (numbers below some 260, the last one a unique 0), sorted by their first ``depth`` symbols at least."""
    text = text.astype(np.uint16)  # sixteen bits sort by radix
    symbols, small = int(text.max()) + 1, _classify(text)
    lms = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]])).astype(np.int32)
    if len(lms) > 1:
        marked = np.zeros(len(text), bool)
        marked[lms] = True
        order = _induce(text, small, lms, symbols)
        order = order[marked[order]]  # LMS substrings in order
        ends = np.append(lms[1:], len(text) - 1)
        place = np.empty(len(text), np.int32)
        place[lms] = np.arange(len(lms), dtype=np.int32)
        up, down = powers(len(text) + 2)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(text.astype(np.uint64) + _A) * up[: len(text)])])
        code = mix((sums[ends + 1] - sums[lms]) * down[lms]) + (ends - lms).astype(np.uint64)
        code = code[place[order]]
        name = np.empty(len(lms), np.int64)
        name[place[order]] = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]]))
        reach = 1  # names compared so far; each stands for two symbols at least
        while name.max() < len(lms) - 1 and 2 * reach < depth + 2:
            then = np.concatenate([name[reach:], np.full(min(reach, len(name)), -1)])[: len(name)]
            pair = name * (len(lms) + 1) + then + 1
            by = np.argsort(pair)
            name[by] = np.cumsum(np.concatenate([[0], pair[by][1:] != pair[by][:-1]]))
            reach *= 2
        lms = lms[np.argsort(name)]
    return _induce(text, small, lms, symbols)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, one i after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def smallest_holders(contexts: list[bytes], owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of a ``length``-byte string in each context, the smallest owner among the contexts that hold it:
    a flat array, and each context's place and count of starts in it."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    coded = text.astype(np.uint16) + np.uint16(2)
    coded[starts + sizes] = 1
    coded = np.append(coded, np.uint16(0))
    usable = np.zeros(len(coded), bool)
    which = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    left = np.repeat((starts + sizes).astype(np.int32), sizes + 1) - np.arange(len(text), dtype=np.int32)
    usable[: len(text)] = left >= length
    order = suffix_array(coded, length)
    order = order[usable[order]]
    above = np.full(len(text), -1, np.int32)  # the suffix before each, by place: phi
    above[order[1:]] = order[:-1]
    spots = np.flatnonzero(above >= 0)
    w, same = words8(text), np.ones(len(spots), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= w[spots + k] == w[above[spots] + k]
    shared = np.zeros(len(text), bool)  # whether the permuted common prefix reaches ``length``
    shared[spots] = same
    runs = np.flatnonzero(~shared[order])
    least = np.empty(len(text), np.int64)
    if len(order):
        least[order] = np.repeat(np.minimum.reduceat(owner[which[order]], runs), np.diff(np.append(runs, len(order))))
    return least, starts, sizes - length + 1


def _segments(raw: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, max(1, len(raw) - length + 1), SEGMENT):
        yield at, raw[at : at + SEGMENT + length - 1]


def _send_anchors(frames: Iterator[pd.DataFrame], buckets: int, length: int, gram: int) -> Iterator[pd.DataFrame]:
    """Messages (bucket, blob): row key, doc_id and row of each anchor, its hash, first start and number of starts, and
    whether its group knows it already. Bucket -1 - g has what is for group g, in the form of ``_shared_anchors``."""
    keys, docs, parts, held = [], [], [], 0

    def out() -> pd.DataFrame:
        mark, row, first, count, off = (np.concatenate([p[i] for p in parts]) for i in range(5))
        key, doc = np.array(keys), np.array(docs)
        order = np.lexsort((doc[row], mark))
        cuts = np.flatnonzero(np.diff(mark[order], prepend=~mark[order[:1]]))
        ends = np.append(cuts[1:], len(order)) - 1
        many = doc[row[order[cuts]]] != doc[row[order[ends]]] if len(order) else np.zeros(0, bool)
        shared = order[np.repeat(many, ends - cuts + 1)]
        told = np.zeros(len(mark), bool)
        told[shared] = True
        send = np.concatenate([order[np.repeat(~many, ends - cuts + 1)], order[cuts[many]], order[ends[many]]])
        bucket = (mark[send] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        blobs = []
        for mine in np.split(send[by], np.flatnonzero(np.diff(bucket[by])) + 1) if len(send) else ():
            rows, own = np.unique(row[mine], return_inverse=True)
            h = (mark[mine] // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            blobs.append(_pack(key[rows], doc[rows], h, own.astype(np.uint32), first[mine].astype(np.int64 if first.max() >> 31 else np.int32), count[mine].astype(np.uint8), off[mine].astype(np.uint8), told[mine]))
        straight = _to_groups(key[row[shared]], first[shared], count[shared].astype(np.uint8), off[shared].astype(np.uint8), buckets)
        frame = pd.DataFrame({"bucket": np.concatenate([np.unique(bucket), -1 - straight["g"].to_numpy(np.int64)]), "blob": blobs + list(straight["blob"])})
        keys.clear(), docs.clear(), parts.clear()
        return frame

    def measure(texts: list[tuple[int, int, bytes]]) -> None:
        edges = np.cumsum([0, *(len(t) for *_, t in texts)])
        mark, first, last, at = anchors(np.frombuffer(b"".join(t for *_, t in texts), np.uint8), edges, length, gram)
        seg = np.searchsorted(edges, first, "right") - 1
        row, base = (np.array([t[i] for t in texts]) for i in range(2))
        parts.append((mark, row[seg], first - edges[seg] + base[seg], last - first + 1, at - first))

    for frame in frames:
        pending, size = [], 0
        for key, doc, text in zip(frame["rk"], frame["doc_id"], frame["text"], strict=True):
            raw = text.encode("utf-8", "replace")
            if len(raw) < length:
                continue
            keys.append(key), docs.append(doc)
            for at, piece in _segments(raw, length):
                pending.append((len(keys) - 1, at, piece))
                size, held = size + len(piece), held + len(piece)
                if size > 1 << 20:
                    measure(pending)
                    pending, size = [], 0
            if held > BATCH:
                if pending:
                    measure(pending)
                yield out()
                pending, size, held = [], 0, 0
        if pending:
            measure(pending)
    if parts:
        yield out()


def _shared_anchors(mine: pd.DataFrame, groups: int) -> pd.DataFrame:
    """Of a bucket's anchors, those in two documents or more: messages (g, n, blob) of row key, first start, number."""
    if (bucket := int(mine["bucket"].iloc[0])) < 0:
        blobs = list(mine["blob"])
        return pd.DataFrame({"g": -1 - bucket, "n": [len(_unpack(b)[0]) for b in blobs], "blob": blobs})
    key, doc, mark, first, count, off, told = [], [], [], [], [], [], []
    for blob in mine["blob"]:
        k, d, h, own, f, c, o, t = _unpack(blob)
        wide = np.zeros((len(own), 8), np.uint8)
        wide[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
        mark.append(wide.view(np.uint64).ravel())
        key.append(k[own]), doc.append(d[own]), first.append(f.astype(np.int64)), count.append(c), off.append(o), told.append(t)
    key, doc, mark, first, count, off, told = map(np.concatenate, (key, doc, mark, first, count, off, told))
    order = np.argsort(mark, kind="stable")
    cuts = np.flatnonzero(np.diff(mark[order], prepend=~mark[order[:1]]))
    many = np.minimum.reduceat(doc[order], cuts) != np.maximum.reduceat(doc[order], cuts)
    keep = order[np.repeat(many, np.diff(np.append(cuts, len(order))))]
    keep = keep[~told[keep]]
    return _to_groups(key[keep], first[keep], count[keep], off[keep], groups)


def _to_groups(key: np.ndarray, first: np.ndarray, count: np.ndarray, off: np.ndarray, groups: int) -> pd.DataFrame:
    g = group_of(key, groups)
    by = np.argsort(g, kind="stable")
    parts = np.split(by, np.flatnonzero(np.diff(g[by])) + 1) if len(key) else []
    return pd.DataFrame({"g": np.array([g[p[0]] for p in parts], np.int64), "n": [len(p) for p in parts], "blob": [_pack(key[p], first[p], count[p], off[p]) for p in parts]})


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _send_texts(frames: Iterator[pd.DataFrame], groups: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"g": group_of(frame["rk"].to_numpy(np.int64), groups), "rk": frame["rk"], "doc_id": frame["doc_id"], "z": [zstandard.compress(t.encode("utf-8", "replace"), 3) for t in frame["text"]]})


def _contexts(texts: pd.DataFrame, blobs: list[bytes], length: int) -> tuple[pd.DataFrame, dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group's texts, its distinct contexts numbered, and the row, start, context and offset of each anchor."""
    texts = texts.drop_duplicates("rk").sort_values("rk", ignore_index=True)  # equal rk: the same row, or a chance of 1 in 2**64 a pair
    texts["raw"] = [zstandard.decompress(z) for z in texts.pop("z")]
    got = [_unpack(b) for b in blobs]
    key, first, count, off = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.int64) for i in range(4))
    order = np.lexsort((first, key))
    row, first, count = np.searchsorted(texts["rk"].to_numpy(), key[order]), first[order], count[order].astype(np.int64)
    raws, known = list(texts["raw"]), {}
    which = np.fromiter((known.setdefault(raws[r][a:b], len(known)) for r, a, b in zip(row.tolist(), first.tolist(), (first + count + length - 1).tolist(), strict=True)), np.int64, len(row))
    return texts, known, row, first, which, off[order]


def _ask(key: tuple, texts: pd.DataFrame, asked: pd.DataFrame, shards: int, length: int, gram: int) -> pd.DataFrame:
    """Messages (shard, blob): the group, its contexts' numbers, smallest and largest doc_ids, and bytes."""
    if not len(asked) or not len(texts):
        return pd.DataFrame({"shard": [], "blob": []})
    texts, known, row, _, which, off = _contexts(texts, list(asked["blob"]), length)
    doc = texts["doc_id"].to_numpy(np.int64)[row]
    low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(low, which, doc)
    np.maximum.at(high, which, doc)
    all_contexts = list(known)
    at = np.zeros(len(known), np.int64)
    at[which] = off
    anchor = np.frombuffer(b"".join([c[o : o + gram] for c, o in zip(all_contexts, at.tolist(), strict=True)]), "<u8").reshape(len(known), -1)
    shard = (mix(mix(anchor[:, 0] * _A + anchor[:, 1] * _B)) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    parts = np.split(by, np.flatnonzero(np.diff(shard[by])) + 1)
    return pd.DataFrame({"shard": [shard[p[0]] for p in parts], "blob": [_pack(key[0], p, low[p], high[p], [all_contexts[i] for i in p]) for p in parts]})


def _answer(asked: pd.DataFrame, length: int) -> pd.DataFrame:
    """Messages (g, blob): contexts of the group that lose bytes, and the smallest doc_id per start."""
    got = [_unpack(b) for b in asked["blob"]]
    contexts = [c for x in got for c in x[4]]
    number = {c: i for i, c in enumerate(dict.fromkeys(contexts))}
    which = np.array([number[c] for c in contexts])
    low = np.concatenate([x[2] for x in got])
    owner = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, low)
    least, starts, counts = smallest_holders(list(number), owner, length)
    flat = least[spread(starts, counts)]
    places = np.cumsum(counts) - counts
    floor = np.minimum.reduceat(flat, places)
    g, blobs, at = [], [], 0
    for group, own, _, high, _ in got:
        mine = which[at : at + len(own)]
        at += len(own)
        if (lose := np.flatnonzero(floor[mine] < high)).size:
            g.append(group)
            blobs.append(_pack(own[lose], counts[mine[lose]], flat[spread(places[mine[lose]], counts[mine[lose]])]))
    return pd.DataFrame({"g": np.array(g, np.int64), "blob": blobs})


def _covered(answers: list[bytes], row: np.ndarray, first: np.ndarray, which: np.ndarray, doc: np.ndarray, length: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the maximal runs that each row loses. Anchors come in order of row and place."""
    got = [_unpack(b) for b in answers]
    if not got:
        return {}
    own, counts, least = (np.concatenate([x[i] for x in got]) for i in range(3))
    at, size = np.zeros(which.max() + 1, np.int64), np.zeros(which.max() + 1, np.int64)
    at[own], size[own] = np.cumsum(counts) - counts, counts
    hit = np.flatnonzero(size[which] > 0)
    many = size[which[hit]]
    rows, starts = np.repeat(row[hit], many), spread(first[hit], many)
    gone = least[spread(at[which[hit]], many)] < doc[rows]
    rows, starts = rows[gone], starts[gone]
    if not len(rows):
        return {}
    head = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + length)]))
    a, b, rows = starts[head], starts[np.append(head[1:] - 1, len(starts) - 1)] + length, rows[head]
    cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return {int(rows[i]): (a[i:j], b[i:j]) for i, j in zip(cuts, [*cuts[1:], len(rows)], strict=True)}


def _remove(texts: pd.DataFrame, told: pd.DataFrame, length: int, with_text: bool) -> pd.DataFrame:
    repeats = texts.groupby("rk").size()
    asked = list(told["blob"][told["kind"] == 0])
    texts, _, row, first, which, _ = _contexts(texts, asked, length)
    doc = texts["doc_id"].to_numpy(np.int64)
    cover = _covered(list(told["blob"][told["kind"] == 1]), row, first, which, doc, length)
    out = []
    for r, (rk, doc_id, raw) in enumerate(zip(texts["rk"], texts["doc_id"], texts["raw"], strict=True)):
        removed, spans, kept = 0, 0, raw
        if r in cover:
            a, b = cover[r]
            removed, spans = int((b - a).sum()), len(a)
            kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
        one = (doc_id, len(raw), removed, spans, kept if with_text else hashlib.sha256(kept).hexdigest())
        out += [one] * int(repeats[rk])
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and what is kept, as bytes (``with_text``) or as their SHA-256."""
    kind = "binary" if with_text else "string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where("doc_id is not null").select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-total // GROUP))

    sent = named.where(F.octet_length("text") >= length).mapInPandas(lambda f: _send_anchors(f, groups, length, gram), "bucket long, blob binary")
    shared = sent.groupBy("bucket").applyInPandas(lambda mine: _shared_anchors(mine, groups), "g long, n long, blob binary")
    shared = materialize(shared, "suffix-anchors")
    found = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-found * (length + 20) // SHARD))

    texts = named.mapInPandas(lambda f: _send_texts(f, groups), "g long, rk long, doc_id long, z binary")
    asks = texts.groupBy("g").cogroup(shared.select("g", "blob").groupBy("g")).applyInPandas(lambda k, t, a: _ask(k, t, a, shards, length, gram), "shard long, blob binary")
    answers = materialize(asks.groupBy("shard").applyInPandas(lambda mine: _answer(mine, length), "g long, blob binary"), "suffix-answers")

    told = shared.select("g", F.lit(0).alias("kind"), "blob").unionByName(answers.select("g", F.lit(1).alias("kind"), "blob"))
    out = texts.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(lambda t, a: _remove(t, a, length, with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")
    raw = F.col("text").cast("binary")
    plain = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (raw if with_text else F.sha2(raw, 256)).alias("kept"))
    return out.unionByName(plain)
