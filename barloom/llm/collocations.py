"""Phrases whose words go together: exact n-gram counts in passes that prune with hashed buckets and smaller n-grams.

Each pass over the texts counts the n-grams of one length exactly and, at the same time, counts the next length in hashed
buckets. A bucket's total is at least the count of each of its n-grams, so n-grams of buckets below the least count are
never counted. The bitmap of the buckets that reach it is broadcast, as are bitmaps of the frequent shorter n-grams: an
n-gram is counted only if its bucket and both of its shorter parts may be frequent. All three can only let too much pass,
so the counts of the n-grams that reach the least count are exact.

Counts are gathered in each task and summed by Spark, so a phrase found in every row sends one row per task. Bitmaps have
one bit per bucket, and the number of buckets follows the bytes of text up to ``MOST_BITS``: at most 8 MB each to
broadcast. Beyond that they prune less; the results stay the same.

Words are split off after A-Z are lower-cased; phrases don't cross the marks ``.,;:!?`` or line ends.

Defined cases: a null or empty text has no words; a null lang is ``und``; repeated rows count each time; an empty table
gives no phrases; columns other than text and the one of the language are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small, spread_join

LONGEST, LEAST, TOP = 3, 10, 2000
FEWEST_BITS, MOST_BITS = 16, 26
#: Words that a task knows before it sends its counts, bytes counted at a time, and buckets sent in a row.
WORDS, CHUNK, BLOCK = 1 << 18, 3 << 20, 1 << 16
#: Parts of a language whose best phrases are chosen apart first.
SALTS = 64
BREAK = b"\xff"  # never in UTF-8
_PLAIN = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mix(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """Bucket numbers of n-grams from the hashes of their words, in order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h, odd in zip(hashes, _ODD, strict=False):
        out = (out ^ (out >> np.uint64(29))) * _ODD[1] + (h ^ (h >> np.uint64(31))) * odd
    return (out * _ODD[0]) >> np.uint64(64 - bits)


def stretches(texts: list[bytes]) -> Iterator[bytes]:
    """The texts with marks as breaks, in parts of some CHUNK bytes that end at breaks."""
    plain = BREAK.join(texts).translate(_PLAIN)
    at = 0
    while at < len(plain):
        end = plain.find(BREAK, at + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[at:end]
        at = end


class Words:
    """Numbers for the words of one language in a task, with their hashes; 0 is the break between pieces."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.forget()

    def forget(self) -> None:
        self.number, self.names, self.hashes = {BREAK: 0}, [BREAK], np.zeros(1, np.uint64)

    def read(self, plain: bytes) -> np.ndarray:
        words = (BREAK + plain + BREAK).replace(BREAK, b" \xff ").split()
        get = self.number.get
        codes = list(map(get, words))
        if None in codes:
            new = dict.fromkeys(w for w, c in zip(words, codes, strict=True) if c is None)
            self.number.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
            self.names += new
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in new), np.uint64, len(new))])
            codes = list(map(get, words))
        return np.array(codes, np.int64)


class Buckets:
    """Counts of a task's buckets, which need not go beyond the least count."""

    def __init__(self, bits: int, least: int):
        self.counts, self.least = np.zeros(1 << bits, np.uint8), least

    def add(self, buckets: np.ndarray) -> None:
        at, n = np.unique(buckets, return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + np.minimum(n, self.least), self.least)

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of the block, positions in it and counts; no positions if all stand there."""
        for block in range(max(1, len(self.counts) // BLOCK)):
            part = self.counts[block * BLOCK : (block + 1) * BLOCK]
            seen = np.flatnonzero(part)
            if len(seen) > len(part) // 3:
                yield block, b"", part.tobytes()
            elif len(seen):
                yield block, seen.astype("<u2").tobytes(), part[seen].tobytes()


class Tally:
    """Exact counts of a task's n-grams of one length, as numbers packed into 64 bits."""

    def __init__(self):
        self.keys, self.n, self.held, self.size = [], [], 0, 0

    def add(self, keys: np.ndarray) -> None:
        at, n = np.unique(keys, return_counts=True)
        self.keys.append(at)
        self.n.append(n)
        self.held += len(at)
        if self.held > max(1 << 20, 2 * self.size):
            self.join()

    def join(self) -> None:
        if len(self.keys) > 1:
            at, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.n = [at], [np.bincount(back, np.concatenate(self.n)).astype(np.int64)]
        self.held = self.size = sum(map(len, self.keys))


def frequent(bitmap: bytes, buckets: np.ndarray) -> np.ndarray:
    """Whether each bucket's bit is set."""
    bits = np.frombuffer(bitmap, np.uint8)
    return (bits[(buckets >> np.uint64(3)).astype(np.int64)] >> (buckets & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(blocks: DataFrame, bits: int, least: int) -> bytes:
    """Bitmap of the buckets whose counts reach ``least``, from rows (block, places, counts) of all tasks.

    All rows of a block go to one task in a stream, which holds the block's totals alone. The 2**bits bits come to the driver.
    """
    size = min(BLOCK, 1 << bits)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, totals = None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([np.packbits(totals >= least, bitorder="little").tobytes()])], names=["block", "bits"])

        for batch in batches:
            for block, places, counts in zip(batch.column("block").to_pylist(), batch.column("places"), batch.column("counts"), strict=True):
                if block != now:
                    if now is not None:
                        yield out()
                    now, totals = block, np.zeros(size, np.int64)
                places, counts = np.frombuffer(places.as_py(), "<u2"), np.frombuffer(counts.as_py(), np.uint8)
                if len(places):
                    totals[places] += counts
                else:
                    totals += counts
        if now is not None:
            yield out()

    dealt = blocks.repartition(max(1, (1 << bits) // BLOCK), "block").sortWithinPartitions("block")
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for block, found in dealt.mapInArrow(total, "block long, bits binary").toLocalIterator():
        whole[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(found, np.uint8)
    return whole.tobytes()


def _known_bitmap(phrases: DataFrame, length: int, bits: int) -> bytes:
    """Bitmap of the buckets of exactly counted frequent phrases (lang, phrase)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Buckets(bits, 1)
        seed = functools.cache(lambda lang: xxhash.xxh64_intdigest(lang.encode()))
        for batch in batches:
            seeds = list(map(seed, batch.column("lang").to_pylist()))
            words = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            hashes = [np.fromiter((xxhash.xxh64_intdigest(w[k], s) for w, s in zip(words, seeds, strict=True)), np.uint64, len(words)) for k in range(length)]
            found.add(mix(hashes, bits))
        yield _block_rows(list(found.blocks()))

    return _bitmap(phrases.select("lang", "phrase").mapInArrow(mark, "block long, places binary, counts binary"), bits, 1)


def _block_rows(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "places", "counts"])


def count_pass(docs: DataFrame, length: int, bits: int, least: int, known, buckets, hash_next: bool, label: str) -> tuple[DataFrame, bytes]:
    """Exact counts (lang, phrase, f) of the phrases of ``length`` words that reach ``least``, and the next length's bitmap.

    ``known`` maps shorter lengths to broadcast bitmaps of frequent phrases, ``buckets`` is the broadcast bitmap of this
    length's buckets (None for single words, which are all counted).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, tuple[Words, Tally]] = {}
        ahead = Buckets(bits, least) if hash_next else None
        shift = WORDS.bit_length() + 2

        def phrases(lang: str) -> Iterator[pa.RecordBatch]:
            words, tally = own.pop(lang)
            tally.join()
            for at in range(0, len(tally.keys[0]) if tally.keys else 0, 50_000):
                keys, n = tally.keys[0][at : at + 50_000], tally.n[0][at : at + 50_000]
                parts = [[words.names[c] for c in (keys >> (shift * k) & ((1 << shift) - 1)).tolist()] for k in reversed(range(length))]
                names = [b" ".join(w).decode() for w in zip(*parts, strict=True)]
                yield pa.record_batch([pa.array([lang] * len(names)), pa.array(names, pa.string()), pa.array(n.astype(np.int64)), *(pa.nulls(len(names), t) for t in (pa.int64(), pa.binary(), pa.binary()))], names=["lang", "phrase", "f", "block", "places", "counts"])

        def count(lang: str, plain: bytes) -> Iterator[pa.RecordBatch]:
            words, tally = own.setdefault(lang, (Words(lang), Tally()))
            codes = words.read(plain)
            hashes = words.hashes
            single = np.ones(len(words.names), bool)
            single[0] = False
            if length > 1:
                single &= frequent(known[1].value, mix([hashes], bits))
            fits = single[codes]  # at each place, whether an n-gram of the length so far may be frequent
            at = np.flatnonzero(fits)
            for n in range(2, length + 1):
                at = at[at + n - 1 < len(codes)]
                at = at[fits[at] & fits[at + 1]]  # both parts that are one word shorter
                grams = [hashes[codes[at + k]] for k in range(n)]
                at = at[frequent(known[n].value if n < length else buckets.value, mix(grams, bits))]
                fits = np.zeros(len(codes), bool)
                fits[at] = True
            key = np.zeros(len(at), np.int64)
            for k in range(length):
                key = key << shift | codes[at + k]
            tally.add(key)
            if hash_next:
                both = at[at + length < len(codes)]
                both = both[fits[both] & fits[both + 1]]
                ahead.add(mix([hashes[codes[both + k]] for k in range(length + 1)], bits))
            if len(words.names) > WORDS:
                yield from phrases(lang)

        held: dict[str, list[bytes]] = {}
        size: Counter[str] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, []).append(text.as_py())
                size[lang] += len(held[lang][-1]) + 1
                if size[lang] > CHUNK:
                    size[lang] = 0
                    for plain in stretches(held.pop(lang)):
                        yield from count(lang, plain)
        for lang, texts in held.items():
            for plain in stretches(texts):
                yield from count(lang, plain)
        for lang in list(own):
            yield from phrases(lang)
        if hash_next:
            for row in ahead.blocks():
                block = _block_rows([row])
                yield pa.record_batch([*(pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64())), *block.columns], names=["lang", "phrase", "f", "block", "places", "counts"])

    found = materialize(docs.mapInArrow(run, "lang string, phrase string, f long, block long, places binary, counts binary"), f"{label}-{length}-tasks")
    counted = found.where("block is null").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    following = _bitmap(found.where("block is not null").select("block", "places", "counts"), bits, least) if hash_next else b""
    return counted, following


def frequent_phrases(docs: DataFrame, lang: str = "lang", longest: int = LONGEST, least: int = LEAST, bits: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1, 2, ... words that occur ``least`` times, and (lang, n) of all words.

    At most three words, since a phrase is packed into 64 bits inside a task.
    """
    if not 2 <= longest <= 3 or not 1 <= least <= 127:
        raise ValueError("phrases have two or three words and a least count of 1 to 127")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if bits is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = min(max((size // 64).bit_length(), FEWEST_BITS), MOST_BITS)
    known, buckets, tables, totals = {}, None, [], None
    for length in range(1, longest + 1):
        counted, following = count_pass(rows, length, bits, least, dict(known), buckets, length < longest, "phrases")
        if length == 1:
            counted = materialize(counted, "phrases-words")
            totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
        tables.append(materialize(counted.where(F.col("f") >= least), f"phrases-{length}"))
        if length < longest:
            known[length] = spark.sparkContext.broadcast(_known_bitmap(tables[-1], length, bits))
            buckets = spark.sparkContext.broadcast(following)
    return tables, totals


def _key(phrase: Column) -> Column:
    return F.concat_ws("\t", F.col("lang"), phrase)  # phrases hold no tab, so the last one parts the two


def _look_up(rows: DataFrame, phrase: Column, facts: DataFrame, name: str) -> DataFrame:
    """``rows`` with the count ``name`` of the part ``phrase`` of their phrase; every part is in ``facts``."""
    rows = rows.withColumn("_key", _key(phrase))
    counts = facts.select(_key(F.col("phrase")).alias("_key"), F.col("f").alias(name))
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counts), "_key").drop("_key")
    rows = materialize(rows, "phrases-parts")
    uses = rows.groupBy("_key").agg(F.count("*").alias("_uses"))
    hot = max(BROADCAST_ROWS, rows.count() // BROADCAST_ROWS)
    return spread_join(rows, materialize(counts.join(uses, "_key"), "phrases-uses"), "_key", "_uses", "phrase", hot).drop("_key", "_uses")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits, for counts below 10 to the 14th."""
    a, left, right = (c.cast("decimal(14,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def collocations(docs: DataFrame, lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = 50, bits: int | None = None) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    The lowest-scoring cut of a phrase into two parts counts. Phrases go that stand in a longer candidate with at least
    ``inside`` percent of their count.
    """
    tables, totals = frequent_phrases(docs, lang, longest, least, bits)
    cut, scored = lambda first, n: F.concat_ws(" ", F.slice("_w", first, n)), []
    for length in range(2, longest + 1):
        rows = tables[length - 1].withColumn("_w", F.split("phrase", " "))
        for k in range(1, length):
            rows = _look_up(rows, cut(1, k), tables[k - 1], f"_l{k}")
            rows = _look_up(rows, cut(k + 1, length - k), tables[length - k - 1], f"_r{k}")
        cuts = [F.struct(score(F.col("f"), F.col(f"_l{k}"), F.col(f"_r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")) for k in range(1, length)]
        best = rows.withColumn("_cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        best = best.select("lang", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score", "_w")
        if length < longest:  # the largest count of a candidate one word longer that holds the phrase; still longer ones have no more
            longer = tables[length].withColumn("_w", F.split("phrase", " "))
            parts = longer.select("lang", F.explode(F.array(cut(1, length), cut(2, length))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_over"))
            best = best.join(parts, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("_over") < F.lit(inside) * F.col("a"), F.lit(True))).drop("_over")
        scored.append(best.drop("_w"))
    rows = functools.reduce(DataFrame.unionByName, scored)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = rows.withColumn("_some", F.row_number().over(some)).where(F.col("_some") <= top).drop("_some")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(small(totals, totals.count()), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
