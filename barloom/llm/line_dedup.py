"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference tables.

The exact table has one row per (key, document), so inserting documents adds rows, deleting documents removes them, and
every count follows. Each shard of keys also has a cuckoo filter, a few bits per key, that answers "surely not present"
without touching the exact table: only keys that the filter may hold go on to the exact join. Filters take deletions as
well. The number of shards follows the keys: when they outgrow their shards, filters are made anew from the reference
table with more of them. ``dedup_lines`` builds an index of half the documents, inserts the other half and reads the
counts from it; where no index is wanted afterwards, ``keep_index=False`` counts the keys at once, with equal results.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. Keys of at least ``min_chars``
code points in at least ``min_docs`` documents lose all their lines, except in the largest doc_id that holds them.

Defined cases: a null or empty text is one empty line; rows whose doc_id is null belong to no document, so they neither
count nor lose lines; repeated rows with one doc_id count as one document, and so does a document inserted twice; an empty table gives an empty result; columns
other than doc_id and text are passed through (internal ones start with ``_ld_``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash128, materialize, small, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard, and lines that one task looks up at a time.
SHARD_KEYS, LINES_PER_TASK = 1 << 18, 200_000
SLOTS, KICKS, LOAD = 4, 200, 0.85


class CuckooFilter:
    """Partial-key cuckoo hashing over whole arrays: 16-bit fingerprints, four slots a bucket, growing by segments."""

    def __init__(self, segments: list[np.ndarray] | None = None, capacity: int = 1024):
        self.segments = segments or [self.empty(capacity)]

    @staticmethod
    def empty(capacity: int) -> np.ndarray:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
        return np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def marks(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0), first position and the fingerprint's own hash, before reduction to a table's size."""
        a, b = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        mark = (b >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, a, CuckooFilter.spread(mark)

    @staticmethod
    def spread(mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, at, jump = self.marks(h1, h2)
        found = np.zeros(len(mark), bool)
        for table in self.segments:
            mask = np.uint64(len(table) - 1)
            one = at & mask
            two = one ^ (jump & mask)
            found |= (table[one] == mark[:, None]).any(axis=1) | (table[two] == mark[:, None]).any(axis=1)
        return found

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Insert distinct keys. A segment at its load limit is followed by a larger one.

        What finds no place in KICKS rounds goes to further segments of the same size: of a mark that was pushed out,
        only its bucket in that size is known.
        """
        mark, at, _ = self.marks(h1, h2)
        while len(mark):
            last = self.segments[-1]
            room = int(LOAD * last.size) - np.count_nonzero(last)
            if room <= 0:
                self.segments.append(self.empty(max(2 * last.size, len(mark))))
                continue
            rest = self.place(last, mark[:room], at[:room])
            while len(rest[0]):
                self.segments.append(np.zeros_like(last))
                rest = self.place(self.segments[-1], *rest)
            mark, at = mark[room:], at[room:]

    def place(self, table: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put marks in the table; gives those left over, with a bucket of theirs."""
        mask, dice = np.uint64(len(table) - 1), np.random.default_rng(7)
        mark, here = mark.copy(), at & mask
        for turn in range(KICKS):
            for _ in range(2):  # this bucket, then the other; one key per bucket and round
                while len(mark):
                    first = np.unique(here, return_index=True)[1]
                    free = table[here[first]] == 0
                    can = free.any(axis=1)
                    if not can.any():
                        break
                    put = first[can]
                    table[here[put], free[can].argmax(axis=1)] = mark[put]
                    keep = np.ones(len(mark), bool)
                    keep[put] = False
                    mark, here = mark[keep], here[keep]
                here = here ^ (self.spread(mark) & mask)
            if not len(mark):
                break
            if turn == KICKS - 1:
                break
            first = np.unique(here, return_index=True)[1]
            slot = dice.integers(0, SLOTS, len(first))
            out = table[here[first], slot].copy()
            table[here[first], slot] = mark[first]
            mark[first] = out
            here[first] = here[first] ^ (self.spread(out) & mask)
        return mark, here

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out one copy of each key's fingerprint; keys must have been inserted. Larger segments come first: a key that
        shares a mark and bucket there shares them in the smaller ones too, so no other key is lost."""
        mark, at, jump = self.marks(h1, h2)
        for table in reversed(self.segments):
            mask = np.uint64(len(table) - 1)
            for flip in (np.uint64(0), mask):
                bucket = (at & mask) ^ (jump & flip)
                left, here = np.ones(len(mark), bool), np.arange(len(mark))
                while len(here):  # keys that share a bucket take turns
                    found = table[bucket[here]] == mark[here][:, None]
                    here, found = here[found.any(axis=1)], found[found.any(axis=1)]
                    first = np.unique(bucket[here], return_index=True)[1]
                    table[bucket[here[first]], found[first].argmax(axis=1)] = 0
                    left[here[first]] = False
                    here = np.delete(here, first)
                mark, at, jump = mark[left], at[left], jump[left]

    def to_rows(self) -> list[bytes]:
        return [t.tobytes() for t in self.segments]

    @classmethod
    def from_rows(cls, rows: list[bytes]) -> CuckooFilter:
        return cls([np.frombuffer(r, np.uint16).reshape(-1, SLOTS).copy() for r in rows])


def line_key(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(BLANKS)), upper, upper.lower())


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Long enough lines: doc_id, _ld_text (hash of the row's text), pos, h1, h2."""
    text = text_or_empty("text")
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("_ld_text"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    h1, h2 = hash128(F.col("key"))
    lines = lines.select("doc_id", "_ld_text", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return lines.select("doc_id", "_ld_text", "pos", h1.alias("h1"), h2.alias("h2"))


def in_shards(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.shiftrightunsigned("h2", 20), F.lit(shards)).cast("int"))


def counted(references: DataFrame) -> DataFrame:
    return references.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


@dataclass
class LineIndex:
    """``references``: h1, h2, doc_id, one row each. ``filters``: shard, segments (the cuckoo filter's tables), ``shards`` of
    them for about ``keys`` keys."""

    references: DataFrame
    filters: DataFrame
    shards: int
    keys: int

    @classmethod
    def build(cls, lines: DataFrame) -> LineIndex:
        return cls._of(materialize(lines.select("h1", "h2", "doc_id").distinct(), "line-references"))

    @classmethod
    def _of(cls, references: DataFrame) -> LineIndex:
        keys = materialize(references.select("h1", "h2").distinct(), "line-keys")
        count = keys.count()
        shards = -(-count // SHARD_KEYS) or 1
        return cls(references, materialize(_change(in_shards(keys, shards), None, "insert"), "line-filters"), shards, count)

    def insert(self, lines: DataFrame) -> LineIndex:
        """Add the lines of documents. Keys that the filter surely lacks skip the exact lookup."""
        new = materialize(lines.select("h1", "h2", "doc_id").distinct(), "line-new")
        keys = materialize(new.select("h1", "h2").distinct(), "line-keys")
        maybe = self.maybe(keys)
        known = materialize(maybe.join(self.references, ["h1", "h2"], "left_semi"), "line-known")
        fresh = materialize(keys.join(known, ["h1", "h2"], "left_anti"), "line-fresh")
        count = self.keys + fresh.count()
        references = self.references.unionByName(new).distinct()
        if count > 2 * SHARD_KEYS * self.shards:
            return self._of(materialize(references, "line-references"))
        return LineIndex(references, materialize(_change(in_shards(fresh, self.shards), self.filters, "insert"), "line-filters"), self.shards, count)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Forget documents: keys that no other document holds leave the filters too."""
        gone = doc_ids.select("doc_id").distinct()
        left = materialize(self.references.join(gone, "doc_id", "left_anti").select("h1", "h2", "doc_id"), "line-references")
        lost = self.references.join(gone, "doc_id", "left_semi").select("h1", "h2").distinct()
        lost = materialize(lost.join(left, ["h1", "h2"], "left_anti"), "line-lost")
        filters = materialize(_change(in_shards(lost, self.shards), self.filters, "delete"), "line-filters")
        return LineIndex(left, filters, self.shards, self.keys - lost.count())

    def counts(self) -> DataFrame:
        return counted(self.references)

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        return self.counts().where(F.col("n_docs") >= min_docs)

    def maybe(self, keys: DataFrame) -> DataFrame:
        return _maybe(in_shards(keys, self.shards), self.filters).drop("shard")


def _change(keys: DataFrame, filters: DataFrame | None, how: str) -> DataFrame:
    """Filters after inserting or deleting distinct ``keys`` (with their shard): one shard, of about SHARD_KEYS keys, per group."""

    def build(group: tuple, mine: pd.DataFrame, old: pd.DataFrame | None = None) -> pd.DataFrame:
        found = CuckooFilter.from_rows(list(old["segments"].iloc[0])) if old is not None and len(old) else CuckooFilter(capacity=2 * len(mine))
        getattr(found, how)(mine["h1"].to_numpy(), mine["h2"].to_numpy())
        return pd.DataFrame({"shard": [group[0]], "segments": [found.to_rows()]})

    schema = "shard int, segments array<binary>"
    grouped = keys.groupBy("shard")
    if filters is None:
        return grouped.applyInPandas(lambda group, mine: build(group, mine), schema)
    return grouped.cogroup(filters.groupBy("shard")).applyInPandas(build, schema)


def _maybe(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows whose key the filters may hold. A shard with many rows is salted and its filter copied to each salt."""
    sizes = materialize(rows.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(LINES_PER_TASK))).cast("int").alias("salts")), "line-salts")
    spread = rows.join(F.broadcast(sizes), "shard").withColumn("salt", F.pmod(F.xxhash64("h1", *(["doc_id", "pos"] if "pos" in rows.columns else [])), F.col("salts")).cast("int"))
    copies = filters.join(F.broadcast(sizes.withColumnRenamed("salts", "copies")), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    columns = rows.columns

    def look(mine: pd.DataFrame, filter_row: pd.DataFrame) -> pd.DataFrame:
        if not len(filter_row) or not len(mine):
            return mine.iloc[:0][columns]
        found = CuckooFilter.from_rows(list(filter_row["segments"].iloc[0]))
        return mine[found.contains(mine["h1"].to_numpy(), mine["h2"].to_numpy())][columns]

    return spread.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(look, rows.schema)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_index: bool = True) -> DataFrame:
    """doc_id, _ld_text and the positions of the lines that go.

    The index's reference counts give the repeated keys; a filter of just those sorts out most lines before the exact join.
    """
    lines = materialize(lines_of(docs, min_chars), "lines")
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    if keep_index:
        counts = LineIndex.build(lines.where(early)).insert(lines.where(~early)).counts()
    else:
        counts = counted(lines.select("h1", "h2", "doc_id").distinct())
    repeated = materialize(counts.where(F.col("n_docs") >= min_docs), "line-repeated")
    count = repeated.count()
    shards = -(-count // SHARD_KEYS) or 1
    filters = materialize(_change(in_shards(repeated.select("h1", "h2"), shards), None, "insert"), "line-filters")
    hits = _maybe(in_shards(lines, shards), filters).join(small(repeated.select("h1", "h2", "keeper"), count), ["h1", "h2"]).where("doc_id <> keeper")
    return hits.groupBy("doc_id", "_ld_text").agg(F.collect_set("pos").alias("_ld_gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_index: bool = True) -> DataFrame:
    """``docs`` with the remaining text, and the counts _ld_lines and _ld_dropped."""

    @F.pandas_udf("string")
    def keep(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, gone in texts:
            out = []
            for t, g in zip(text, gone, strict=True):
                drop = () if g is None else set(g)
                out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop) if drop else None)
            yield pd.Series(out, dtype=object)

    gone = dropped_lines(docs, min_chars, min_docs, keep_index).withColumnRenamed("doc_id", "_ld_doc").withColumnRenamed("_ld_text", "_ld_hash")
    rows = docs.withColumn("_ld_hash", F.xxhash64(text_or_empty("text"))).withColumnRenamed("doc_id", "_ld_doc")
    rows = rows.join(gone, ["_ld_doc", "_ld_hash"], "left").withColumnRenamed("_ld_doc", "doc_id")
    text = text_or_empty("text")
    counts = {"_ld_lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, "_ld_dropped": F.coalesce(F.size("_ld_gone"), F.lit(0))}
    rows = rows.withColumns({k: v.cast("long") for k, v in counts.items()})
    rest = keep(F.when(F.col("_ld_dropped") > 0, text), F.col("_ld_gone"))
    return rows.withColumn("text", F.coalesce(rest, "text")).select(*docs.columns, "_ld_lines", "_ld_dropped")
