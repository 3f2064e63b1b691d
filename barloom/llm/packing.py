"""Packing tokenized documents and examples into fixed-length training sequences by vector bin packing.

Every item needs tokens, segments and loss-bearing tokens; a sequence has a limit on each. The dot-product heuristic
fills one sequence at a time: among the items that still fit, it takes the one whose demand vector has the largest
weighted inner product with what is left of the sequence. Items are packed in windows inside each task, so nothing is
shuffled. Short items are bundled first, so that a window always has the tokens of several sequences. Sequences that a
window leaves unfilled go back to the pool; if they become too many, the fullest is topped up with a cut of another,
and where another limit than that on tokens closes a sequence, it is cut to a power of two, which needs no padding. So
is what remains at the end of a task.

Documents have no segment limit by default and bear loss on each token; ``pack_conversations`` packs instruction data,
where turns are segments and only the assistant's tokens bear loss.

Defined cases: a null text is empty and gives just the end token; repeated rows are separate documents; ties go to the
item that came first; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH, END_ID = 2048, 1
#: Items packed together; sequences with at most SLACK free tokens count as full; tokens of a bundle of short items.
WINDOW, SLACK, BUNDLE = 512, 8, 64
#: Entries of a task's cache from white-space-delimited chunk to ids.
CACHE = 400_000
VOCABULARY = "word_bpe_49k.json"


def plain_stops(text: str) -> bool:
    """Whether each comma and full stop ends a chunk, with no punctuation before it."""
    if any(text.count(c) != text.count(c + " ") + text.endswith(c) for c in ",."):
        return False
    return text.replace(",", "").replace(".", "").replace(" ", "").isalnum()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The vocabulary's pre-tokenizer never lets a token cross white space, or run from a word into a comma or full stop
    that ends it, and its normalizer works on single characters, so the ids of a text are those of its chunks. The
    first chunks seen stay in a cache; later ones go to a second cache that is emptied when full.
    """

    def __init__(self, path: str, block: int = 1 << 20):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would spin on the others'
        self.tokenizer, self.block = Tokenizer.from_file(path), block
        self.known, self.late = {"": b""}, {}
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def chunks(self, text: str) -> Iterator[list[str]]:
        for blank in "\n\t\r\x0b\x0c":
            text = text.replace(blank, " ")
        if text.isascii() or ("\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower())):
            text = text.lower()  # as the normalizer does anyway; fewer chunks to know
        if plain_stops(text):
            text = text.replace(",", " ,").replace(".", " .")
        at = 0
        while at < len(text):
            end = len(text) if at + self.block >= len(text) else text.find(" ", at + self.block)
            end = len(text) if end < 0 else end
            yield text[at:end].split(" ")
            at = end

    def encode(self, text: str) -> bytes:
        out, get = [], self.known.get
        for chunks in self.chunks(text):
            ids = list(map(get, chunks))
            if None in ids:
                holes = [i for i, x in enumerate(ids) if x is None]
                late = self.learn([chunks[i] for i in holes])
                for i in holes:
                    ids[i] = late[chunks[i]] if (x := get(chunks[i])) is None else x
            out.append(b"".join(ids))
        return b"".join(out)

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """Make sure that one of the caches has each chunk; gives the second."""
        if len(self.late) > CACHE // 4:
            self.late.clear()
        new = [c for c in dict.fromkeys(missing) if c not in self.late]
        words = [c for c in new if c.isalpha()]
        self.keep(words, self.encode_words(words))
        other = [c for c in new if not c.isalpha()]
        self.keep(other, [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)])
        return self.late

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters encoded as one text: each ends with the first id that marks a word's end."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids if words else [], "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(words):
            return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *stops], stops, strict=False)]

    def keep(self, chunks: list[str], ids: list[bytes]) -> None:
        (self.known if len(self.known) < CACHE else self.late).update(zip(chunks, ids, strict=True))


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, so that its caches outlive a task."""
    return ChunkEncoder(path)


def fill(need: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of item numbers for demands ``need`` (items x dimensions) by the dot-product heuristic.

    Every item must fit an empty bin. Dimensions weigh as their total demand against the limit.
    """
    unit = need / limits
    weight = unit.sum(axis=0)
    weight = weight / max(weight.sum(), 1e-12)
    order = np.argsort(-(unit @ weight), kind="stable")
    unit, bins = unit[order], []
    while len(order):
        room, mine, live = 1 - unit[0], [0], np.arange(1, len(order))  # an empty bin takes the largest demand
        while len(live):
            live = live[(unit[live] <= room + 1e-9).all(axis=1)]
            if not len(live):
                break
            best = live[np.argmax(unit[live] @ (weight * room))]
            mine.append(best)
            room = room - unit[best]
            live = live[live != best]
        bins.append(order[mine].tolist())
        order, unit = np.delete(order, mine), np.delete(unit, mine, axis=0)
    return bins


Piece = tuple[int | None, int, bytes, int]  # doc_id, ids of its document before it, its ids, ids of its document


def cut_piece(piece: Piece, n: int) -> tuple[Piece, Piece | None]:
    """The first ``n`` ids of a piece, and the rest if there is any."""
    doc, start, ids, count = piece
    return (doc, start, ids[: 4 * n], count), (doc, start + n, ids[4 * n :], count) if len(ids) > 4 * n else None


def tokens(pieces: Iterable[Piece]) -> int:
    return sum(len(p[2]) for p in pieces) // 4


class SequencePacker:
    """Takes documents' ids and yields sequences, each a list of pieces, under limits on tokens, segments and loss tokens.

    ``loss`` counts the loss-bearing tokens of a piece's ids; a part of a piece may not bear more than the whole.
    """

    def __init__(self, length: int = LENGTH, segments: int | None = None, loss: Callable[[bytes], int] | None = None, loss_limit: int | None = None):
        self.length, self.segments, self.loss = length, segments or length, loss or (lambda ids: len(ids) // 4)
        self.loss_limit = loss_limit or length
        self.limits = np.array([length, self.segments, self.loss_limit], float)
        self.pool: list[list[Piece]] = []
        self.bundle: list[Piece] = []
        self.held = 0

    def need(self, pieces: list[Piece]) -> tuple[int, int, int]:
        return tokens(pieces), len(pieces), sum(self.loss(p[2]) for p in pieces)

    def add(self, doc: int | None, ids: bytes) -> Iterator[list[Piece]]:
        rest: Piece | None = (doc, 0, ids, len(ids) // 4)
        while rest and len(rest[2]) >= 4 * self.length:
            part, rest = self.fitting(rest, self.length)
            if len(part[2]) == 4 * self.length:
                yield [part]
            else:
                self.pool.append([part])
        while rest:
            part, rest = self.fitting(rest, self.length)
            self.put(part)
        if len(self.pool) >= WINDOW:
            yield from self.window()

    def fitting(self, piece: Piece, n: int) -> tuple[Piece, Piece | None]:
        """At most ``n`` ids of a piece that keep to the loss limit, and the rest."""
        part, rest = cut_piece(piece, n)
        while self.loss(part[2]) > self.loss_limit and n > 1:
            n = min(n, len(part[2]) // 4) // 2
            part, rest = cut_piece(piece, n)
        return part, rest

    def put(self, piece: Piece) -> None:
        if len(piece[2]) >= 4 * BUNDLE:
            self.pool.append([piece])
            return
        if self.bundle and (np.array(self.need([*self.bundle, piece])) > self.limits).any():
            self.pool.append(self.bundle)
            self.bundle, self.held = [], 0
        self.bundle.append(piece)
        self.held += len(piece[2]) // 4
        if self.held >= BUNDLE or 8 * len(self.bundle) >= self.segments:
            self.pool.append(self.bundle)
            self.bundle, self.held = [], 0

    def bins(self) -> Iterator[tuple[int, list[list[Piece]]]]:
        need = np.array([self.need(item) for item in self.pool], float)
        for mine in fill(need, self.limits):
            items = [self.pool[i] for i in mine]
            yield sum(map(tokens, items)), items

    def window(self) -> Iterator[list[Piece]]:
        """Sequences that came out full; the items of the others stay, but for the fullest if those were too many."""
        left = []
        for used, items in self.bins():
            if used >= self.length - SLACK:
                yield [p for item in items for p in item]
            else:
                left.append((used, items))
        left.sort(key=lambda x: -x[0])
        loose: list[Piece] = []
        while left and sum(len(items) for _, items in left) + len(loose) > WINDOW // 2:
            pieces = [p for item in left.pop(0)[1] for p in item]
            if not loose and left:
                loose = [p for item in left.pop()[1] for p in item]
            done = list(self.close(pieces, loose))
            yield done[0]
            loose += [p for more in done[1:] for p in more]
        self.pool = [item for _, items in left for item in items if len(item) > 1]
        for piece in [item[0] for _, items in left for item in items if len(item) == 1] + loose:
            self.put(piece)

    def close(self, pieces: list[Piece], donors: list[Piece]) -> Iterator[list[Piece]]:
        """``pieces`` filled up with cuts of ``donors`` (which are used up from the end), then, if still short, the
        largest power of two of its ids, and after it what that leaves."""
        used, segments, loss = self.need(pieces)
        while used < self.length and donors and segments < self.segments:
            part, rest = cut_piece(donors.pop(), self.length - used)
            if loss + self.loss(part[2]) > self.loss_limit:
                donors.append(part if rest is None else (part[0], part[1], part[2] + rest[2], part[3]))
                break
            pieces.append(part)
            used, segments, loss = used + len(part[2]) // 4, segments + 1, loss + self.loss(part[2])
            if rest:
                donors.append(rest)
        if used >= self.length - SLACK or used & (used - 1) == 0:
            yield pieces
            return
        size, mine, queue = 1 << (used.bit_length() - 1), [], pieces[::-1]
        while size:
            part, rest = cut_piece(queue.pop(), size)
            mine.append(part)
            size -= len(part[2]) // 4
            if rest:
                queue.append(rest)
        yield mine
        yield queue[::-1]

    def finish(self) -> Iterator[list[Piece]]:
        """All that is left, in lengths that are full or powers of two."""
        if self.bundle:
            self.pool.append(self.bundle)
        rest = []
        for used, items in self.bins() if self.pool else ():
            pieces = [p for item in items for p in item]
            if used >= self.length - SLACK:
                yield pieces
            else:
                rest += pieces
        self.pool, self.bundle, self.held = [], [], 0
        while rest:
            done = list(self.close([rest.pop()], rest))
            yield done[0]
            rest += [p for more in done[1:] for p in more]


def pack_documents(docs: DataFrame, length: int = LENGTH, segments: int | None = None, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, the ids."""
    path = path or vocabulary_path()
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, SequencePacker(length, segments)
        base, made, rows = TaskContext.get().partitionId() << 33, 0, []

        def take(sequences: Iterator[list[Piece]]) -> None:
            nonlocal made
            for pieces in sequences:
                offset = 0
                for doc, start, ids, count in pieces:
                    n = len(ids) // 4
                    rows.append((doc, start, n, zlib.crc32(ids), count, base + made, offset) + ((np.frombuffer(ids, "<i4"),) if with_ids else ()))
                    offset += n
                made += 1

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                take(packer.add(doc, encode(text.as_py() or "") + end))
                if len(rows) >= 20_000:
                    yield out()
        take(packer.finish())
        if rows:
            yield out()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(pack, ddl)


def pack_examples(examples: DataFrame, key: str, demands: list[str], limits: list[float]) -> DataFrame:
    """Place whole examples, say chat turns, under simultaneous limits: columns ``key``, bin_id.

    Examples are packed in windows of a task's rows, across batches; bins that are less than nine tenths full in every
    demand go back to the pool until the task ends. Null demands count as 0. An example that alone exceeds a limit can't
    be placed whole: its bin_id is null.
    """
    kind = examples.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, base, made = np.array(limits, float), TaskContext.get().partitionId() << 33, 0
        names, pool = [], np.zeros((0, len(demands)))

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal made, names, pool
            keys, bins, stay = [], [], []
            for mine in fill(pool, top):
                full = (pool[mine].sum(axis=0) >= 0.9 * top).any()
                if not last and not full:
                    stay.append(mine)
                    continue
                keys += [names[i] for i in mine]
                bins += [base + made] * len(mine)
                made += 1
            stay.sort(key=lambda mine: -(pool[mine].sum(axis=0) / top).max())
            while sum(map(len, stay)) > WINDOW // 2:
                mine = stay.pop(0)
                keys += [names[i] for i in mine]
                bins += [base + made] * len(mine)
                made += 1
            left = [i for mine in stay for i in mine]
            names, pool = [names[i] for i in left], pool[left]
            return pa.record_batch([pa.array(keys, key_type), pa.array(bins, pa.int64())], names=["key", "bin_id"])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            need = np.stack([np.nan_to_num(batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float)) for i in range(len(demands))], axis=1) if batch.num_rows else np.zeros((0, len(demands)))
            fits, own = (need <= top).all(axis=1), batch.column(0).to_pylist()
            large = np.flatnonzero(~fits)
            if len(large):
                yield pa.record_batch([batch.column(0).take(pa.array(large)), pa.nulls(len(large), pa.int64())], names=["key", "bin_id"])
            small = np.flatnonzero(fits)
            for at in range(0, len(small), WINDOW):
                part = small[at : at + WINDOW]
                names, pool = names + [own[i] for i in part], np.concatenate([pool, need[part]])
                if len(names) >= WINDOW:
                    yield settle(False)
        if names:
            yield settle(True)

    return examples.select(key, *(examples[d].cast("double") for d in demands)).mapInArrow(place, f"key {kind}, bin_id long").withColumnRenamed("key", key)


def conversation_demands(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Per conv_id: tokens (an end id after each turn), turns, and loss_tokens (those of the assistant's turns).

    Null texts are empty and null roles bear no loss; rows with a null conv_id are one conversation.
    """
    path = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            found = [len(encode(text.as_py() or "")) // 4 + 1 for text in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["conv_id", "role", "n"])

    sized = turns.selectExpr("cast(conv_id as long) as conv_id", "role", "text").mapInArrow(count, "conv_id long, role string, n long")
    loss = F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0))
    return sized.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("turns"), loss.alias("loss_tokens"))


def pack_conversations(turns: DataFrame, length: int = LENGTH, segments: int = 16, loss_limit: int = 1536, path: str | None = None) -> DataFrame:
    """Whole conversations in bins of at most ``length`` tokens, ``segments`` turns and ``loss_limit`` loss-bearing tokens.

    One row per conv_id: conv_id, tokens, turns, loss_tokens, bin_id (null for one that exceeds a limit by itself).
    """
    sized = materialize(conversation_demands(turns, path), "pack-demands")
    placed = pack_examples(sized, "conv_id", ["tokens", "turns", "loss_tokens"], [length, segments, loss_limit])
    bins = placed.select(F.col("conv_id").alias("_conv"), "bin_id")
    return sized.join(bins, sized["conv_id"].eqNullSafe(bins["_conv"])).select("conv_id", "tokens", "turns", "loss_tokens", "bin_id")
