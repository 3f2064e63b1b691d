"""Token ids in binary files: frequency-ranked, byte-aligned codes of variable length with separate control bytes.

Texts are tokenized once into a scratch table. Ids are counted over all of it and ranked by frequency, so the commonest
256 take one byte and the next 65,280 take two. The ids are then range-sorted by doc_id and each range is written by one
task, rolled into files. A file holds blocks; a block holds a table of documents, then control bytes with four two-bit
lengths each, then the bytes of the ranks alone. Readers look lengths up in a table by control byte and gather the bytes
of a whole block at once with numpy.

Files are written under temporary names, reported in a scratch table of which Spark's commit keeps the attempts that
succeeded, renamed by a second job, and named in a manifest with their document and id counts, from which readers know
how many ids stand before each file. The id of each rank stands in ``ranks.u32`` beside them.

Defined cases: a null or empty text gives the end id alone; rows with a null doc_id come first; rows that repeat a doc_id
are separate documents in the order of their number of ids and checksum; an empty table gives an empty folder with a manifest;
columns other than doc_id and text are not read. Texts of any length are cut into blocks, and a document may span several.
"""

from __future__ import annotations

import functools
import itertools
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_dir
from .warc import _sweep

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Ids of a block, encoded bytes after which a file is rolled, and bytes of ids that a task sorts and writes.
BLOCK_IDS, ROLL_BYTES, TASK_BYTES = 1 << 18, 32 << 20, 16 << 20
#: Entries of a worker's caches from pieces of text to ids, and code points of the longest piece kept there.
CACHE, LONGEST = 600_000, 40
MAGIC = b"RVB1"
_HEAD = "<IIII"  # documents, ids, control bytes, data bytes
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("ids", "<u4"), ("flags", "u1")])
NO_ID, GOES_ON = 1, 2
_CHUNK = re.compile(r"\s*\S+|\s+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: What keeps a text from being split at blanks alone: other white space or separators, two of blanks and line ends in
#: a row, or a comma or full stop after anything but a letter or digit.
_UNEVEN = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|(?:^|[^\p{L}\p{N}])[,.]"
#: In front of a text's first piece, which has no blank before it, and the piece that stands for the end id.
_FIRST, _END = "\x1d", "\x1e"
#: Bytes of text that are split at a time.
SLICE = 4 << 20

#: For each control byte, the lengths of its four codes; for each length, the bits that its bytes hold.
LENGTHS = np.array([[(byte >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for byte in range(256)], np.uint8)
BITS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """Ids of whole texts, each with the end id, as little-endian bytes of ``dtype``.

    The vocabulary's pre-tokenizer never joins a character with white space that follows it, nor a letter or digit with a
    comma or full stop, so the ids of a text are those of its pieces, and common pieces stay in a cache. Texts with single
    blanks are split at blanks, many at a time, and a piece stands for its word with the blank before it; line ends, commas
    and full stops begin pieces without one. Other texts are cut before white space. Those with the four ASCII separators,
    which libraries class differently, are encoded whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.size = max(*names.values(), end_id) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known, self.late, self.chunks = {_FIRST: b"", _END: self.end}, {}, {}
        self.blank = np.zeros(self.size, bool)
        self.blank[[i for name, i in names.items() if name.startswith("\u0120")]] = True  # the vocabulary's sign for a blank

    def encode(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text in order; null texts are empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
            part = texts.slice(at, stop - at)
            uneven = pc.match_substring_regex(part, _UNEVEN)
            split = self.split(part.filter(pc.invert(uneven)))
            for odd, text in zip(uneven.to_pylist(), part, strict=True):
                yield self.cut(text.as_py()) if odd else next(split)
            at = stop

    def split(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Ids of texts that are split at blanks: each different piece is looked up once, then ids are gathered for all."""
        for mark in "\n,.":
            texts = pc.replace_substring(texts, mark, f" {mark}")
        lists = pc.split_pattern(pc.binary_join_element_wise(_FIRST, texts, f" {_END}", ""), " ")
        pieces = lists.flatten().dictionary_encode()
        which = pieces.indices.to_numpy()
        found = self.look(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known, self.after_blank)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * self.dtype.itemsize
        for a, b in itertools.pairwise(bounds.tolist()):
            yield ids[a:b]

    def cut(self, text: str) -> bytes:
        if _SEPARATORS.search(text):
            return self.plain([text])[0] + self.end
        return b"".join(self.look(_CHUNK.findall(text), self.chunks, self.plain)) + self.end

    def look(self, pieces: list[str], known: dict[str, bytes], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each piece, learned where the cache lacks them; once it is full, new ones go to one that is emptied."""
        ids = list(map(known.get, pieces))
        holes = [i for i, x in enumerate(ids) if x is None]
        if not holes:
            return ids
        late = self.late if known is self.known else {}
        missing = {pieces[i] for i in holes}
        found = {p: late[p] for p in missing if p in late}
        new = [p for p in missing if p not in found]
        found |= zip(new, learn(new), strict=True)
        if len(late) > CACHE // 4:
            late.clear()
        if known is self.known or len(known) < CACHE // 8:
            (known if len(known) < CACHE else late).update((p, found[p]) for p in new if len(p) <= LONGEST)
        for i in holes:
            ids[i] = found[pieces[i]]
        return ids

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def after_blank(self, pieces: list[str]) -> list[bytes]:
        """Words of letters are encoded as one text, where each begins with an id that holds its blank."""
        words = [p for p in pieces if p.isalpha()]
        found = dict(zip(words, self.words(words), strict=True))
        other = [p for p in pieces if p not in found]
        found |= zip(other, self.plain([p.removeprefix(_FIRST) if p[:1] in ("\n", ",", ".", _FIRST) and p else f" {p}" for p in other]), strict=True)
        return [found[p] for p in pieces]

    def words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(f" {w}" for w in words)], add_special_tokens=False)[0].ids, self.dtype)
        starts = np.flatnonzero(self.blank[ids])
        if len(starts) != len(words):
            return self.plain([f" {w}" for w in words])
        raw, cuts = ids.tobytes(), (starts * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


@functools.cache
def encoder(path: str, end_id: int) -> ByteEncoder:
    """One per Python worker, so that its cache outlives a task."""
    return ByteEncoder(path, end_id)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers."""
    ranks = ranks.astype("<u4")
    longer = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fours = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    fours[: len(ranks)] = longer
    control = (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= longer[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers again: lengths by table, then one gather over all."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    if (int(ends[-1]) if n else 0) != len(data):
        raise ValueError("control bytes and data bytes disagree")
    raw, at = np.frombuffer(data + bytes(3), np.uint8), ends - lengths
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        out |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return out & BITS[lengths]


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, crc (of the ids as 32-bit numbers), ids (little-endian, as wide as the vocabulary needs)."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, end_id)
        for batch in batches:
            rows, held = [], 0
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                wide = np.frombuffer(ids, own.dtype)
                rows.append((doc, len(wide), zlib.crc32(wide.astype("<u4")), ids))
                held += len(ids)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, crc long, ids binary")


def ids_by_frequency(tokens: DataFrame, dtype: np.dtype, vocabulary: int) -> np.ndarray:
    """All ids that occur, commonest first, ties by id: counted in each task, summed by Spark, at most one row per entry."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype), minlength=vocabulary) if len(ids.as_buffer()) > 1 << 16 else 0
            short = b"".join(x.as_py() for x in batch.column(0) if len(x.as_buffer()) <= 1 << 16)
            total += np.bincount(np.frombuffer(short, dtype), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    totals = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = totals.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return found["id"].to_numpy("<u4")


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, roll_bytes: int = ROLL_BYTES, task_bytes: int = TASK_BYTES, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of ``docs`` under ``folder`` in ascending doc_id order; gives the manifest: name, documents, ids, bytes, ids_before."""
    path = path or vocabulary_path()
    own = encoder(path, end_id)
    dtype, vocabulary = own.dtype, own.size
    tokens = materialize(tokenize(docs, path, end_id), "token-ids", compression="zstd")
    by_rank = ids_by_frequency(tokens, dtype, vocabulary)
    rank_of = np.zeros(vocabulary, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))
    where, base = pyarrow.fs.FileSystem.from_uri(folder)
    where.create_dir(posixpath.join(base, "_tmp"), recursive=True)
    with where.open_output_stream(posixpath.join(base, "ranks.u32"), compression=None) as out:
        out.write(by_rank.tobytes())

    size = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] * dtype.itemsize
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "crc"]
    spread = tokens.withColumn("_any", F.rand(7))  # equal rows are interchangeable, so they may part anywhere
    ranged = spread.repartitionByRange(max(1, -(-size // task_bytes)), *order, "_any").drop("_any").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        task, tries, done, now = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None
        table, parts, held = [], [], 0

        def block() -> None:
            nonlocal held
            control, data = encode_ranks(rank_of[np.concatenate(parts)])
            raw = struct.pack(_HEAD, len(table), held, len(control), len(data)) + np.array(table, _DOCUMENT).tobytes() + control + data
            now["stream"].write(raw)
            now["bytes"] += len(raw)
            table.clear()
            parts.clear()
            held = 0

        def shut() -> None:
            if table:
                block()
            now["stream"].close()
            done.append(tuple(now[k] for k in ("temp", "name", "documents", "ids", "bytes")))

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if now is None:
                    name = f"ids-{task:06d}-{len(done):04d}.rvb"
                    now = {"name": name, "temp": f"_tmp/{name}.{tries}", "documents": 0, "ids": 0, "bytes": len(MAGIC)}
                    now["stream"] = where.open_output_stream(posixpath.join(base, now["temp"]), compression=None)
                    now["stream"].write(MAGIC)
                ids, at = np.frombuffer(ids.as_buffer(), dtype), 0
                now["documents"], now["ids"] = now["documents"] + 1, now["ids"] + len(ids)
                while at < len(ids):
                    part = ids[at : at + block_ids - held]
                    at += len(part)
                    table.append((doc or 0, len(part), NO_ID * (doc is None) + GOES_ON * (at < len(ids))))
                    parts.append(part)
                    held += len(part)
                    if held >= block_ids:
                        block()
                if now["bytes"] >= roll_bytes:
                    shut()
                    now = None
        if now:
            shut()
        kinds = [("temp", pa.string()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]
        yield pa.record_batch([pa.array([d[i] for d in done], k) for i, (_, k) in enumerate(kinds)], schema=pa.schema(kinds))

    written = materialize(ranged.select("doc_id", "ids").mapInArrow(write, "temp string, name string, documents long, ids long, bytes long"), "token-files")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist(), strict=True):
                temp, name = posixpath.join(base, temp), posixpath.join(base, name)
                if where.get_file_info(temp).type != pyarrow.fs.FileType.NotFound:  # else an earlier attempt renamed it
                    where.move(temp, name)
            yield batch.select(["name", "documents", "ids", "bytes"])

    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest = f"{folder}/_manifest"
    named = materialize(written.mapInArrow(rename, "name string, documents long, ids long, bytes long"), "token-names")
    named.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.mode("overwrite").parquet(manifest)
    _sweep(folder)
    return docs.sparkSession.read.parquet(manifest)


def _blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The document table and the ranks of each block of a file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    while head := stream.read(struct.calcsize(_HEAD)):
        documents, n, controls, size = struct.unpack(_HEAD, head)
        table, control, data = (stream.read(k) for k in (documents * _DOCUMENT.itemsize, controls, size))
        yield np.frombuffer(table, _DOCUMENT), decode_ranks(control, data, n)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files that the manifest names: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    Without ``with_ids`` a task holds one block at a time.
    """
    manifest = spark.read.parquet(f"{folder}/_manifest")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        with where.open_input_stream(posixpath.join(base, "ranks.u32"), compression=None) as stream:
            by_rank = np.frombuffer(stream.read(), "<u4")
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("ids_before").to_pylist(), strict=True):
                rows, count, crc, kept = [], 0, 0, []
                with where.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for table, ranks in _blocks(stream):
                        ids, at = by_rank[ranks], 0
                        for doc, n, flags in table.tolist():
                            part = ids[at : at + n]
                            at, count, crc = at + n, count + n, zlib.crc32(part, crc)
                            if with_ids:
                                kept.append(part.astype(np.int32))
                            if flags & GOES_ON:
                                continue
                            rows.append((None if flags & NO_ID else doc, start, count, crc) + ((np.concatenate(kept),) if with_ids else ()))
                            start, count, crc, kept = start + count, 0, 0, []
                        if rows:
                            yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return manifest.select("name", "ids_before").repartition(max(1, manifest.count()), "name").mapInArrow(read, ddl)


def token_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
