"""Deterministic sharded WARC archives: write, commit, read back.

Records are range-sorted by page id, each range is written by one task as gzip members, and a file is rolled once its
compressed size passes a limit. Headers and digests are made anew from the payload, with a fixed date and ids derived
from content, so a second attempt of a task writes the same bytes. Tasks write under temporary names and report them in
a manifest table; Spark's commit keeps only the reports of attempts that succeeded, a second job renames those files,
readers follow the manifest alone, and what other attempts left behind is deleted.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is a response and the
others are revisit records that refer to it. Defined cases: null html is an empty payload; a null url becomes
``urn:page:<id>``; rows that repeat the same page id and payload are all written as the same kind; a row with a null
page id revisits if it can; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, scratch_dir

#: Compressed bytes after which a file is rolled, and payload bytes a task sorts and writes.
ROLL_BYTES, TASK_BYTES = 16 << 20, 16 << 20
#: A payload with more copies than HOT, or than 1 in HOTS of all copies, is joined apart from the others.
HOT, HOTS = 4096, 8192
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with an HTTP block, or a revisit with the HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url is not None else f"urn:page:{page_id}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one after another."""
    unzip, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(size)):
        parts.append(unzip.decompress(data))
        data = b""
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts, data = zlib.decompressobj(31), [], unzip.unused_data
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> dict:
    """Fields of a record, its digests checked against its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload}


def _with_keepers(rows: DataFrame, twins: DataFrame, limit: int) -> DataFrame:
    """``rows`` with the keeper of their mark, null for those without twins.

    Up to ``limit`` marks are broadcast. Beyond it, marks of more than HOT rows, or than 1 in HOTS of all rows with twins,
    still are (HOTS at most), and rows that found theirs so are dealt by page in the shuffle that the other marks need.
    """
    count, total = twins.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= limit:
        return rows.join(F.broadcast(twins.select("mark", "keeper")), "mark", "left")
    hot = max(HOT, total // HOTS)
    heavy = twins.where(F.col("n") > hot).select("mark", F.col("keeper").alias("_heavy"))
    light = twins.where(F.col("n") <= hot).select(F.col("mark").alias("_mark"), F.col("keeper").alias("_light"))
    rows = rows.join(F.broadcast(heavy), "mark", "left")
    key = F.when(F.col("_heavy").isNull(), F.col("mark")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("_key", key).join(light, F.col("_key") == F.col("_mark"), "left")
    return rows.withColumn("keeper", F.coalesce("_heavy", "_light")).drop("_heavy", "_light", "_key", "_mark")


def plan_records(pages: DataFrame, min_bytes: int = 0, limit: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, payload (null in revisits' stead kept), refers_to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    marks = rows.select("page_id", F.sha1("payload").alias("mark"), F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= min_bytes)
    twins = materialize(marks.groupBy("mark", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("mark", "keeper", "n"), "warc-twins")
    rows = _with_keepers(rows.withColumn("mark", F.sha1("payload")), twins, limit)
    later = (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper"))) & (F.octet_length("payload") >= min_bytes)
    return rows.select("page_id", "url", "payload", F.when(later, F.col("keeper")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Write ``pages`` under ``folder``; gives the manifest: path, records, bytes, first and last page id."""
    spark = pages.sparkSession
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    tasks = max(1, -(-total // task_bytes))
    ranged = plan_records(pages, min_bytes).repartitionByRange(int(tasks), F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        where.create_dir(posixpath.join(base, "_tmp"), recursive=True)
        task, tries = TaskContext.get().partitionId(), uuid.uuid4().hex
        done, now = [], None

        def shut() -> None:
            now["stream"].close()
            done.append((now["temp"], now["name"], now["records"], now["bytes"], now["first"], now["last"]))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c for c in batch.columns), strict=True):
                if now is None:
                    name = f"pages-{task:06d}-{len(done):04d}.warc.gz"
                    temp = f"_tmp/{name}.{tries}"
                    now = {"name": name, "temp": temp, "stream": where.open_output_stream(posixpath.join(base, temp), compression=None), "records": 0, "bytes": 0, "first": page_id.as_py(), "last": None}
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = zipper.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())) + zipper.flush()
                now["stream"].write(data)
                now["records"], now["bytes"], now["last"] = now["records"] + 1, now["bytes"] + len(data), page_id.as_py()
                if now["bytes"] >= roll_bytes:
                    shut()
                    now = None
        if now:
            shut()
        kinds = [("temp", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]
        yield pa.record_batch([pa.array([d[i] for d in done], k) for i, (_, k) in enumerate(kinds)], schema=pa.schema(kinds))

    written = materialize(ordered.mapInArrow(write, "temp string, name string, records long, bytes long, first long, last long"), "warc-written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist(), strict=True):
                temp, name = posixpath.join(base, temp), posixpath.join(base, name)
                if where.get_file_info(temp).type != pyarrow.fs.FileType.NotFound:  # else an earlier attempt renamed it
                    where.move(temp, name)
            yield batch.select(["name", "records", "bytes", "first", "last"])

    manifest = f"{folder}/_manifest"
    written.mapInArrow(rename, "name string, records long, bytes long, first long, last long").write.mode("overwrite").parquet(manifest)
    _sweep(folder)
    return spark.read.parquet(manifest)


def _sweep(folder: str) -> None:
    """Files that failed or repeated attempts left behind go once the manifest names the others."""
    where, base = pyarrow.fs.FileSystem.from_uri(folder)
    left = posixpath.join(base, "_tmp")
    if where.get_file_info(left).type != pyarrow.fs.FileType.NotFound:
        where.delete_dir(left)


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the files that the manifest names, each digest checked."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    files = manifest.count()
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds += [("payload", pa.binary())] * with_payload
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with where.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for raw in _members(stream):
                        rows.append(parse(raw))
                        held += len(raw)
                        if not with_payload:
                            rows[-1].pop("payload")
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return manifest.repartition(max(1, files), "name").mapInArrow(read, ddl)


def archive_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
