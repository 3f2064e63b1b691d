"""Line-delimited JSON as a data source of its own: byte-range splits, an early stop, bad lines beside the good ones.

A line belongs to the split that holds its first byte, so splits of one file can be read apart. With a limit each split
stops after that many good lines, and what is left is put in order by file and place, so the first rows of a folder cost a few
lines of each split instead of a scan. Lines end at line feeds; blank lines give nothing; a line that isn't JSON, or not
UTF-8, is bad and keeps its text.

Files are listed and read through Arrow's file systems (``file://``, ``hdfs://``, ``s3://`` and the like, or plain paths).
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
SCHEMA = "file string, place long, line string, good boolean"


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


def _opened(path: str):
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pyarrow.fs.LocalFileSystem(), posixpath.abspath(path))


class Lines(DataSource):
    """Format ``json_lines`` with the options path, splitBytes and most (good lines of a split; 0 for all)."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        self.most = int(options.get("most", 0))
        if self.size < 1 or self.most < 0:
            raise ValueError("splitBytes is positive and most isn't negative")

    def partitions(self) -> list[Split]:
        """Byte ranges of the files, in order of name; names that begin with a dot or underscore are left out."""
        where, path = _opened(self.path)
        found = where.get_file_info(path)
        if found.type == pyarrow.fs.FileType.NotFound:
            return []
        files = [found] if found.is_file else where.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        seen = sorted((f.path, f.size) for f in files if f.is_file and not any(x[:1] in "._" for x in f.path[len(path) :].split("/") if x and not found.is_file))
        return [Split(name, at, min(at + self.size, size)) for name, size in seen for at in range(0, size, self.size)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder has no splits
            return
        where, _ = _opened(self.path)
        schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("line", pa.string()), ("good", pa.bool_())])
        rows, good, held = [], 0, 0
        with where.open_input_file(partition.file) as stream:
            for place, line in _lines(stream, partition.start, partition.end):
                text = line.decode("utf-8", "replace").strip()
                if not text:
                    continue
                ok = _is_json(line, text)
                rows.append((partition.file, place, text, ok))
                good, held = good + ok, held + len(line)
                if held > 4 << 20:
                    yield _batch(rows, schema)
                    rows, held = [], 0
                if self.most and good >= self.most:
                    break
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _is_json(line: bytes, text: str) -> bool:
    try:
        line.decode("utf-8")
        json.loads(text)
    except ValueError:  # JSONDecodeError and UnicodeDecodeError are of this kind
        return False
    return True


def _lines(stream, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines whose first byte is in the range; the last may go on beyond it."""
    at = start
    if start:  # the line that holds the byte before belongs to an earlier split, unless it ends there
        stream.seek(start - 1)
        while chunk := stream.read(block):
            cut = chunk.find(b"\n")
            if cut >= 0:
                at = stream.tell() - len(chunk) + cut + 1
                break
        else:
            return
    stream.seek(at)
    parts: list[bytes] = []  # of a line that isn't whole yet
    while at < end:
        chunk = stream.read(block)
        if not chunk:
            if parts:
                yield at, b"".join(parts)
            return
        first, *others = chunk.split(b"\n")
        parts.append(first)
        for line in others:
            if at >= end:
                return
            whole = b"".join(parts)
            yield at, whole
            at, parts = at + len(whole) + 1, [line]


def json_lines(spark: SparkSession, path: str, most: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, place, line, good: the lines of a file or folder that aren't blank."""
    spark.dataSource.register(Lines)
    return spark.read.format("json_lines").options(path=path, splitBytes=str(split_bytes), most=str(most)).load()


def tolerant_rows(spark: SparkSession, path: str, schema: str, limit: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The columns of ``schema`` and _corrupt, the text of a bad line; values that don't fit a column are null.

    With a ``limit``, the first so many good lines in order of file and place, without bad ones; 0 and None give all.
    """
    lines = json_lines(spark, path, limit or 0, split_bytes)
    if limit:
        lines = lines.where("good").orderBy("file", "place").limit(limit)
    parsed = lines.withColumn("_row", F.when(F.col("good"), F.from_json("line", schema)))
    return parsed.select("_row.*", F.when(~F.col("good"), F.col("line")).alias("_corrupt"))


def line_counts(lines: DataFrame) -> DataFrame:
    """good and bad_lines of ``json_lines``, one row."""
    return lines.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad_lines"))
