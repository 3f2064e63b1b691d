"""Registered queries over line-delimited JSON that Spark writes from the documents, broken lines between."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import lines
from .queries import query, t

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, sf) -> str:
    """Documents as JSON lines in order of doc_id; every seventh is followed by a broken line, every fifth by a blank one."""
    d, k = t(spark, sf, "documents"), F.col("doc_id")
    line = F.to_json(F.struct(*(F.col(c.split()[0]) for c in DOCUMENT.split(", "))))
    after = F.concat(F.when(k % 7 == 0, F.concat(F.lit('\n{"doc_id": '), k.cast("string"), F.lit(", broken"))).otherwise(""), F.when(k % 5 == 0, "\n  ").otherwise(""))
    path = shared_folder(spark, "json-lines")
    d.repartitionByRange(8, k).sortWithinPartitions(k).select(F.concat(line, after).alias("value")).write.text(path)
    return path


@query("SELECT doc_id, sha256(text) AS text_sha256, lang, n_chars, NULL AS _corrupt FROM documents UNION ALL SELECT NULL, NULL, NULL, NULL, '{\"doc_id\": ' || doc_id || ', broken' FROM documents WHERE doc_id % 7 = 0")
def jsonl_tolerant(spark, sf):
    rows = lines.tolerant_rows(spark, written(spark, sf), DOCUMENT, split_bytes=1 << 20)
    return rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "lang", "n_chars", "_corrupt")


@query("SELECT doc_id, sha256(text) AS text_sha256, source FROM documents ORDER BY doc_id LIMIT 300")
def jsonl_first_rows(spark, sf):
    rows = lines.tolerant_rows(spark, written(spark, sf), DOCUMENT, limit=300, split_bytes=1 << 20)
    return rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "source")


@query("SELECT count(*) AS good, count(*) FILTER (WHERE doc_id % 7 = 0) AS bad_lines FROM documents")
def jsonl_line_counts(spark, sf):
    return lines.line_counts(lines.json_lines(spark, written(spark, sf), split_bytes=1 << 20))
