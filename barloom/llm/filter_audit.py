"""What each filter of a cleaning recipe does in every order of the filters, per part of the corpus.

Exact duplicates are found by sorting: documents are range-sorted by a fingerprint of the text and doc_id, sorted by
fingerprint, full text and doc_id inside each range, and each row is compared with its predecessor. A group of equal texts
that touches the edge of a range may go on in the next one, so the smallest doc_id of such a group is exchanged through a
table with a row per edge. The ranges don't have the text among their keys, since the sample that sets their limits
passes through the driver; fingerprints shared by different texts at an edge are told apart by the texts in that table.

Each document's failures are the bits of a mask. Masks are counted per part, which is additive, and what a filter removes,
removes again or loses in any order follows from these few counts: no order is run over documents.

Defined cases: a null text is empty; a null source is the part ''; a row with a null doc_id is never a duplicate and no
other row's first; rows that repeat a doc_id and its text are duplicates only of smaller doc_ids; of several labels of a
document the larger counts, and documents without one are neither good nor toxic; an empty table gives no rows; columns
other than those named are not read.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task sorts.
TASK_BYTES = 32 << 20


def quality_filters(text: str = "text") -> dict[str, Column]:
    """The conditions on a text alone under which filters A to D remove it."""
    body = text_or_empty(text)
    blanks = F.translate(body, "\t\n\x0b\x0c\r", " " * 5)
    found = F.array_remove(F.split(blanks, " "), "")
    words, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": words < 200,
        "B": F.lit(100) * distinct < F.lit(50) * words,
        "C": F.lit(100) * capitals > F.lit(2) * F.length(body),
        "D": body.rlike(r"[#$%&*|]"),
    }


def duplicate_rows(rows: DataFrame, text: str, doc_id: str, keep: dict[str, Column], task_bytes: int = TASK_BYTES) -> DataFrame:
    """``doc_id`` and the columns ``keep`` of each row, and ``duplicate``: whether a smaller doc_id has the same text.

    The columns ``keep`` are computed after the sort, so that the sample behind its ranges doesn't compute them too. Their
    names must differ from doc_id, body, mark, first and edge, those of ``rows`` from ``_mark`` and ``_any``.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    spread = rows.withColumns({"_mark": F.xxhash64(text), "_any": F.rand(7)})  # rows that repeat a doc_id and its text may part anywhere
    ranged = spread.repartitionByRange(max(1, -(-size // task_bytes)), "_mark", F.col(doc_id).asc_nulls_last(), "_any")
    ordered = ranged.sortWithinPartitions("_mark", text, F.col(doc_id).asc_nulls_last())
    ordered = ordered.select(*(c.alias(n) for n, c in keep.items()), F.col(doc_id).alias("doc_id"), F.col("_mark").alias("mark"), F.col(text).alias("body"))
    keep = list(keep)
    kinds = [("doc_id", pa.int64()), ("first", pa.int64()), ("edge", pa.int64()), ("mark", pa.int64()), ("body", pa.string())]
    ddl = ", ".join([f"`{c}` {ordered.schema[c].dataType.simpleString()}" for c in keep] + ["doc_id long, first long, edge long, mark long, body string"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its group's number and the smallest doc_id of its group in this range; then a row with mark and
        text for each group that touches the range's edges."""
        made, group, lead, tail, kept = TaskContext.get().partitionId() << 33, None, [], [], None
        for batch in batches:
            n, ids, bodies = batch.num_rows, batch.column("doc_id"), batch.column("body")
            if not n:
                continue
            kept = batch.select(keep)
            marks, starts = batch.column("mark").to_numpy(), np.ones(n, bool)
            starts[0] = group is None or marks[0] != group[1] or bodies[0].as_py() != group[2]
            starts[1:] = (marks[1:] != marks[:-1]) | pc.not_equal(bodies.slice(1), bodies.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(starts)
            numbers = made + np.cumsum(starts)
            since = np.maximum.accumulate(np.where(starts, np.arange(1, n + 1), 0))  # 0: the group that the last batch ended with
            firsts = pa.concat_arrays([pa.array([group and group[3]], pa.int64()), ids]).take(pa.array(since))
            name = lambda i: (int(numbers[i]), int(marks[i]), bodies[i].as_py(), ids[i].as_py())
            lead_mark = lead[0][1] if lead else marks[0]
            lead += [name(i) for i in at[marks[at] == lead_mark].tolist()]
            if tail and tail[0][1] != marks[-1]:
                tail = []
            tail += [name(i) for i in at[marks[at] == marks[-1]].tolist()]
            made = int(numbers[-1])
            last = since[-1] - 1
            group = (made, int(marks[-1]), bodies[n - 1].as_py(), ids[last].as_py() if last >= 0 else group[3])
            empty = pa.nulls(n, pa.int64())
            yield pa.record_batch([*kept.columns, ids, firsts, pa.array(numbers), empty, pa.nulls(n, pa.string())], names=[*keep, *(k for k, _ in kinds)])
        edges = [e for e in {g[0]: g for g in lead + tail}.values() if e[3] is not None]
        if edges:
            data = [pa.nulls(len(edges), f.type) for f in kept.schema] + [pa.nulls(len(edges), pa.int64())]
            data += [pa.array([e[i] for e in edges], t) for i, t in ((3, pa.int64()), (0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
            yield pa.record_batch(data, names=[*keep, *(k for k, _ in kinds)])

    found = materialize(ordered.mapInArrow(compare, ddl), "audit-sorted")
    edges = found.where("mark is not null").select("edge", "mark", "body", "first")
    shared = edges.groupBy("mark", "body").agg(F.min("first").alias("least"), F.collect_list("edge").alias("edges")).where(F.size("edges") > 1)
    moved = materialize(shared.select(F.explode("edges").alias("edge"), "least"), "audit-edges")
    joined = found.where("mark is null").join(small(moved, moved.count()), "edge", "left")
    duplicate = F.coalesce(F.col("doc_id") > F.least("first", F.coalesce("least", "first")), F.lit(False))
    return joined.select(F.col("doc_id").alias(doc_id), *keep, duplicate.alias("duplicate"))


def failure_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str = "source", columns: tuple[str, ...] = ()) -> DataFrame:
    """_part, _mask, n, good, toxic: documents by part and by the set of filters they fail; bit i is the i-th filter's.

    The filter after the given ones is that of exact duplicates.
    """
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), text_or_empty(F.col(part).cast("string")).alias("_part"), *columns)
    found = duplicate_rows(rows, "text", "doc_id", {"_part": F.col("_part"), "_mask": mask.cast("long")})
    whole = (F.col("_mask") + F.when(F.col("duplicate"), F.lit(1 << len(filters))).otherwise(F.lit(0))).alias("_mask")
    counted = found.select("doc_id", "_part", whole).groupBy("doc_id", "_part", "_mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    joined = counted.join(marks, "doc_id", "left")
    has = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return joined.groupBy("_part", "_mask").agg(F.sum("n").alias("n"), has("quality").alias("good"), has("toxic").alias("toxic"))


def order_report(cells: DataFrame, letters: str) -> DataFrame:
    """The additive cells of each part, read in every order of the filters: one row per part, order and step."""
    steps = []
    for order in itertools.permutations(letters):
        before = 0
        for k, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            steps.append({"o": "".join(order), "k": k, "bit": bit, "before": before})
            before |= bit
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, k: int, bit: long, before: long>>")
    parts = cells.groupBy("_part").agg(F.collect_list(F.struct("_mask", "n", "good", "toxic")).alias("cells"))  # a row per mask
    df = parts.withColumn("s", F.explode(plan))
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(count: str, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(when(c["_mask"]), c[count]).otherwise(F.lit(0)))

    fails, earlier = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    orders = math.factorial(len(letters))
    # of the orders, one in so many as a document fails filters puts a given one of these first
    share = lambda c: F.when(fails(c["_mask"]), c["n"] * F.element_at(F.array(*(F.lit(orders // k).cast("long") for k in range(1, len(letters) + 1))), F.bit_count(c["_mask"]).cast("int"))).otherwise(F.lit(0))
    return df.select(
        F.col("_part").alias("part"),
        F.col("s.o").alias("filter_order"),
        F.col("s.k").alias("step"),
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + share(c)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "source", columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter removes and loses there.

    ``filters`` maps letters to the conditions under which a row of ``docs`` fails; by default A to D of
    ``quality_filters``. They may read the text (null as empty) and the ``columns`` named. The letter after the last stands for exact duplicates.
    """
    filters = quality_filters() if filters is None else filters
    letters = "".join(filters) + chr(ord(max(filters, default="@")) + 1)
    return order_report(materialize(failure_cells(docs, labels, filters, part, columns), "audit-cells"), letters)
