"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, a target is set for each source, and ``rate = target / size`` tells how often a document
of the source is repeated: ``floor(rate)`` times, and once more with probability ``rate - floor(rate)``. That last draw
is a Bernoulli trial seeded by a hash of the document's id, so a rerun takes the same copies. For each source the seed
is the one of ``SEEDS`` fixed seeds whose total comes nearest to the target.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows are separate
documents with the same draws; an empty table gives an empty result; other columns pass through untouched (internal
columns start with ``_mix_``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, null_safe_key, small

#: Candidate seeds per source; four 32-bit draws come from each MD5.
SEEDS = 16
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``sized`` (doc_id, key, size) and ``plan``, one row per source: key, source, source_size, target, rate, seed."""

    sized: DataFrame
    plan: DataFrame
    sources: int


def words(col: str) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id and the seed."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed // 4}"))
    hexes = F.substring(F.md5(text.cast("binary")), 1 + 8 * (seed % 4), 8)
    return F.conv(hexes, 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(totals: DataFrame, cycle: int = 3, max_repeat: float = 3.0) -> DataFrame:
    """Targets from (source, source_size): weights 1..``cycle`` in code-point order, nulls last, with a ceiling.

    A target above ``max_repeat`` times its source's size stops there and the excess is shared again by weight. With
    sources in order of size per weight, those at the ceiling are a prefix, so running sums give the fixed point
    without iterating. The windows run over one row per source, after aggregation.
    """
    ranked = totals.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("double"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(max_repeat))
    filled = (
        ranked.withColumn("cap", cap)
        .withColumn("at", F.row_number().over(order))
        .withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
        .withColumn("first", F.min(F.when(~F.col("capped"), F.col("at"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("at") < F.coalesce(F.col("first"), F.col("at") + 1), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, source: str = "source", size: Column | None = None, cycle: int = 3, max_repeat: float = 3.0) -> Mix:
    """Read ``docs`` once for the sizes, then derive each source's target, rate and seed."""
    size = words("text") if size is None else size
    sized = materialize(docs.select("doc_id", F.col(source).alias("source"), size.alias("size")), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(0.0))
    targets = materialize(targets.withColumn("rate", rate).withColumn("key", null_safe_key("source")), "mix-targets")
    n = targets.count()

    part = F.col("rate") - F.floor("rate")
    joined = sized.withColumn("key", null_safe_key("source")).join(small(targets.select("key", "rate"), n), "key")
    took = joined.groupBy("key").agg(*(F.sum(F.when(draw(F.col("doc_id"), k) < part, F.col("size")).otherwise(0)).alias(f"t{k}") for k in range(SEEDS)))
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    misses = F.array(*(F.abs(F.col(f"t{k}") - wanted) for k in range(SEEDS)))
    plan = targets.join(took, "key").withColumn("_m", misses)
    plan = plan.select("key", "source", "source_size", "target", "rate", (F.array_position("_m", F.array_min("_m")) - 1).cast("int").alias("seed"))
    return Mix(sized.withColumn("key", null_safe_key("source")), materialize(plan, "mix-plan"), n)


def copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    """Copies of a document: floor(rate), and one more if its draw is below the fraction."""
    draws = F.array(*(draw(doc_id, k) for k in range(SEEDS)))
    return (F.floor(rate) + F.when(F.element_at(draws, seed + 1) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies and taken words."""
    mix = plan_mix(docs, **options)
    df = mix.sized.drop("source").join(small(mix.plan, mix.sources), "key").withColumn("copies", copies(F.col("doc_id"), F.col("rate"), F.col("seed")))
    return df.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    mix = plan_mix(docs, source=source, **options)
    plan = small(mix.plan.select(F.col("key").alias("_mix_key"), F.col("rate").alias("_mix_rate"), F.col("seed").alias("_mix_seed")), mix.sources)
    df = docs.withColumn("_mix_key", null_safe_key(source)).join(plan, "_mix_key")
    df = df.withColumn("_mix_n", copies(F.col("doc_id"), F.col("_mix_rate"), F.col("_mix_seed"))).where("_mix_n > 0")
    df = df.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n"))))
    return df.select(*docs.columns)
