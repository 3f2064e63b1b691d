"""The share of traffic of a model, carried from run to run: as keyed state of a stream, and as a fold over history.

Each policy's reports are taken in order of their time. A report that isn't later than the last one taken is late: it is
given back as such and changes nothing, in the stream as in the batch form, where reports of one time count once, the
first by their values. State is one small row per policy, so it grows with the policies and not with their reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

START, STEP = 0.5, 0.08
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RATIOS = "policy string, at timestamp, before double, ratio double, late boolean"


def next_ratio(current: float, gap: float, a: float, b: float, step: float = STEP) -> float:
    """``operators.sentiment.adaptive_ratio`` for one report."""
    fastest = max(a, b)
    target = current + 0.25 * (0.75 * gap + 0.25 * ((a - b) / fastest if fastest else 0.0))
    return max(0.0, min(1.0, current + max(-step, min(step, target - current))))


class Ratios(StatefulProcessor):
    """Ratio and time of the last report of each policy."""

    def __init__(self, start: float, step: float):
        self.start, self.step = start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ratio double, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ratio, last = (self.last.get()[0], pd.Timestamp(self.last.get()[1])) if self.last.exists() else (self.start, None)
        reports = pd.concat(list(rows)).sort_values(["at", "accuracy_gap", "a_rps", "b_rps"])
        out = []
        for at, gap, a, b in reports[["at", "accuracy_gap", "a_rps", "b_rps"]].itertuples(index=False):
            if last is not None and at <= last:
                out.append((key[0], at, ratio, ratio, True))
                continue
            before, ratio, last = ratio, next_ratio(ratio, gap, a, b, self.step), at
            out.append((key[0], at, before, ratio, False))
        self.last.update((ratio, last.to_pydatetime()))
        yield pd.DataFrame(out, columns=["policy", "at", "before", "ratio", "late"])

    def close(self) -> None:
        pass


def whole(reports: DataFrame) -> DataFrame:
    return reports.where("policy is not null and at is not null").select("policy", "at", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("accuracy_gap", "a_rps", "b_rps")))


def ratio_stream(reports: DataFrame, start: float = START, step: float = STEP) -> DataFrame:
    """policy, at, before, ratio, late for streamed reports (policy, at, accuracy_gap, a_rps, b_rps); null numbers are 0,
    reports without policy or time have no row. Needs the RocksDB state store, see ``use_rocks``."""
    return whole(reports).groupBy("policy").transformWithStateInPandas(Ratios(start, step), outputStructType=RATIOS, outputMode="Append", timeMode="None")


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def ratio_history(reports: DataFrame, start: float = START, step: float = STEP) -> DataFrame:
    """The same rows from a table of all reports: each policy's reports, a row per run, folded in order of time."""
    numbers = F.struct("at", "accuracy_gap", "a_rps", "b_rps")
    rows = whole(reports).groupBy("policy").agg(F.array_sort(F.collect_list(numbers)).alias("r"))

    def after(acc, r):
        fastest = F.greatest(r["a_rps"], r["b_rps"])
        speed = F.coalesce((r["a_rps"] - r["b_rps"]) / F.nullif(fastest, F.lit(0.0)), F.lit(0.0))
        last = F.element_at(acc, -1)
        late = F.coalesce(r["at"] <= last["at"], F.lit(False))
        move = 0.25 * (0.75 * r["accuracy_gap"] + 0.25 * speed)
        target = last["ratio"] + move
        new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), last["ratio"] + F.greatest(F.lit(-step), F.least(F.lit(step), target - last["ratio"]))))
        return F.array_append(acc, F.struct(r["at"].alias("at"), last["ratio"].alias("before"), F.when(late, last["ratio"]).otherwise(new).alias("ratio"), late.alias("late")))

    first = F.array(F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(float(start)).alias("before"), F.lit(float(start)).alias("ratio"), F.lit(False).alias("late")))
    folded = rows.select("policy", F.explode(F.slice(F.aggregate("r", first, after), F.lit(2), F.greatest(F.size("r"), F.lit(1)))).alias("x"))
    return folded.select("policy", "x.*")
