"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

import duckdb
import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alder birch cedar doves ember flint grove heath iris juniper kelp larch moss nettle oak pine quartz reed sedge thorn umber violet willow yarrow".split()


def prose(seed: int, words: int, per_line: int = 12) -> str:
    dice = random.Random(seed)
    out = [dice.choice(WORDS) + str(dice.randrange(50)) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + per_line]) for i in range(0, words, per_line))


def corpus() -> list[tuple]:
    """Documents with shared lines, exact and near copies, and odd rows; repeated rows and a null doc_id at the end."""
    shared = "This line stands in many documents of the corpus, word for word."
    rows = [(i, prose(i, 60 + i), "en", ["a", "b", None, "d"][i % 4], i) for i in range(20)]
    rows += [(20 + i, prose(100 + i, 40) + f"\n  {shared.upper() if i % 2 else shared}\t\n" + prose(200 + i, 20), None, "a", 1) for i in range(6)]
    base = prose(300, 200)
    rows += [(30, base, "en", "b", 1), (31, base, "en", "b", 1), (32, base.replace("\n", " "), "en", "d", 1), (33, base + " and four more words", "en", "b", None)]
    rows += [(40, None, None, None, None), (41, "", "en", "a", 0), (42, " \t\n", "en", "a", 3), (43, "two words", "en", "a", 9), (44, "two words", "de", "b", 9)]
    rows += [(50, "ü漢😀 " * 300, "ja", "\U0001f600", 3), (51, prose(400, 9000), "en", "a", 1), (52, prose(401, 30) + " " + base[:400] + " " + prose(402, 30), "en", "a", 1)]
    rows += [(None, base, "en", "a", 1), (5, rows[5][1], "en", "b", 5), (5, rows[5][1], "en", "b", 5)]
    return rows


def documents(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)


def clashing(docs):
    """The same rows with columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in ("key", "size", "rate", "pos", "line", "count", "shard", "block", "cluster", "rk", "g", "label", "score", "h1", "n", "a", "b")})


def written(df, folder, name: str) -> str:
    df.write.mode("overwrite").parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def by_sql(sql: str, **tables) -> pd.DataFrame:
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows that compare and sort, whatever library made them."""
    value = lambda v: "null" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else f"{float(v):.6g}"
    return sorted(tuple(map(value, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
