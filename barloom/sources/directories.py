"""Symbol directories: exchange tables in HTML, pipe-delimited files, ex-rights notices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import minguo_date
from ..functions.numbers import parsed
from ..functions.text import is_share, trimmed_name
from ..operators.actions import kind_of
from ..operators.symbols import first_wins


def _cells(row: Column) -> Column:
    raw = F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.transform(raw, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>|&nbsp;", " "), r"[\s　]+", " ")))


#: The boards' names, as an ISIN table's fourth cell gives them.
LISTED, COUNTER = "上市", "上櫃"


def isin_table(pages: DataFrame, html: str = "html", board: Column | None = None) -> DataFrame:
    """Entries of an ISIN table: rows of six cells and more whose first is a code and a name and whose sixth, the CFI
    code, says share (ES) or fund (CE). Rows that name no board are of ``board``, else listed."""
    pages = pages.select(html, (F.lit(LISTED) if board is None else board).alias("_board"))
    rows = pages.select("_board", F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r")).select("_board", _cells(F.col("r")).alias("c")).where("size(c) >= 6")
    at = lambda i: F.get("c", F.lit(i))
    head, cfi, board = at(0), at(5), F.coalesce(F.nullif(at(3), F.lit("")), F.col("_board"))
    code, name = F.regexp_extract(head, r"^([0-9A-Z]{4,6})\s+(.+)$", 1), F.regexp_extract(head, r"^([0-9A-Z]{4,6})\s+(.+)$", 2)
    kind = F.when(cfi.startswith("ES"), "stock").when(cfi.startswith("CE"), "etf")
    market = F.when(F.contains(board, F.lit(COUNTER)), "TWO").otherwise("TW")
    out = rows.select(code.alias("code"), F.concat(code, F.lit("."), market).alias("symbol"), name.alias("name_zh"), F.lit(None).cast("string").alias("name_en"), market.alias("market"), kind.alias("kind"), at(2).alias("listed_at"), at(4).alias("industry"))
    return out.where("code <> '' and kind is not null")


def read_boards(spark: SparkSession, listed: str, counter: str) -> DataFrame:
    """Entries of both boards' pages, saved as they are sent: in MS950, which no header says."""

    @F.pandas_udf("string")
    def ms950(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("cp950", "replace"))

    pages = [spark.read.format("binaryFile").load(path).select(ms950("content").alias("html"), F.lit(board).alias("board")) for path, board in ((listed, LISTED), (counter, COUNTER))]
    return isin_table(pages[0].unionByName(pages[1]), board=F.col("board"))


def symbol_file(lines: DataFrame, exchange: str, name_at: int = 1, test_at: int | None = 3, etf_at: int | None = 6, order: int = 0, exchange_at: int | None = None) -> DataFrame:
    """Entries of a pipe-delimited file (value): no header, footer, test issues or instruments that aren't shares."""
    f = lines.where(~F.col("value").startswith("File Creation Time")).select(F.split("value", r"\|").alias("f")).where(F.size("f") > max(x for x in (name_at, test_at, etf_at, exchange_at) if x is not None))
    at = lambda i: F.trim(F.get("f", F.lit(i)))
    code, name = F.upper(at(0)), at(name_at)
    good = code.rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$") & ~at(0).isin("Symbol", "ACT Symbol", "NASDAQ Symbol") & is_share(name)
    good = good if test_at is None else good & (F.upper(at(test_at)) != "Y")
    kind = F.lit("stock") if etf_at is None else F.when(F.upper(at(etf_at)) == "Y", "etf").otherwise("stock")
    symbol, where = F.translate(code, ".", "-"), F.lit(exchange) if exchange_at is None else at(exchange_at)
    return f.where(good).select(symbol.alias("code"), symbol.alias("symbol"), F.lit(None).cast("string").alias("name_zh"), trimmed_name(name).alias("name_en"), F.lit("US").alias("market"), kind.alias("kind"), where.alias("exchange"), F.lit(order).alias("file_order"))


def merged_files(*files: DataFrame) -> DataFrame:
    """Files in order; a code keeps its first entry."""
    every = files[0]
    for f in files[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    return first_wins(every, "code", "file_order").drop("file_order")


#: Names under which notices carry each field.
KEYS = {
    "date": ["Date", "date", "資料日期", "除權除息日期"], "code": ["Code", "code", "股票代號"], "name": ["Name", "name", "名稱", "股票名稱"], "kind_label": ["Type", "kind", "權/息", "權息"],
    "before_price": ["BeforePrice", "before_price", "除權息前收盤價"], "reference_price": ["ReferencePrice", "reference_price", "除權息參考價"], "value": ["Value", "value", "權值+息值"],
}


def ex_rights(payloads: DataFrame, json: str = "json") -> DataFrame:
    """Records of notices in either shape: {data: [{..}]}, or {fields: [..], data: [[..]]}."""
    keyed = F.from_json(json, "data array<map<string,string>>")["data"]
    table = F.from_json(json, "fields array<string>, data array<array<string>>")
    rows = F.when(F.size(table["fields"]) > 0, F.transform(table["data"], lambda r: F.map_from_entries(F.filter(F.arrays_zip(table["fields"].alias("k"), r.alias("v")), lambda e: e.getField("k").isNotNull())))).otherwise(keyed)
    r = payloads.select(F.explode(rows).alias("r"))
    pick = lambda k: F.coalesce(*(F.try_element_at("r", F.lit(n)) for n in KEYS[k]))
    label = pick("kind_label")
    out = r.select(minguo_date(pick("date")).alias("date"), F.trim(pick("code")).alias("code"), F.trim(pick("name")).alias("name"), kind_of(F.coalesce(label, F.lit(""))).alias("kind"), label.alias("kind_label"), *(parsed(pick(k)).alias(k) for k in ("before_price", "reference_price", "value")), F.lit("exchange").alias("source"))
    return out.where("date is not null and code <> ''")


def first_answering(*sources: DataFrame) -> DataFrame:
    """The rows of the first source that has any; none if all are empty. Sources have the same columns."""
    every = sources[0].withColumn("_source", F.lit(0))
    for n, source in enumerate(sources[1:], 1):
        every = every.unionByName(source.withColumn("_source", F.lit(n)))
    best = every.agg(F.min("_source").alias("_best"))  # one row
    return every.join(F.broadcast(best), F.col("_source") == F.col("_best")).drop("_source", "_best")


def since(records: DataFrame, as_of: Column, years: int = 5) -> DataFrame:
    """Records of the last years of 365 days, one at least."""
    return records.where((F.col("date") >= F.date_sub(as_of, 365 * max(1, years))) & (F.col("date") <= as_of))
