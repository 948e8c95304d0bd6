"""JSON and XML payloads of web sources as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUARTERS = "map<string, struct<filing_date: string, totalAssets: string, totalLiab: string, commonStockSharesOutstanding: string>>"
BARS = "array<struct<date: string, open: double, high: double, low: double, close: double, adjusted_close: double, volume: double>>"
ENTRY = "id string, title string, updated string, category struct<_term: string>, link struct<_href: string>"


def quarters(df: DataFrame, payload: str, start: str, end: str, keys: list[str], grace_days: int = 90) -> DataFrame:
    """(keys, filing_date, book_equity, shares_outstanding) of a JSON map by quarter; a payload that is no object gives none.

    Quarters ended up to `grace_days` before the window and filed within it count; equity needs both of its parts.
    """
    rows = df.select(*keys, start, end, F.explode(F.from_json(payload, QUARTERS)).alias("quarter", "q"))
    number = lambda c: F.col(f"q.{c}").try_cast("double")
    filed = F.try_to_date("q.filing_date", "yyyy-MM-dd")
    ended = F.try_to_date("quarter", "yyyy-MM-dd")
    return rows.where((ended >= F.date_sub(start, grace_days)) & (filed >= F.col(start)) & (filed < F.col(end))).select(
        *keys, filed.alias("filing_date"), (number("totalAssets") - number("totalLiab")).alias("book_equity"), number("commonStockSharesOutstanding").alias("shares_outstanding"))


def bars(df: DataFrame, payload: str, start: str, end: str, keys: list[str]) -> DataFrame:
    """(keys, trading_day, open ... volume) of a JSON list of bars within start <= day < end; a payload that is no list gives none."""
    rows = df.select(*keys, start, end, F.explode(F.from_json(payload, BARS)).alias("b")).withColumn("trading_day", F.try_to_date("b.date", "yyyy-MM-dd"))
    return rows.where((F.col("trading_day") >= F.col(start)) & (F.col("trading_day") < F.col(end))).select(*keys, "trading_day", "b.open", "b.high", "b.low", "b.close", "b.adjusted_close", "b.volume")


def captures(df: DataFrame, payload: str, keys: list[str], url: str = "original", ts: str = "timestamp") -> DataFrame:
    """(keys, url, captured_at) of an index whose first row has the names of the others' fields."""
    parsed = df.select(*keys, F.from_json(payload, "array<array<string>>").alias("rows")).where(F.size("rows") > 1)
    header = F.element_at("rows", 1)
    each = parsed.select(*keys, header.alias("h"), F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("r"))
    cell = lambda name: F.try_element_at("r", F.array_position("h", name).cast("int"))
    has = (F.array_position("h", url) > 0) & (F.array_position("h", ts) > 0)
    return each.where(has).select(*keys, cell(url).alias("url"), F.try_to_timestamp(cell(ts), F.lit("yyyyMMddHHmmss")).alias("captured_at"))


def feed_entries(spark: SparkSession, path: str, root: str = "feed") -> DataFrame:
    """Entries of XML feeds; a file with another root has none."""
    return spark.read.schema(ENTRY).option("rowTag", "entry").option("ignoreNamespace", "true").format("xml").load(path)


def entry_form(category: Column, title: Column) -> Column:
    """Form type of a feed entry: its category, else the first word of its title."""
    return F.upper(F.trim(F.coalesce(F.nullif(F.trim(category), F.lit("")), F.element_at(F.split(F.trim(title), r"\s+"), 1))))


def report_items(texts: Column, eligible: tuple[str, ...]) -> tuple[Column, Column]:
    """Numbers and descriptions of `Item N.NN: text` entries whose number is eligible, aligned."""
    parsed = F.transform(texts, lambda t: F.struct(F.regexp_extract(t, r"Item\s+(\d+\.\d+)", 1).alias("n"), F.trim(F.regexp_extract(t, r"Item\s+\d+\.\d+:?\s*(.*)", 1)).alias("d")))
    kept = F.filter(parsed, lambda s: s.n.isin(list(eligible)))
    return F.transform(kept, lambda s: s.n), F.transform(kept, lambda s: s.d)


def raw_record(candidate: Column, start: Column, end: Column, entry: Column | None = None) -> Column:
    """JSON of a candidate and its window, with the feed entry if there is one."""
    parts = [candidate.alias("candidate"), F.struct(F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(end, "yyyy-MM-dd").alias("end")).alias("validity_window")]
    return F.to_json(F.struct(*parts, *([entry.alias("atom_entry")] if entry is not None else [])))
