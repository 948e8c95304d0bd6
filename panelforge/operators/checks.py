"""Constraints of the data model as queries that return the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping_windows(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose window begins before an earlier one of the same key has ended; one with a null end never does."""
    order = Window.partitionBy(*keys).orderBy(F.asc(start), F.asc_nulls_last(end)).rowsBetween(Window.unboundedPreceding, -1)
    busy = df.withColumn("_busy", F.max(end).over(order)).withColumn("_open", F.max(F.col(end).isNull()).over(order))
    return busy.where(F.col("_open") | (F.col(start) < F.col("_busy"))).drop("_busy", "_open")


def failing(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_rows): how many rows break each rule; a rule that is null for a row isn't broken, as in SQL."""
    counts = df.agg(*[F.count(F.when(~rule, 1)).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in rules])).alias("x")).select("x.*")


def orphans(df: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows whose reference isn't in `parent`; one with a null refers to nothing."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in columns.items()]).distinct()
    return df.dropna(subset=list(columns)).join(keys, list(columns), "left_anti")


def outside_window(df: DataFrame, day: Column, lo: Column, hi: Column) -> DataFrame:
    """Rows whose day isn't within [lo, hi); one with a null day or bound breaks nothing."""
    return df.where(lo.isNotNull() & hi.isNotNull() & ((day < lo) | (day >= hi)))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def implies(condition: Column, consequence: Column) -> Column:
    return ~condition | consequence


def expect_count(df: DataFrame, expected: int) -> DataFrame:
    """Expected and actual number of rows, and whether they agree."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("expected", F.lit(expected).cast("long")).withColumn("ok", F.col("n_rows") == F.col("expected"))
