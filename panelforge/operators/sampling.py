"""Seeded samples that don't depend on how rows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def uniform_subset(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows in a seeded random order of their id. Spark keeps the `n` first of each partition, so no full sort is made."""
    return df.orderBy(seeded_key(seed, id_column), id_column).limit(n)


def sample_by_session(df: DataFrame, groups: list[str], id_column: str, cap: Column, seed: int = 42) -> DataFrame:
    """At most `cap` distinct ids of each group, all equally likely; a cap of 0 keeps none.

    The candidates of a group are first cut within salts of it, so a hot group isn't ranked in one task.
    """
    one = df.dropDuplicates([*groups, id_column]).withColumn("_key", seeded_key(seed, id_column)).withColumn("_cap", cap)
    salted = Window.partitionBy(*groups, F.pmod(F.col("_key"), F.lit(32))).orderBy("_key", id_column)
    first = one.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= F.col("_cap"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("_key", id_column))).where(F.col("_n") <= F.col("_cap")).select(*df.columns)
