"""Joins and sets that come up again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.temporal import following_days
from panelforge.storage import materialize


def without(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in `excluded`; a null key never is."""
    return df.join(excluded.select(*keys).distinct(), keys, "left_anti")


def within_keys(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in `wanted`, each once."""
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


def membership_flag(df: DataFrame, members: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """`df` with a column that says whether its keys are in `members`."""
    return df.join(members.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left").withColumn(flag, F.coalesce("_in", F.lit(False))).drop("_in")


def latest_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def contained_sets(elements: DataFrame, sets: DataFrame, holder: str, name: str, element: str, ignored: tuple[str, ...] = (), broadcast_up_to: int = 50_000) -> DataFrame:
    """(holder, name) where the holder has every element of the named set, and each that isn't in `ignored` more than once.

    A set of ignored elements alone matches nothing, empty elements are dropped. Names of equal sets are one set, found by its two rarest elements:
    elements that no set has go first (by a broadcast of the others up to `broadcast_up_to`, counted before), then a holder's elements are joined to
    the first of the two, met with the second ones there, and only sets that have both are compared as a whole. Of elements partitioned by `holder`
    neither the rows nor the counts are shuffled.
    """
    wanted = sets.where((F.col(element) != "") & F.col(name).isNotNull()).select(name, element).distinct()
    spread = wanted.groupBy(element).agg(F.count("*").alias("_sets"))
    plain = F.col(element).isin(list(ignored)) if ignored else F.lit(False)
    ordered = wanted.join(spread.hint("merge"), element).groupBy(name).agg(
        F.transform(F.sort_array(F.collect_list(F.when(~plain, F.struct("_sets", element)))), lambda s: s[element]).alias("_keys"), F.sort_array(F.collect_list(F.when(plain, F.col(element)))).alias("_plain"))
    equal = ordered.where(F.size("_keys") > 0).groupBy("_keys", "_plain").agg(F.collect_list(name).alias("_names"))
    # an empty second element stands for none
    equal = materialize(equal.select(F.col("_keys")[0].alias("_a"), F.when(F.size("_keys") > 1, F.get("_keys", F.lit(1))).otherwise("").alias("_b"), F.expr("slice(_keys, 3, greatest(size(_keys) - 2, 0))").alias("_rest"), "_plain", "_names"), "sets")

    parts = F.array(F.struct(F.col("_a").alias("e"), F.lit(True).alias("first")), F.struct(F.col("_b").alias("e"), F.lit(False).alias("first")))
    others = F.transform(F.concat("_rest", "_plain"), lambda e: F.struct(e.alias("e"), F.lit(False).alias("first")))
    known = equal.select(F.explode(F.concat(parts, others)).alias("x")).groupBy(F.col("x.e").alias(element)).agg(F.max("x.first").alias("_first")).where(F.col(element) != "")
    few = known.limit(broadcast_up_to + 1).count() <= broadcast_up_to
    if few:
        counts = elements.join(F.broadcast(known), element).groupBy(holder, element, "_first").agg(F.count("*").alias("_n"))
    else:
        counts = elements.groupBy(holder, element).agg(F.count("*").alias("_n")).join(known.hint("merge"), element)
    held = counts.where(plain | (F.col("_n") > 1)).groupBy(holder).agg(
        F.collect_list(F.when(~plain, F.col(element))).alias("_held"), F.collect_list(F.when(plain, F.col(element))).alias("_held_plain"), F.collect_list(F.when(~plain & F.col("_first"), F.col(element))).alias("_firsts"))
    seconds = equal.groupBy("_a").agg(F.collect_set("_b").alias("_seconds"))
    starts = held.select(holder, "_held", "_held_plain", F.explode("_firsts").alias("_a")).join(seconds.hint("merge"), "_a")
    pairs = starts.select(holder, "_held", "_held_plain", "_a", F.explode(F.array_intersect("_seconds", F.concat("_held", F.array(F.lit(""))))).alias("_b"))
    whole = lambda part, of: (F.size(part) == 0) | (F.size(F.array_except(part, of)) == 0)
    found = pairs.join(equal.hint("merge"), ["_a", "_b"]).where(whole("_rest", "_held") & whole("_plain", "_held_plain"))
    return found.select(holder, F.explode("_names").alias(name))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`current` with the rows of `changes` in place of those of the same keys."""
    return without(current, changes, keys).unionByName(changes)


def insert_new(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`current` and the rows whose keys it lacks; of rows with the same keys one."""
    return current.unionByName(without(rows.dropDuplicates(keys), current, keys))


def override(base: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of both, that of `overrides` where it has the keys."""
    return base.select(*keys, F.col(value).alias("_b")).join(overrides.select(*keys, F.col(value).alias("_o")), keys, "full").select(*keys, F.coalesce("_o", "_b").alias(value))


def joiners_and_leavers(presence: DataFrame, key: str, day: str) -> DataFrame:
    """(key, day, change): keys that a snapshot has and the one before lacks (`join`), or the other way round (`leave`)."""
    pairs = following_days(presence, day).where(F.col("_next").isNotNull()).withColumnRenamed(day, "_day")
    here = presence.select(key, day).dropna().distinct()
    before = here.join(pairs, F.col(day) == F.col("_day")).select(key, F.col("_next").alias(day))
    first = here.join(pairs.select(F.col("_next").alias(day)), day, "left_semi").select(key, day)
    joined = first.join(before, [key, day], "left_anti").withColumn("change", F.lit("join"))
    return joined.union(before.join(here, [key, day], "left_anti").withColumn("change", F.lit("leave")))
