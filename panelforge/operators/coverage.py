"""Continuous periods and gaps of overlapping, nested, touching or gapped day windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First day after every real window: the exclusive end of a window that never ends.
NEVER = 2**31 - 1
#: Shard number of pieces that cover whole shards.
WHOLE = -(2**31)
WINDOW_TEXT = r"^\s*([\[(])\s*(\d{4}-\d{2}-\d{2})\s*,\s*(\d{4}-\d{2}-\d{2})?\s*([\])])\s*$"


def window_bounds(text: Column) -> Column:
    """struct(lo int, hi int): first day and first day after it, as days since 1970-01-01, of the text of a date range.

    `[`/`]` include and `(`/`)` exclude their bound, a missing upper bound gives `NEVER`. Null for null, `empty`,
    text that is no range, a date that does not exist, and a range that holds no day.
    """
    part = lambda i: F.regexp_extract(text, WINDOW_TEXT, i)
    day = lambda i: F.unix_date(part(i).try_cast("date"))
    lo = day(2) + F.when(part(1) == "(", 1).otherwise(0)
    hi = F.when(part(3) == "", F.lit(NEVER)).otherwise(day(3) + F.when(part(4) == "]", 1).otherwise(0))
    return F.when(text.rlike(WINDOW_TEXT) & (lo < hi), F.struct(lo.alias("lo"), hi.cast("int").alias("hi")))


def _runs(df: DataFrame, group: list[str]) -> DataFrame:
    """Unions of touching [lo, hi) rows within each group, as (group, lo, hi)."""
    ordered = Window.partitionBy(*group).orderBy("lo", "hi")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("lo") > F.max("hi").over(before)).cast("int"), F.lit(1))
    return (
        df.withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "_run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_run")
    )


def merge_periods(df: DataFrame, keys: list[str], bounds: Column, shard_days: int = 512) -> DataFrame:
    """(keys, kind, lo, hi): the maximal periods covered by each entity's windows and the gaps between two of them.

    `bounds` is struct(lo int, hi int) of days, [lo, hi), `hi` = `NEVER` where a window has no end. Rows with null bounds,
    an empty window or a null key count for nothing; repeated rows and extra columns have no effect; an entity without a
    day has no row; an empty table gives an empty result.

    Two levels, so that no task holds all rows of a huge entity: every window is clipped at shard bounds into a head, a
    tail and one piece for the whole shards between; pieces that start together are one before the shuffle (a shard has
    at most `shard_days` starts, whatever the row count); each (entity, shard) is merged alone; the runs, at most one for
    two days of the calendar, are then stitched across shard bounds per entity, where the gaps come out too.
    """
    if shard_days < 1:
        raise ValueError("shard_days must be positive")
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    first = F.floor(lo / F.lit(shard_days)).cast("int")
    last = F.when(hi == NEVER, F.lit(NEVER // shard_days)).otherwise(F.floor((hi - 1) / F.lit(shard_days))).cast("int")
    edge = lambda s: (s.cast("long") * shard_days)
    piece = lambda shard, a, b: F.struct(shard.alias("shard"), a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    head = piece(first, lo, F.when(first == last, hi.cast("long")).otherwise(edge(first + 1)))
    whole_end = F.when(hi == NEVER, F.lit(NEVER).cast("long")).otherwise(edge(last))
    whole = F.when(edge(first + 1) < whole_end, piece(F.lit(WHOLE), edge(first + 1), whole_end))
    tail = F.when((first < last) & (hi != NEVER), piece(last, edge(last), hi))
    pieces = (
        df.dropna(subset=keys).select(*keys, bounds.alias("_b"))
        # no filter on the bounds: it would be pushed below and parse each window again for every mention of them
        .select(*keys, F.explode(F.when(lo < hi, F.array(head, whole, tail))).alias("_p"))
        .where(F.col("_p").isNotNull())
        .select(*keys, F.col("_p.shard").alias("_shard"), F.col("_p.lo").alias("lo"), F.col("_p.hi").alias("hi"))
        .groupBy(*keys, "_shard", "lo")
        .agg(F.max("hi").alias("hi"))
    )
    periods = _runs(_runs(pieces, [*keys, "_shard"]).drop("_shard"), keys)
    following = F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo"))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("lo").alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.lit("gap").alias("kind"), F.col("hi").alias("lo"), F.col("_next").alias("hi")),
    )
    return (
        periods.withColumn("_next", following)
        .select(*keys, F.explode(rows).alias("_r"))
        .select(*keys, "_r.kind", "_r.lo", "_r.hi")
        .where(F.col("hi").isNotNull())
    )


def day_text(day: Column) -> Column:
    """Days since 1970-01-01 as YYYY-MM-DD, `NEVER` as `infinity`."""
    return F.when(day == NEVER, F.lit("infinity")).otherwise(F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd"))
