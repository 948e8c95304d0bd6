"""Joins and windows along time: as-of, intervals, presence, returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, values: list[str], tolerance_days: int) -> DataFrame:
    """`left` with the `values` of the key's latest right row whose day is not after the left day and at most `tolerance_days` before it.

    A right row of the same day counts. Of right rows of one day the greatest values do. Unmatched left rows get nulls, as do those
    with a null key or day. A right row can only answer within the tolerance, so time is cut into spans of that length and a
    right row stands in its own span and the next: a hot key is spread over its spans, and one pass of a window answers.
    """
    width = tolerance_days + 1
    span = lambda c: F.floor(F.unix_date(c) / F.lit(width)).cast("int")
    hit = F.struct(F.col(right_day).alias("day"), *[F.col(v) for v in values])
    newest = right.where(F.col(key).isNotNull() & F.col(right_day).isNotNull()).groupBy(key, right_day).agg(F.max(F.struct(*values)).alias("_v")).select(key, right_day, "_v.*")
    sides = newest.select(F.col(key).alias("_key"), F.explode(F.array(span(F.col(right_day)), span(F.col(right_day)) + 1)).alias("_span"), F.col(right_day).alias("_day"), F.lit(0).alias("_side"), hit.alias("_hit"))
    asked = left.select(F.struct(*left.columns).alias("_left"), F.col(key).alias("_key"), span(F.col(left_day)).alias("_span"), F.col(left_day).alias("_day"), F.lit(1).alias("_side"))
    order = Window.partitionBy("_key", "_span").orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(sides, allowMissingColumns=True).withColumn("_found", F.last("_hit", ignorenulls=True).over(order))
    near = (F.datediff("_day", "_found.day") <= tolerance_days) & F.col("_key").isNotNull()
    return both.where("_side = 1").select("_left.*", F.when(near, F.col("_found.day")).alias(right_day), *[F.when(near, F.col(f"_found.{v}")).alias(v) for v in values])


def interval_join(events: DataFrame, windows: DataFrame, keys: list[str], day: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Equal keys and start <= day < end."""
    return events.join(windows, [*[events[k] == windows[k] for k in keys], (events[day] >= windows[start]) & (events[day] < windows[end])], how)


def window_days(windows: DataFrame, keys: list[str], start: str, end: str, days: DataFrame, day: str) -> DataFrame:
    """(keys, day) for the `days` that lie in each window: windows are spelled out and joined by equality, so there is no range join."""
    spelled = windows.where(F.col(start) < F.col(end)).select(*keys, F.explode(F.sequence(F.col(start), F.date_sub(end, 1))).alias(day)).distinct()
    return spelled.join(days.select(day).distinct(), day).select(*keys, day)


def following_days(df: DataFrame, day: str) -> DataFrame:
    """(day, _next): the distinct days and the one after each. One row for each day of a calendar, so one task can order them."""
    return df.select(day).dropna().distinct().withColumn("_next", F.lead(day).over(Window.orderBy(day)))


def presence_windows(presence: DataFrame, key: str, day: str, snapshots: DataFrame, end_date: str) -> DataFrame:
    """(key, start_day, end_day): runs of snapshots that hold the key; a run ends at the first snapshot without it, a last one the day after `end_date`."""
    numbered = following_days(snapshots, day)
    here = presence.select(key, day).dropna().distinct().join(numbered, day)
    order = Window.partitionBy(key).orderBy(day)
    opens = F.coalesce((F.lag("_next").over(order) != F.col(day)).cast("int"), F.lit(1))
    runs = here.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min(day).alias("start_day"), F.max_by(F.struct("_next"), day).alias("_last")).select(
        key, "start_day", F.coalesce(F.col("_last._next"), F.date_add(F.lit(end_date).cast("date"), 1)).alias("end_day"))


def rewrite_aliases(df: DataFrame, symbol: str, day: str, aliases: DataFrame) -> DataFrame:
    """`df` with `symbol` replaced where an alias row (alias, canonical, start_date, end_date) holds on the day; of several the first canonical. A null end_date is no end."""
    asked = df.select(F.col(symbol).alias("alias"), F.col(day).alias("_day")).dropna().distinct()
    best = asked.join(aliases, "alias").where((F.col("_day") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("_day") < F.col("end_date")))).groupBy("alias", "_day").agg(F.min("canonical").alias("_canonical"))
    return df.join(best, (F.col(symbol) == F.col("alias")) & (F.col(day) == F.col("_day")), "left").withColumn(symbol, F.coalesce("_canonical", symbol)).select(*df.columns)


def split_windows(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows (ticker, candidate_cik, start_day, end_day, filed_day) with windows cut where a ticker changes firms.

    `splits` has (ticker, split_day, pre_cik, post_cik): the old firm keeps [start, split), the new one [split, end); filings on the
    wrong side go. Other rows stay as they are. A null end_day is no end: the old firm's is the split, the new one's stays null.
    """
    cut = df.join(splits, "ticker", "left")
    pre, post = F.col("candidate_cik") == F.col("pre_cik"), F.col("candidate_cik") == F.col("post_cik")
    keep = F.when(pre, F.col("filed_day") < F.col("split_day")).when(post, F.col("filed_day") >= F.col("split_day")).otherwise(True)
    return cut.where(keep).select("ticker", "candidate_cik", F.when(post, F.greatest("start_day", "split_day")).otherwise(F.col("start_day")).alias("start_day"),
                                  F.when(pre, F.least("end_day", "split_day")).otherwise(F.col("end_day")).alias("end_day"), "filed_day")


def first_and_last_seen(df: DataFrame, keys: list[str], ts: str, url: str) -> DataFrame:
    """When and where each key was seen first and last; of pages of one time the greater counts."""
    at = F.struct(F.col(ts), F.col(url))
    early = F.struct(F.col(ts).alias("t"), F.col(url).alias("u"))
    return df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.min(early).alias("a"), F.max(at).alias("b")).select(
        *keys, F.col("a.t").alias("first_seen_at"), F.col("a.u").alias("first_seen_url"), F.col(f"b.{ts}").alias("last_seen_at"), F.col(f"b.{url}").alias("last_seen_url"))


def days_since_last(df: DataFrame, keys: list[str], day: str, out: str = "duration_days") -> DataFrame:
    """Days since the key's previous row."""
    return df.withColumn(out, F.datediff(day, F.lag(day).over(Window.partitionBy(*keys).orderBy(day))))


def trailing_deviation(value: Column, order: Window, rows: int) -> Column:
    """Annualised deviation of the `rows` values before the row's own; null unless all are there.

    From running sums at either end of the span, so a row costs the same whatever `rows` is; a sliding frame would add up the span again for each row.
    """
    running = order.rowsBetween(Window.unboundedPreceding, 0)

    def span(x: Column) -> Column:
        total = F.coalesce(F.sum(x).over(running), F.lit(0.0))
        return F.lag(total, 1, 0.0).over(order) - F.lag(total, rows + 1, 0.0).over(order)

    n, one, two = span(F.when(value.isNotNull(), 1.0)), span(value), span(value * value)
    variance = F.greatest(F.lit(0.0), two - one * one / rows) / (rows - 1)
    return F.when(n == rows, F.sqrt(variance) * F.sqrt(F.lit(252.0)))


def price_features(df: DataFrame, key: str, day: str, price: str) -> DataFrame:
    """Log return, realised volatility over 21 and 252 rows, and momentum over as many, of each key's prices; a missing value is null, never NaN."""
    order = Window.partitionBy(key).orderBy(day)
    ratio = F.col(price) / F.lag(price).over(order)
    with_return = df.withColumn("log_return", F.when((F.col(price) > 0) & (F.lag(price).over(order) > 0), F.ln(ratio)))
    momentum = lambda n: F.try_divide(F.lag(price, 1).over(order), F.lag(price, n + 1).over(order)) - 1
    return with_return.select(*df.columns, "log_return", trailing_deviation(F.col("log_return"), order, 21).alias("vol_21"), trailing_deviation(F.col("log_return"), order, 252).alias("vol_252"),
                              momentum(21).alias("mom_21"), momentum(252).alias("mom_252"))
