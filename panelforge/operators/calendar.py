"""Exchange calendar, sessions, and quotas by session."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL_DAY_HOURS = 6.5


def civil_calendar(schedule: DataFrame, day: str = "trading_day", open_at: str = "session_open_utc", close_at: str = "session_close_utc") -> DataFrame:
    """Every civil day from the first to the last of the schedule, with flags; days without a session are weekends or holidays."""
    span = schedule.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias(day))
    hours = (F.unix_timestamp(close_at) - F.unix_timestamp(open_at)) / 3600
    trading = F.col(open_at).isNotNull()
    weekend = F.dayofweek(day).isin(1, 7)
    return span.join(schedule.select(day, open_at, close_at), day, "left").select(
        day, open_at, close_at, trading.alias("is_trading_day"), F.coalesce(hours < FULL_DAY_HOURS, F.lit(False)).alias("is_half_day"),
        (~trading & weekend).alias("is_weekend"), (~trading & ~weekend).alias("is_holiday"))


def with_neighbours(schedule: DataFrame, day: str = "trading_day", close_at: str = "session_close_utc") -> DataFrame:
    """The trading days with the previous close and the next day. A calendar has some 250 rows a year, so one task orders it."""
    order = Window.orderBy(day)
    return schedule.withColumn("previous_close_utc", F.lag(close_at).over(order)).withColumn("next_trading_day", F.lead(day).over(order))


def overnight_fraction(schedule: DataFrame, first_close: dt.datetime, open_at: str = "session_open_utc", close_at: str = "session_close_utc") -> DataFrame:
    """Share of the minutes from one close to the next that lie before the open; `first_close` stands for the close before the first day."""
    known = with_neighbours(schedule, close_at=close_at).withColumn("_before", F.coalesce("previous_close_utc", F.lit(first_close).cast("timestamp")))
    night = F.greatest(F.unix_timestamp(open_at) - F.unix_timestamp("_before"), F.lit(0)) / 60
    session = (F.unix_timestamp(close_at) - F.unix_timestamp(open_at)) / 60
    return known.withColumn("overnight_fraction", F.try_divide(night, night + session)).drop("_before")


def route_sessions(records: DataFrame, at: str, local_day: Column, schedule: DataFrame) -> DataFrame:
    """Records with `trading_day` and `session`: intraday within [open, close), before the open the same day's overnight, after the close or on a
    day without a session the next trading day's overnight; both are null beyond the schedule.

    The record's civil day leads to its row of a civil calendar, which has the next trading day, by equality; nothing is carried over.
    """
    neighbours = with_neighbours(schedule)
    days = neighbours.select("trading_day", "session_open_utc", "session_close_utc", "next_trading_day")
    idle = neighbours.where(F.col("next_trading_day").isNotNull() & (F.datediff("next_trading_day", "trading_day") > 1)).select(
        F.explode(F.sequence(F.date_add("trading_day", 1), F.date_sub("next_trading_day", 1))).alias("_day"), F.lit(None).cast("timestamp").alias("_open"), F.lit(None).cast("timestamp").alias("_close"), F.lit(None).cast("date").alias("_own"), F.col("next_trading_day").alias("_next"))
    civil = days.select(F.col("trading_day").alias("_day"), F.col("session_open_utc").alias("_open"), F.col("session_close_utc").alias("_close"), F.col("trading_day").alias("_own"), F.col("next_trading_day").alias("_next")).union(idle)
    early = F.col(at) < F.col("_open")
    inside = (F.col(at) >= F.col("_open")) & (F.col(at) < F.col("_close"))
    day = F.when(early | inside, F.col("_own")).otherwise(F.col("_next"))
    out = records.withColumn("_day", local_day).join(civil, "_day", "left")
    return out.withColumn("_to", day).withColumn("_session", F.when(inside, "intraday").when(F.col("_to").isNotNull(), "overnight")).select(
        *records.columns, F.col("_to").alias("trading_day"), F.col("_session").alias("session"))


def session_caps(fractions: DataFrame, daily_cap: int, seed: int) -> DataFrame:
    """How many records a day's sessions get: intraday the cap times its share, rounded up at random by the rest, overnight what is left."""
    exact = F.lit(daily_cap) * (1 - F.col("overnight_fraction"))
    chance = F.pmod(F.xxhash64(F.col("trading_day"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    intraday = (F.floor(exact) + (chance < exact - F.floor(exact)).cast("int")).cast("int")
    return fractions.withColumn("intraday_cap", F.greatest(F.lit(0), F.least(F.lit(daily_cap), intraday))).withColumn("overnight_cap", F.lit(daily_cap) - F.col("intraday_cap"))


def days_by_month(schedule: DataFrame, day: str = "trading_day") -> DataFrame:
    """The trading days of each month in order."""
    return schedule.groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(F.sort_array(F.collect_list(day)).alias("days"))
