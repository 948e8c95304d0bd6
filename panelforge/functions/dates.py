"""Dates, windows as text, and months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def window_text(start: Column, end: Column) -> Column:
    """`2020-01-01 to 2020-02-01`, or `2020-01-01 to infinity` if the end is null: `window_end` gives null again."""
    return F.concat_ws(" to ", F.date_format(start, "yyyy-MM-dd"), F.coalesce(F.date_format(end, "yyyy-MM-dd"), F.lit("infinity")))


def window_start(text: Column) -> Column:
    return F.try_to_date(F.trim(F.element_at(F.split(text, " to "), 1)), "yyyy-MM-dd")


def window_end(text: Column) -> Column:
    return F.try_to_date(F.trim(F.try_element_at(F.split(text, " to "), F.lit(2))), "yyyy-MM-dd")


def within(day: Column, start: Column, end: Column) -> Column:
    """start <= day < end."""
    return (day >= start) & (day < end)


def link_time(line: Column) -> Column:
    """UTC time in the name of a crawl file, null if there is none."""
    digits = F.regexp_extract(line, r"NEWS-(\d{14})", 1)
    return F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMddHHmmss"))


def civil_day(ts: Column, zone: str = NEW_YORK) -> Column:
    """Date of a UTC time at a place."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def month_bounds(year: int, month: int, first: dt.date, last: dt.date, days: int = 7) -> tuple[dt.date, dt.date]:
    """First day and first day after a month, widened by `days` on either side, but not beyond the horizon."""
    start = dt.date(year, month, 1)
    end = dt.date(year + month // 12, month % 12 + 1, 1)
    return max(first, start - dt.timedelta(days=days)), min(last, end + dt.timedelta(days=days))
