"""Streams: routing of records to sessions, bounded samples by key, windows with late data, dead letters."""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelforge.functions.dates import civil_day, link_time
from panelforge.operators.calendar import route_sessions


def parsed_links(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records with `published_at`, lines without a time in their name): the second is the dead-letter stream."""
    timed = lines.withColumn("published_at", link_time(F.col(value)))
    return timed.where(F.col("published_at").isNotNull()), timed.where(F.col("published_at").isNull()).drop("published_at")


def routed(records: DataFrame, schedule: DataFrame, at: str = "published_at") -> DataFrame:
    """A stream or table of records with their trading day and session: a stream joins the calendar, which is static, so nothing is kept between batches."""
    return route_sessions(records, at, civil_day(F.col(at)), schedule)


def dead_letter_report(lines: DataFrame, examples: int = 5, value: str = "value") -> DataFrame:
    """Number of unreadable lines and the first `examples` distinct ones in order; no task sees more than these of all lines."""
    some = lines.select(value).distinct().orderBy(value).limit(examples).agg(F.sort_array(F.collect_list(value)).alias("examples"), F.lit(1).alias("_one"))
    return lines.agg(F.count("*").alias("n_lines"), F.lit(1).alias("_one")).join(some, "_one").select("n_lines", "examples")


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and key; those later than `late` are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), *keys, "n_events")


def sessions_by_gap(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events without a pause longer than `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n_events")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n_events")


def reservoirs(records: DataFrame, keys: list[str], item: str, cap: int, seed: int = 42) -> DataFrame:
    """(keys, seen, items): after each batch the sample of at most `cap` items of every key that the batch touched.

    The state of a key is its sample and how many items it saw, so it is bounded by `cap`; a cap of 0 counts only. An item takes part
    each time it comes.
    """
    spec = ", ".join(f"{k} {records.schema[k].dataType.simpleString()}" for k in keys)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept = state.get if state.exists else (0, pickle.dumps(([], random.Random(f"{seed}{key}").getstate())))
        items, random_state = pickle.loads(kept)
        rng = random.Random()
        rng.setstate(random_state)
        for frame in frames:
            for value in frame[item]:
                seen += 1
                if len(items) < cap:
                    items.append(value)
                elif cap and (place := rng.randrange(seen)) < cap:
                    items[place] = value
        state.update((seen, pickle.dumps((items, rng.getstate()))))
        yield pd.DataFrame([(*key, seen, list(items))], columns=[*keys, "seen", "items"])

    return records.groupBy(*keys).applyInPandasWithState(update, f"{spec}, seen bigint, items array<string>", "seen bigint, kept binary", "update", GroupStateTimeout.NoTimeout)
