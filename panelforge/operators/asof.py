"""Attributes of an entity as they were valid and already known on the day of an event."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.coverage import NEVER
from panelforge.operators.grouping import group_starts, whole_groups
from panelforge.storage import materialize

MICROS_A_DAY = 86_400_000_000


def utc_day(ts: Column) -> Column:
    """Days since 1970-01-01 of the UTC date of a timestamp, whatever the session's time zone."""
    micros = F.unix_micros(ts)
    return ((micros - F.pmod(micros, F.lit(MICROS_A_DAY))) / F.lit(MICROS_A_DAY)).cast("int")


def latest_versions(events: DataFrame, versions: DataFrame, entity: str, day: str, bounds: Column, known: Column,
                    priority: dict[str, Column], payload: list[str], shard_days: int = 512) -> DataFrame:
    """(entity, day, *payload) for every distinct (entity, day) of `events` at which a version is valid and known.

    `events.day` is a date. A version of the entity is valid on the days of `bounds`, struct(lo int, hi int), and known
    from day `known` (days since 1970-01-01) on. Of several the greatest by `priority` (in order, nulls last) is taken.
    Rows with a null entity, day, bounds or known day count for nothing; repeated rows have no effect; of versions equal in
    `priority` the greatest payload is taken; other columns are ignored, so their names may clash; empty tables give an empty
    result.

    A version can answer from the later of its first valid and its first known day on, so both conditions are one range.
    Events and versions are co-grouped by entity and time shard: an entity's events are at most `shard_days` days in a
    shard, its versions at most one for each pair of days there, as both are reduced before the shuffle, and no group
    grows with the rows. The distinct event days are written once, as their span is needed before the plan. In a group the versions are laid over one another in order of priority, and a binary search
    over the bounds left finds the version of every event day, for all groups of an Arrow table at once.
    """
    spec, prio = versions.schema, list(priority)
    asked = materialize(events.select(F.col(entity).alias("_e"), F.unix_date(F.col(day)).alias("_s")).dropna().distinct(), "asked-days")
    span = asked.agg(F.min("_s"), F.max("_s")).first()
    first, last = (span[0], span[1]) if span[0] is not None else (0, -1)
    shard = lambda c: F.floor(c / F.lit(shard_days)).cast("int")
    begin = F.greatest(F.col("_b.lo"), F.col("_k"), F.lit(first))
    end = F.least(F.col("_b.hi"), F.lit(min(last + 1, NEVER)))
    known_rows = (
        versions.select(F.col(entity).alias("_e"), bounds.alias("_b"), known.cast("int").alias("_k"),
                        F.struct(*[priority[p].alias(p) for p in prio], *[F.col(c) for c in payload if c not in prio]).alias("_v"))
        .where(F.col("_e").isNotNull())
        .select("_e", begin.alias("_s"), end.alias("_t"), (F.col("_b").isNotNull() & F.col("_k").isNotNull()).alias("_ok"), "_v")
        # no filter on the bounds: it would be pushed below and work them out again for every mention of them
        .withColumn("_shard", F.explode(F.when(F.col("_ok") & (F.col("_s") < F.col("_t")), F.sequence(shard(F.col("_s")), shard(F.col("_t") - 1)))))
        .groupBy("_e", "_shard", F.greatest("_s", F.col("_shard") * shard_days).alias("_s"), F.least("_t", (F.col("_shard") + 1) * shard_days).alias("_t"))
        .agg(F.max("_v").alias("_v"))
        .select("_e", "_shard", F.lit(0).alias("_kind"), "_s", "_t", "_v")
    )
    asked_rows = asked.select("_e", shard(F.col("_s")).alias("_shard"), F.lit(1).alias("_kind"), "_s", F.lit(None).cast("int").alias("_t"),
                              F.lit(None).cast(known_rows.schema["_v"].dataType).alias("_v"))
    flat = [F.col(f"_v.{c}").alias(f"_v_{c}") for c in dict.fromkeys([*prio, *payload])]
    sorted_rows = (
        known_rows.union(asked_rows).repartition("_e", "_shard")
        .select("_e", "_shard", "_kind", "_s", "_t", *flat)
        .sortWithinPartitions("_e", "_shard", "_kind", *[f"_v_{p}" for p in prio], *[f"_v_{c}" for c in payload if c not in prio])
        .select("_e", "_shard", "_kind", "_s", "_t", *[f"_v_{c}" for c in payload])
    )
    out = T.StructType([T.StructField("_e", sorted_rows.schema["_e"].dataType), T.StructField("_s", T.IntegerType()),
                        *[T.StructField(f"_v_{c}", spec[c].dataType) for c in payload]])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["_e", "_shard"]):
            hit, version = _search(table, shard_days)
            rows = table.take(pa.array(hit))
            found = table.take(pa.array(version))
            yield from pa.table({"_e": rows["_e"], "_s": rows["_s"], **{f"_v_{c}": found[f"_v_{c}"] for c in payload}}).combine_chunks().to_batches()

    return sorted_rows.mapInArrow(search, out).select(
        F.col("_e").alias(entity), F.date_from_unix_date("_s").alias(day), *[F.col(f"_v_{c}").alias(c) for c in payload]
    )


def _search(table: pa.Table, shard_days: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the events that a version answers, and of that version, in a table of whole groups."""
    starts = group_starts(table, ["_e", "_shard"])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    ints = lambda c: table[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = group * (shard_days + 1) - ints("_shard") * shard_days
    kind = ints("_kind")
    versions, events = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    begin, end = at[versions] + ints("_s")[versions], at[versions] + ints("_t")[versions]
    bounds = np.unique(np.concatenate([begin, end]))
    if not len(bounds) or not len(events):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    top = np.full(len(bounds), -1, dtype=np.int64)
    for row, a, b in zip(versions.tolist(), np.searchsorted(bounds, begin).tolist(), np.searchsorted(bounds, end).tolist(), strict=True):
        top[a:b] = row
    place = np.searchsorted(bounds, at[events] + ints("_s")[events], side="right") - 1
    version = np.where(place >= 0, top[np.maximum(place, 0)], -1)
    return events[version >= 0], version[version >= 0]
