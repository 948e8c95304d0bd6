"""The N highest rows of every group, by lower bounds that the partitions find alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.grouping import group_starts
from panelforge.storage import materialize


def _local_best(group: list[str]):
    """Rows of a sorted partition among the `_n` first of their group there, with their `_place`; `_nth` marks the last of a full `_n`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the group the stream stands in, and how many of its rows went by
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            starts = group_starts(table, group)
            keys = table.select(group)
            goes_on = last is not None and len(group_starts(pa.concat_tables([last, keys.slice(0, 1)]), group)) == 1
            sizes = np.diff(np.append(starts, table.num_rows))
            place = np.arange(table.num_rows) - np.repeat(starts, sizes)
            if goes_on:
                place[: sizes[0]] += seen
            n = np.asarray(batch.column("_n"))
            kept = np.flatnonzero(place < n)
            if len(kept):
                out = table.take(pa.array(kept)).append_column("_nth", pa.array(place[kept] == n[kept] - 1)).append_column("_place", pa.array((place[kept] + 1).astype(np.int32)))
                yield from out.combine_chunks().to_batches()
            last, seen = keys.slice(table.num_rows - 1), int(place[-1]) + 1

    return run


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], n: Column | int, *, whole: Column | None = None, broadcast_groups: int = 200_000) -> DataFrame:
    """The rows of `df` among the `n` of highest `score` in their `group`, with `rank` from 1 on.

    Equal scores are settled by `ties`, ascending, nulls first, so the result is the same however the rows lie; rows that
    are equal in all of them are interchangeable and each takes a place. `n` may be an expression that is constant within a
    group. Rows whose score is null or NaN or whose group has a null do not count; `n` below 1 or null keeps nothing. All
    columns of `df` come out; names starting with an underscore are reserved. An empty table gives an empty result.

    1. Every partition sorts its own rows and keeps the `n` best of each group; the score of the n-th is a lower bound of
       what the whole group's n-th can be. No row is shuffled for this, and a group of any size stays spread out.
    2. The greatest bound of each group is joined to the kept rows: as a broadcast if they are at most `broadcast_groups`
       (only groups with `n` rows in one partition have a bound), else by a shuffle on the group, which ranking needs anyhow.
    3. Rows below their bound go; the survivors, about `n` for each group, are ranked.

    `whole`, constant within a group, says that the caller has all rows of the group in one partition, as many small groups
    have after a shuffle on a part of their key. Their local bound is the group's, and their local rank the rank, so they
    take no part in 2 and 3. Rows are sorted by a hash of the group first, which settles most comparisons by one number.
    """
    limit = n if isinstance(n, Column) else F.lit(n)
    rows = df.withColumn("_n", F.coalesce(limit.cast("int"), F.lit(0))).where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).dropna(subset=group)
    rows = rows.withColumn("_whole", F.coalesce(whole, F.lit(False)) if whole is not None else F.lit(False))
    schema = T.StructType([*rows.schema.fields, T.StructField("_nth", T.BooleanType()), T.StructField("_place", T.IntegerType())])
    local = materialize(rows.sortWithinPartitions(F.xxhash64(*group), *group, F.desc(score), *ties).mapInArrow(_local_best(group), schema), "local-best")
    spread = local.where("not _whole")
    bounds = materialize(spread.where("_nth").groupBy(*group).agg(F.max(score).alias("_bound")), "bounds")
    small = bounds.count() <= broadcast_groups
    survivors = spread.join(F.broadcast(bounds) if small else bounds, group, "left").where(F.col("_bound").isNull() | (F.col(score) >= F.col("_bound")))
    order = Window.partitionBy(*group).orderBy(F.desc(score), *ties)
    ranked = survivors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("_n")).select(*df.columns, "rank")
    return ranked if whole is None else local.where("_whole").select(*df.columns, F.col("_place").alias("rank")).unionByName(ranked)


def _latest_in_batch(key: list[str], at: str, value: str):
    """Of the rows of one key in a batch the one of latest `at`, of these the one of greatest `value`; nulls come before all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            order = pc.sort_indices(table.select([at, value]), sort_keys=[(at, "ascending"), (value, "ascending")], null_placement="at_start")
            kept = table.take(order).group_by(key, use_threads=False).aggregate([(c, "last", pc.ScalarAggregateOptions(skip_nulls=False)) for c in (at, value)])
            yield from kept.rename_columns([c.removesuffix("_last") for c in kept.column_names]).select(batch.schema.names).combine_chunks().to_batches()

    return run


def latest_together(df: DataFrame, together: list[str], key: list[str], at: str, value: str) -> DataFrame:
    """(key, value) of the row of latest `at` of each key, with all rows of equal `together`, a part of the key, in one partition.

    Of rows of one time the greatest value counts; a null time is before all. Rows are reduced to one a key within each batch
    before the only shuffle, so copies of one row, however many, don't gather in one task; a key's partition has what its
    batches left.
    """
    narrow = df.select(*key, at, value)
    once = narrow.mapInArrow(_latest_in_batch(key, at, value), narrow.schema).repartition(*together)
    newest = once.groupBy(*key, at).agg(F.max(value).alias(value))  # neither this nor the next needs a shuffle
    return newest.groupBy(*key).agg(F.max_by(value, F.coalesce(F.unix_micros(at), F.lit(-(2**63)))).alias(value))
