"""A uniform sample of fixed size from data whose size isn't known and which arrives in pieces."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.grouping import group_starts
from panelforge.storage import discard, materialize, shared_folder


class SegmentStore:
    """Arrow tables as numbered files of a folder; a freed number is overwritten by the next segment."""

    def __init__(self, uri: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
        self.free: list[int] = []
        self.made = self.overwritten = 0

    def write(self, table: pa.Table) -> int:
        if not self.made:
            self.fs.create_dir(self.root, recursive=True)
        if self.free:
            number = self.free.pop()
            self.overwritten += 1
        else:
            number, self.made = self.made, self.made + 1
        with self.fs.open_output_stream(f"{self.root}/{number}") as out, pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return number

    def read(self, number: int) -> pa.Table:
        with self.fs.open_input_stream(f"{self.root}/{number}") as stream:
            return pa.ipc.open_stream(stream).read_all()

    def clear(self) -> None:
        if self.made:
            self.fs.delete_dir(self.root)


class _Subsample:
    """The records of one flush in random order, as segments of shrinking size; its last `live` records are in the sample."""

    def __init__(self, rows: pa.Table, shrink: float, tail: int, store: SegmentStore) -> None:
        self.live, self.total, self.store = rows.num_rows, rows.num_rows, store
        self.segments: list[tuple[int, int, int]] = []  # first row, rows, file
        at, size = 0, rows.num_rows * (1 - shrink)
        while shrink > 0 and math.ceil(size) >= tail and rows.num_rows - at > tail:
            n = min(math.ceil(size), rows.num_rows - at)
            self.segments.append((at, n, store.write(rows.slice(at, n))))
            at, size = at + n, size * shrink
        self.tail_at, self.tail = at, pa.concat_tables([rows.slice(at)]).combine_chunks()

    def lose(self, n: int) -> None:
        self.live -= n
        dead = self.total - self.live
        while self.segments and sum(self.segments[0][:2]) <= dead:
            self.store.free.append(self.segments.pop(0)[2])

    def rows(self) -> Iterator[pa.Table]:
        dead = self.total - self.live
        for at, n, number in self.segments:
            yield self.store.read(number).slice(max(0, dead - at), n)
        yield self.tail.slice(max(0, dead - self.tail_at))


class GeometricFile:
    """A uniform sample of `capacity` records of a stream, on disk but for a buffer.

    Accepted records are buffered. A full buffer is shuffled and flushed as one subsample of geometrically shrinking segments,
    and takes the place of as many records of the earlier subsamples, how many of each being a hypergeometric draw: as every
    subsample lies in random order, it loses its first ones, and the segments that have lost all are overwritten. So the disk
    is only written in sequence. Segments end where they would be shorter than `tail` rows; what is left of a subsample stays in
    memory. With a buffer that holds the whole sample nothing is written.
    """

    def __init__(self, capacity: int, buffer: int, store: SegmentStore, rng: np.random.Generator, tail: int = 1) -> None:
        self.capacity, self.buffer, self.store, self.rng, self.tail = capacity, max(1, min(buffer, capacity)), store, rng, max(1, tail)
        self.shrink = 1 - self.buffer / capacity if capacity else 0.0
        self.subsamples: list[_Subsample] = []
        self.seen = self.filled = 0
        self.pending: list[pa.Table] = []
        self.pending_rows = 0
        self.slots: list[int] = []  # rows of `pending` that are in the buffer

    def add(self, rows: pa.Table) -> None:
        at = 0
        while self.filled < self.capacity and at < rows.num_rows:
            n = min(self.buffer - len(self.slots), self.capacity - self.filled, rows.num_rows - at)
            self._keep(rows.slice(at, n))
            self.slots += range(self.pending_rows - n, self.pending_rows)
            at, self.filled, self.seen = at + n, self.filled + n, self.seen + n
            if len(self.slots) == self.buffer or self.filled == self.capacity:
                self._flush(new=True)
        if at == rows.num_rows:
            return
        rank = self.seen + 1 + np.arange(rows.num_rows - at)
        self.seen += len(rank)
        accepted = np.flatnonzero(self.rng.random(len(rank)) * rank < self.capacity)
        while len(accepted):
            self._keep(rows.take(pa.array(at + accepted)))
            first = self.pending_rows - len(accepted)
            for k in range(len(accepted)):
                if self.rng.random() * self.capacity < len(self.slots):
                    self.slots[int(self.rng.integers(len(self.slots)))] = first + k
                else:
                    self.slots.append(first + k)
                    if len(self.slots) == self.buffer:
                        break
            accepted = accepted[k + 1 :]
            if len(self.slots) == self.buffer or self.pending_rows > 4 * self.buffer + 10_000:
                self._flush() if len(self.slots) == self.buffer else self._compact()

    def _keep(self, rows: pa.Table) -> None:
        self.pending.append(rows)
        self.pending_rows += rows.num_rows

    def _compact(self) -> None:
        rows = pa.concat_tables(self.pending).take(pa.array(self.slots, pa.int64()))
        self.pending, self.pending_rows, self.slots = [rows], rows.num_rows, list(range(rows.num_rows))

    def _flush(self, new: bool = False) -> None:
        if self.slots:
            order = self.rng.permutation(np.array(self.slots, dtype=np.int64))
            rows = pa.concat_tables(self.pending).take(pa.array(order)).combine_chunks()
            if not new:
                lost = self.rng.multivariate_hypergeometric([s.live for s in self.subsamples], len(order), method="marginals")
                for subsample, n in zip(self.subsamples, lost.tolist(), strict=True):
                    subsample.lose(n)
                self.subsamples = [s for s in self.subsamples if s.live]
            self.subsamples.append(_Subsample(rows, self.shrink, self.tail, self.store))
        self.pending, self.pending_rows, self.slots = [], 0, []

    def sample(self) -> Iterator[pa.Table]:
        """The sample's records; the stream may go on afterwards."""
        self._flush(new=self.filled < self.capacity)
        for subsample in self.subsamples:
            yield from subsample.rows()


def split_draw(populations: list[int], size: int, rng: np.random.Generator) -> list[int]:
    """How many of `size` records, drawn without replacement from all populations together, come from each."""
    total = sum(populations)
    if size >= total:
        return list(populations)
    if total < 10**9:
        return rng.multivariate_hypergeometric(populations, size, method="marginals").tolist()
    drawn = np.zeros(0, dtype=np.int64)  # beyond what numpy draws: `size` distinct places of the joint population
    while len(drawn) < size:
        drawn = np.unique(np.concatenate([drawn, rng.integers(0, total, size - len(drawn))]))
    return np.bincount(np.searchsorted(np.cumsum(populations), drawn, side="right"), minlength=len(populations)).tolist()


def buffer_and_tail(room: int) -> tuple[int, int]:
    """Rows of a geometric file's buffer, a quarter of its room, and of its shortest segment, an eighth of the longest.

    The longest segment of a full buffer of b of r rows has b * b / r, so these make about eight segments for each flush.
    """
    buffer = max(1, math.ceil(room / 4))
    return buffer, max(1, buffer * buffer // room // 8)


def _shard_samples(keys: list[str], capacity: int, buffer: int, tail: int, seed: int, folder: str):
    """The geometric files of a partition's shards, which come one after another, with the population, a random place, and how often segments were written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file = None, None

        def finish() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(list(file.sample()))
            n, made, again = rows.num_rows, file.store.made, file.store.overwritten
            file.store.clear()
            out = rows.append_column("_shard", pa.array(np.full(n, shard, dtype=np.int32)))
            out = out.append_column("_population", pa.array(np.full(n, file.seen, dtype=np.int64))).append_column("_place", pa.array(file.rng.permutation(n)))
            out = out.append_column("_written", pa.array(np.full(n, made + again, dtype=np.int64))).append_column("_overwritten", pa.array(np.full(n, again, dtype=np.int64)))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            starts = group_starts(table, ["_shard"]).tolist()
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                here = table["_shard"][a].as_py()
                if here != shard:
                    if file:
                        yield from finish()
                    shard = here
                    file = GeometricFile(capacity, buffer, SegmentStore(f"{folder}/{shard}-{uuid.uuid4().hex}"), np.random.default_rng([seed, shard]), tail)
                file.add(table.slice(a, b - a).select(keys))
        if file:
            yield from finish()

    return run


#: Rows of the data for each shard, records of a sample for each shard, and shards at most; a shard's population is one number on the driver.
SHARD_ROWS, SHARD_SAMPLE, MOST_SHARDS = 250_000, 1_000_000, 4096


def reservoirs(df: DataFrame, key: str, arrival: str, size: int, *, seed: int = 42, shards: int | None = None, buffer: int | None = None) -> tuple[DataFrame, dict[int, int], list[int]]:
    """(samples, populations, draw): a geometric file's sample of each shard (key, arrival, _shard, _population, _place, _written, _overwritten), the shards' populations,
    and how many records each gives to the joint sample of `size`. `sample_distinct` says how."""
    if size < 0 or (shards is not None and shards < 1):
        raise ValueError("size must not be negative and shards must be positive")
    spark = df.sparkSession
    shards = shards or min(MOST_SHARDS, max(1, math.ceil(df.count() / SHARD_ROWS), math.ceil(size / SHARD_SAMPLE)))
    first = (
        df.select(F.col(key).alias("key"), F.col(arrival).alias("arrival")).where(F.col("key").isNotNull())
        .groupBy("key").agg(F.min("arrival").alias("arrival"))
        .withColumn("_shard", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(shards)).cast("int"))
        .repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", F.asc_nulls_last("arrival"), "key")
    )
    long = ("_population", "_place", "_written", "_overwritten")
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("arrival", df.schema[arrival].dataType), T.StructField("_shard", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in long]])
    room = min(size, math.ceil(size / shards + 6 * math.sqrt(size / shards)) + 16)
    while True:
        folder = f"{shared_folder(spark)}/reservoir-{uuid.uuid4().hex}"
        capacity = max(1, room)
        held, tail = buffer_and_tail(capacity)
        samples = materialize(first.mapInArrow(_shard_samples(["key", "arrival"], capacity, buffer or held, tail, seed, folder), schema), "reservoirs")
        discard(spark, folder)  # what tasks that were lost have left
        populations = dict(samples.groupBy("_shard").agg(F.max("_population")).collect())
        draw = split_draw([populations.get(s, 0) for s in range(shards)], size, np.random.default_rng([seed, shards, 1]))
        if max(draw) <= room:
            return samples, populations, draw
        room = max(draw)


def sample_distinct(df: DataFrame, key: str, arrival: str, size: int, *, seed: int = 42, shards: int | None = None, buffer: int | None = None) -> DataFrame:
    """(key, arrival, population): `size` distinct keys of `df`, every one equally likely, or all if there are fewer.

    `arrival` names the piece in which a record comes; pieces arrive in its order (nulls last), a key counts at its first. A
    row with a null key is no record. Other columns are ignored, so names may clash. An empty table or `size` 0 gives an empty
    result. The result depends on the data, `seed` and `shards` only, not on how the rows lie.

    Keys are dealt by hash into `shards`, repeats having been combined before the shuffle; without a number, one for
    `SHARD_ROWS` counted rows. A shard's stream passes through a `GeometricFile` whose segments go to the shared folder; its
    buffer is a quarter of its room unless `buffer` says otherwise. A shard needs about `size / shards` records: its file has
    room for six standard deviations more, and if a draw should ask for yet more, the shards are sampled again with room for
    it (the draw depends on the populations only, so this favours no record). The shards' populations, one number each, give
    the hypergeometric draw of how many records each contributes, and these are its first in random order.
    """
    samples, populations, draw = reservoirs(df, key, arrival, size, seed=seed, shards=shards, buffer=buffer)
    share = F.element_at(F.array(*[F.lit(int(k)) for k in draw]), F.col("_shard") + 1)
    return samples.where(F.col("_place") < share).select(F.col("key").alias(key), F.col("arrival").alias(arrival), F.lit(sum(populations.values())).cast("long").alias("population"))
