import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm.queries import SAMPLE
from panelforge.llm.reservoir import GeometricFile, SegmentStore, buffer_and_tail, reservoirs, sample_distinct, split_draw


def drawn(n, size, buffer, seed, folder, tail=2, chunk=97):
    file = GeometricFile(size, buffer, SegmentStore(f"file://{folder}/{seed}"), np.random.default_rng(seed), tail)
    for at in range(0, n, chunk):
        file.add(pa.table({"i": np.arange(at, min(n, at + chunk))}))
    out = np.concatenate([t["i"].to_numpy() for t in file.sample()])
    written = file.store.made
    file.store.clear()
    return out, written


@pytest.mark.parametrize("size,buffer", [(40, 8), (40, 40), (7, 3), (1, 1)])
def test_every_record_is_equally_likely(size, buffer):
    n, trials = 150, 600
    hits = np.zeros(n)
    with tempfile.TemporaryDirectory() as folder:
        for seed in range(trials):
            got, written = drawn(n, size, buffer, seed, folder)
            assert len(got) == len(set(got.tolist())) == size
            assert written > 0 or buffer >= size or size < 10
            hits[got] += 1
    p = size / n
    z = (hits - trials * p) / np.sqrt(trials * p * (1 - p))
    assert np.abs(z).max() < 4.5 and abs((z**2).mean() - 1) < 0.45
    assert abs(hits[: n // 3].mean() - hits[-n // 3 :].mean()) / (trials * p) < 0.1 + 2 / np.sqrt(trials * size / 3)


def test_fewer_records_than_room():
    with tempfile.TemporaryDirectory() as folder:
        assert sorted(drawn(5, 10, 3, 1, folder)[0].tolist()) == list(range(5))
        file = GeometricFile(5, 2, SegmentStore(f"file://{folder}/x"), np.random.default_rng(0))
        assert sum(t.num_rows for t in file.sample()) == 0


def test_freed_segments_are_overwritten():
    with tempfile.TemporaryDirectory() as folder:
        short, long = drawn(2_000, 200, 20, 1, folder)[1], drawn(200_000, 200, 20, 1, folder, chunk=5000)[1]
        assert long <= 2 * short


def test_split_draw():
    rng = np.random.default_rng(0)
    assert split_draw([3, 0, 2], 9, rng) == [3, 0, 2]
    draws = np.array([split_draw([100, 300, 600], 50, rng) for _ in range(400)])
    assert (draws.sum(axis=1) == 50).all() and np.allclose(draws.mean(axis=0), [5, 15, 30], atol=0.8)
    huge = split_draw([10**12, 3 * 10**12], 1000, rng)
    assert sum(huge) == 1000 and 180 < huge[0] < 320


def articles(spark, n):
    df = spark.range(n).select(F.concat(F.lit("a"), (F.col("id") % (n // 2 or 1)).cast("string")).alias("article_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("w"), F.col("id") % 3)).alias("warc_path"))
    return df.withColumn("key", F.lit("clash")).withColumn("arrival", F.lit(1)).withColumn("_shard", F.lit(0))


def test_sample_distinct(spark):
    df = articles(spark, 4000).union(spark.createDataFrame([(None, "w", "k", 1, 0)], "article_id string, warc_path string, key string, arrival int, _shard int"))
    out = sample_distinct(df, "article_id", "warc_path", 300, shards=7, buffer=16)
    got = out.collect()
    assert out.columns == ["article_id", "warc_path", "population"]
    assert len(got) == len({r.article_id for r in got}) == 300 and {r.population for r in got} == {2000}
    assert not any(r.article_id is None for r in got)
    again = sample_distinct(df.repartition(9), "article_id", "warc_path", 300, shards=7, buffer=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert {r.article_id for r in sample_distinct(df, "article_id", "warc_path", 300, shards=7, seed=1).collect()} != {r.article_id for r in got}


def test_small_and_empty_inputs(spark):
    df = articles(spark, 20)
    assert sample_distinct(df, "article_id", "warc_path", 100, shards=4).count() == 10
    assert sample_distinct(df, "article_id", "warc_path", 0, shards=4).count() == 0
    assert sample_distinct(df.limit(0), "article_id", "warc_path", 5, shards=4).collect() == []
    hot = spark.range(3000).select(F.lit("same").alias("article_id"), F.lit("w" * 1000).alias("warc_path"))
    assert [r.population for r in sample_distinct(hot, "article_id", "warc_path", 5, shards=4).collect()] == [1]


def test_uniform_over_shards(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("k"), F.lit("p").alias("p"))
    hits = np.zeros(60)
    for seed in range(25):
        for r in sample_distinct(df, "k", "p", 20, seed=seed, shards=3, buffer=4).collect():
            hits[int(r.k)] += 1
    z = (hits - 25 / 3) / np.sqrt(25 * 2 / 9)
    assert np.abs(z).max() < 4.5


def test_the_registered_sample_writes_and_overwrites_segments(spark):
    """The parameters of p2_article_sample on 30,000 articles: every shard's file flushes segments and overwrites freed ones."""
    df = spark.range(45_000).select(F.concat(F.lit("a"), (F.col("id") % 30_000).cast("string")).alias("article_id"), F.concat(F.lit("w"), F.col("id") % 50).alias("warc_path"))
    samples, populations, draw = reservoirs(df, "article_id", "warc_path", SAMPLE)
    by_shard = samples.groupBy("_shard").agg(F.max("_written").alias("written"), F.max("_overwritten").alias("overwritten")).collect()
    assert sum(populations.values()) == 30_000 and sum(draw) == SAMPLE
    assert all(r.written > 30 and r.overwritten > 10 for r in by_shard)


@pytest.mark.parametrize("room", [1, 3, 50, 361, 1478, 5000, 10**6])
def test_every_room_makes_segments(room):
    buffer, tail = buffer_and_tail(room)
    assert 1 <= buffer <= room and (room < 50 or buffer * buffer / room >= tail >= 1)


def test_uniform_with_segments_on_disk():
    """The buffer and tail of production: 4 of 5 rows of a full sample lie in segments at some time, and every record is equally likely."""
    n, size, trials = 1200, 200, 250
    buffer, tail = buffer_and_tail(size)
    hits = np.zeros(n)
    with tempfile.TemporaryDirectory() as folder:
        for seed in range(trials):
            got, written = drawn(n, size, buffer, seed, folder, tail=tail)
            assert written >= 8 and len(set(got.tolist())) == size
            hits[got] += 1
    p = size / n
    z = (hits - trials * p) / np.sqrt(trials * p * (1 - p))
    assert np.abs(z).max() < 4.5 and abs((z**2).mean() - 1) < 0.2
