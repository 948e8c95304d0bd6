import random

from pyspark.sql import functions as F

from panelforge.operators.coverage import NEVER, day_text, merge_periods, window_bounds


def bounds(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "w string").select(window_bounds(F.col("w")).alias("b"))
    return [(r.b.lo, r.b.hi) if r.b else None for r in df.collect()]


def test_window_bounds(spark):
    assert bounds(spark, "[1970-01-02,1970-01-04)", "(1970-01-02, 1970-01-04]", "[1970-01-02,)") == [(1, 3), (2, 4), (1, NEVER)]
    assert bounds(spark, None, "empty", "[1970-01-02,1970-01-02)", "(1970-01-02,1970-01-03)", "[1970-01-05,1970-01-02)", "", "[1970-02-31,1970-03-05)", "x" * 10_000) == [None] * 8
    assert bounds(spark, "[1970-01-02,1970-01-02]", "[1969-12-31,1970-01-01)") == [(1, 2), (-1, 0)]


def brute(rows):
    out = set()
    for key in {k for k, *_ in rows if k is not None}:
        merged = []
        for lo, hi in sorted((lo, hi) for k, lo, hi in rows if k == key and lo is not None and hi is not None and lo < hi):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out |= {(key, "period", lo, hi) for lo, hi in merged} | {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def merged(spark, rows, shard_days):
    df = spark.createDataFrame(rows, "entity string, lo int, hi int").withColumn("kind", F.lit("clash")).withColumn("_shard", F.lit(7))
    out = merge_periods(df, ["entity"], F.struct("lo", "hi"), shard_days)
    assert out.columns == ["entity", "kind", "lo", "hi"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_merge_against_brute_force(spark):
    rng = random.Random(1)
    for shard in (1, 7, 100_000):
        rows = []
        for _ in range(400):
            lo = rng.randrange(-200, 200)
            rows.append((rng.choice(["a", "b", "hot", None]), lo, rng.choice([lo + rng.randrange(-2, 9), lo + rng.randrange(60), NEVER if rng.random() < 0.02 else lo + 1])))
        rows += rows[:50] + [("c", None, 5), ("c", 5, None), ("d", 3, 3), ("e", 0, 7), ("e", 7, 14), ("f", 0, 100), ("f", 10, 20), ("g", 5, NEVER)]
        assert merged(spark, rows, shard) == brute(rows)


def test_empty_table_and_day_text(spark):
    assert merged(spark, [], 10) == set()
    days = spark.createDataFrame([(0,), (NEVER,)], "d int").select(day_text(F.col("d")).alias("t")).collect()
    assert [r.t for r in days] == ["1970-01-01", "infinity"]
