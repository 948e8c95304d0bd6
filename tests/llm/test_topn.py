import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from panelforge.llm.topn import latest_together, top_n

SCHEMA = "g string, h int, score double, tie string, rank string"


def brute(rows, n):
    groups = defaultdict(list)
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None and r[2] == r[2]:
            groups[r[:2]].append(r)
    out = []
    for members in groups.values():
        members.sort(key=lambda r: (-r[2], r[3] is not None, r[3] or ""))
        out += [(*r[:4], i + 1) for i, r in enumerate(members[: n(members[0])])]
    return sorted(out, key=str)


def run(spark, rows, n, **options):
    df = spark.createDataFrame(rows, SCHEMA).drop("rank").withColumn("extra", F.lit("clash")).repartition(5)
    out = top_n(df, ["g", "h"], "score", ["tie"], n, **options)
    assert out.columns == ["g", "h", "score", "tie", "extra", "rank"]
    return sorted(((r.g, r.h, r.score, r.tie, r["rank"]) for r in out.collect()), key=str)


def data(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + list("abcdef") + [None]), rng.choice([1, 1, 2, None]), rng.choice([None, float("nan"), float("inf"), -1.0] + [rng.randrange(20) / 4 for _ in range(12)]), rng.choice([None, "a", "b", "c", str(i)]), "x") for i in range(n)]


def test_against_brute_force(spark):
    rows = data(1, 4000)
    rows += rows[:100]
    for broadcast in (0, 1000):
        assert run(spark, rows, 3, broadcast_groups=broadcast) == brute(rows, lambda r: 3)


def test_number_by_group(spark):
    rows = data(2, 1500)
    n = F.when(F.col("g") == "hot", 10).when(F.col("g") == "a", 0).when(F.col("g") == "b", None).otherwise(2)
    assert run(spark, rows, n) == brute(rows, lambda r: {"hot": 10, "a": 0, "b": 0}.get(r[0], 2))


def test_batches_smaller_than_groups(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = data(3, 300)
        assert run(spark, rows, 4) == brute(rows, lambda r: 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_long(spark):
    assert run(spark, [], 3) == []
    long = "t" * 200_000
    assert run(spark, [("g", 1, 1.0, long, "x")], 3) == [("g", 1, 1.0, long, 1)]
    assert run(spark, [("g", 1, 1.0, "a", "x")] * 5, 2) == [("g", 1, 1.0, "a", 1), ("g", 1, 1.0, "a", 2)]


def test_whole_groups(spark):
    rows = data(5, 2000)
    df = spark.createDataFrame(rows, SCHEMA).drop("rank").repartition(4, "h")
    out = top_n(df, ["g", "h"], "score", ["tie"], 3, whole=F.col("h") == 1)
    assert sorted(((r.g, r.h, r.score, r.tie, r["rank"]) for r in out.collect()), key=str) == brute(rows, lambda r: 3)


def test_latest_together(spark):
    rng = random.Random(6)
    stamps = [None] + [dt.datetime(2024, 1, d, 12) for d in range(1, 6)]
    rows = [(rng.choice("aab"), rng.choice([None, 1, 2, 3]), rng.choice(stamps), rng.choice([None, 0.5, 1.0, 2.0]), "x") for _ in range(600)] + [("hot", 1, stamps[1], 3.0, "x")] * 3000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = latest_together(spark.createDataFrame(rows, "g string, k int, at timestamp, v double, extra string"), ["g"], ["g", "k"], "at", "v")
        got = {(r.g, r.k, r.v) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = {}
    for g, k, at, v, _ in rows:
        place = (at is not None, at or dt.datetime.min, v is not None, v or 0.0)
        best[g, k] = max(best.get((g, k), ((False, dt.datetime.min, False, 0.0), None)), (place, v), key=lambda x: x[0])
    assert got == {(*key, v) for key, (_, v) in best.items()}
    assert out.where(F.lit(False)).collect() == []
