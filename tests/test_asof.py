import datetime as dt
import random

from pyspark.sql import functions as F

from panelforge.operators.asof import latest_versions, utc_day

EPOCH = dt.date(1970, 1, 1)
EVENTS, VERSIONS = "id int, firm string, day date, name string", "firm string, lo int, hi int, known int, seen int, tag string, name string, _s int"


def answer(spark, events, versions, shard_days):
    ev = spark.createDataFrame([(i, f, EPOCH + dt.timedelta(d) if d is not None else None, "clash") for i, (f, d) in enumerate(events)], EVENTS)
    ve = spark.createDataFrame(versions, VERSIONS)
    bounds = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.struct("lo", "hi"))
    out = latest_versions(ev, ve, "firm", "day", bounds, F.col("known"), {"seen": F.col("seen"), "tag": F.col("tag")}, ["tag", "name"], shard_days)
    assert out.columns == ["firm", "day", "tag", "name"]
    rows = [(r.firm, (r.day - EPOCH).days, r.tag, r.name) for r in out.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2:] for r in rows}


def brute(events, versions):
    out = {}
    for firm, day in events:
        if firm is None or day is None:
            continue
        able = [v for v in versions if v[0] == firm and None not in v[1:4] and v[1] <= day < v[2] and v[3] <= day]
        if able:
            best = max(able, key=lambda v: (v[4] is not None, v[4] or 0, v[5] is not None, v[5] or "", v[6] is not None, v[6] or ""))
            out[firm, day] = (best[5], best[6])
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    firm = lambda: rng.choice(["hot"] * 5 + ["a", "b", "c", None])
    events = [(firm(), rng.choice([None] + [rng.randrange(-50, 300)] * 9)) for _ in range(500)]
    versions = []
    for i in range(300):
        lo = rng.randrange(-60, 290)
        versions.append((firm(), rng.choice([lo] * 9 + [None]), rng.choice([lo + rng.randrange(-3, 120), 2**31 - 1]), rng.choice([None] + [lo + rng.randrange(-20, 60)] * 9), rng.choice([None, 1, 2, 3, 4]), f"e{i % 40}", rng.choice([None, "x", "y"]), 1))
    versions += versions[:30]
    for shard in (1, 16, 10_000):
        assert answer(spark, events, versions, shard) == brute(events, versions)


def test_later_knowledge_is_never_used(spark):
    versions = [("a", 0, 100, 5, 1, "old", "old", 0), ("a", 0, 100, 50, 2, "new", "new", 0)]
    assert answer(spark, [("a", 4), ("a", 49), ("a", 50)], versions, 512) == {("a", 49): ("old", "old"), ("a", 50): ("new", "new")}


def test_empty_tables(spark):
    assert answer(spark, [], [("a", 0, 1, 0, 1, "t", "n", 0)], 512) == {}
    assert answer(spark, [("a", 0)], [], 512) == {}
    assert answer(spark, [("a", None)], [("a", 0, 1, 0, 1, "t", "n", 0)], 512) == {}


def test_utc_day(spark):
    at = [dt.datetime(1969, 12, 31, 23, 59, 59, tzinfo=dt.UTC), dt.datetime(1970, 1, 1, tzinfo=dt.UTC), dt.datetime(2024, 2, 29, 23, 59, 59, 999999, tzinfo=dt.UTC)]
    got = [r.d for r in spark.createDataFrame([(a,) for a in at], "t timestamp").select(utc_day(F.col("t")).alias("d")).collect()]
    assert got == [-1, 0, (dt.date(2024, 2, 29) - EPOCH).days]
