import datetime as dt

from pyspark.sql import functions as F

from panelforge.streaming import events


def run(spark, df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def stream(spark, path, df):
    df.repartition(1).write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_links_are_routed_and_dead_letters_kept(spark, tmp_path):
    lines = spark.createDataFrame([("c/NEWS-20200102150000-1.gz",), ("c/NEWS-20200102220000-1.gz",), ("junk",)], "value string")
    ts = lambda d, h: dt.datetime(2020, 1, d, h, tzinfo=dt.UTC)
    schedule = spark.createDataFrame([(dt.date(2020, 1, 2), ts(2, 14), ts(2, 21)), (dt.date(2020, 1, 3), ts(3, 14), ts(3, 21))], "trading_day date, session_open_utc timestamp, session_close_utc timestamp")
    good, dead = events.parsed_links(stream(spark, tmp_path / "l", lines))
    rows = run(spark, events.routed(good, schedule).select("value", "trading_day", "session"), "routed", "append")
    assert sorted((r.trading_day.day, r.session) for r in rows) == [(2, "intraday"), (3, "overnight")]
    assert [r.value for r in run(spark, dead, "dead", "append")] == ["junk"]
    assert tuple(events.dead_letter_report(events.parsed_links(lines)[1]).first()) == (1, ["junk"])


def test_reservoirs_keep_bounded_state(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("k"), F.col("id").cast("string").alias("item"))
    for cap in (0, 5):
        rows = run(spark, events.reservoirs(stream(spark, tmp_path / f"r{cap}", df), ["k"], "item", cap), f"reservoir{cap}", "update")
        assert sorted((r.k, r.seen, len(set(r["items"]))) for r in rows) == [(0, 100, cap), (1, 100, cap)]


def test_windows(spark, tmp_path):
    at = [dt.datetime(2020, 1, 1, 0, m, tzinfo=dt.UTC) for m in (0, 1, 6, 50)]
    df = spark.createDataFrame([(t, "a") for t in at], "ts timestamp, k string")
    got = run(spark, events.windowed_counts(stream(spark, tmp_path / "w", df), "ts", ["k"]), "windows", "complete")
    assert sorted(r.n_events for r in got) == [1, 1, 2]
    sessions = events.sessions_by_gap(df, "ts", ["k"]).collect()
    assert sorted(r.n_events for r in sessions) == [1, 3]
