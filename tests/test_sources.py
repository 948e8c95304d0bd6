import datetime as dt
import gzip
import io

import pytest
from pyspark.sql import functions as F

from panelforge.sources import feeds, files, http, sinks, warc


def test_text_sources(spark, tmp_path):
    (tmp_path / "2020/01/02/intraday").mkdir(parents=True)
    (tmp_path / "2020/01/02/intraday/samples.txt").write_text("a\n\n b \n")
    root = f"file://{tmp_path}"
    got = files.session_lines(spark, root, [(2020, 1, 2, "intraday"), (2020, 1, 2, "overnight")]).collect()
    assert [r.value for r in got] == ["a", "b"] and got[0].path.endswith("samples.txt")
    assert files.session_lines(spark, root, [(2021, 1, 2, "intraday")]).count() == 0
    assert [r.value for r in files.lines(spark, root, "s3/").collect()] == ["s3/a", "s3/b"]
    paths = spark.createDataFrame([("x/2019/03/warc_queue.txt",), ("x/other.txt",)], "p string")
    y, m = files.month_of_path(F.col("p"))
    assert [tuple(r) for r in paths.select(y.alias("y"), m.alias("m")).collect()] == [(2019, 3), (None, None)]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nalias,canonical\n# more\nAABA,YHOO\n")
    assert [tuple(r) for r in files.commented_csv(spark, str(tmp_path / "a.csv"), "alias string, canonical string").collect()] == [("AABA", "YHOO")]
    (tmp_path / "s.csv").write_text('date,tickers\n2020-01-03,"B,A,"\n2020-01-02,A\n2021-01-01,C\n')
    snapshots = files.snapshots(spark, str(tmp_path / "s.csv"), "2020-01-01", "2020-12-31")
    assert [tuple(r) for r in files.listed_tickers(snapshots).collect()] == [(dt.date(2020, 1, 2), "A"), (dt.date(2020, 1, 3), "B"), (dt.date(2020, 1, 3), "A")]


def test_topic_files(spark, tmp_path):
    (tmp_path / "topics.txt").write_text("# doc\n0 art1 0.25 0.75\n\n1\tart2\t1.0\t0\n")
    rows = sorted(tuple(r) for r in files.document_topics(spark, str(tmp_path / "topics.txt")).collect())
    assert rows == [(0, "art1", 0, 0.25), (0, "art1", 1, 0.75), (1, "art2", 0, 1.0), (1, "art2", 1, 0.0)]
    (tmp_path / "bad.txt").write_text("0 art1\n")
    with pytest.raises(Exception, match="too few fields"):
        files.document_topics(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "w.tsv").write_text("0\tsales\t1.5\n")
    assert [tuple(r) for r in files.topic_word_weights(spark, str(tmp_path / "w.tsv")).collect()] == [(0, "sales", 1.5)]
    (tmp_path / "w2.tsv").write_text("0\tsales\tx\n")
    with pytest.raises(Exception):  # noqa: B017
        files.topic_word_weights(spark, str(tmp_path / "w2.tsv")).collect()
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "K200_seed7.parquet"))
    part = next((tmp_path / "K200_seed7.parquet").glob("*.parquet"))
    part.rename(tmp_path / "K9_seed12.parquet")
    assert files.runs_by_name(spark, str(tmp_path / "K9_seed*.parquet")).first().run_id == "12"


def archive(records):
    out = io.BytesIO()
    with gzip.open(out, "wb") as f:
        for kind, body in records:
            f.write(b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: http://x.example/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % (kind, len(body)) + body + b"\r\n\r\n")
    return out.getvalue()


def test_archives(spark, tmp_path):
    page = "<p>café</p>".encode("cp1251", "replace")
    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=windows-1251\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(page)
    (tmp_path / "a.warc.gz").write_bytes(archive([(b"warcinfo", b"x"), (b"response", ok), (b"response", b"garbage"), (b"response", b"HTTP/1.1 404 Not Found\r\n\r\nno")]))
    (tmp_path / "bad.warc.gz").write_bytes(b"not gzip")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.warc.gz", "bad.warc.gz", "none.warc.gz")], "path string")
    got = warc.read_archives(spark, paths, batch=2).withColumn("text", warc.decoded(F.col("payload"), warc.charset(F.col("content_type")))).collect()
    assert sorted((r.status or 0, r.error is not None) for r in got) == [(0, True), (0, True), (0, True), (200, False), (404, False)]
    assert next(r.text for r in got if r.status == 200) == page.decode("cp1251")


def test_gates(spark):
    words = "w " * 30
    rows = [(404, "text/html", words, 1.0, ["a"]), (200, "text/plain", words, 1.0, ["a"]), (200, "text/html", None, 1.0, ["a"]), (200, "text/html", "w", 1.0, ["a"]), (200, "text/html", "w " * 3001, 1.0, ["a"]),
            (200, "text/html", words, 0.9, ["a"]), (200, "text/html", words, 1.0, []), (200, "text/html", words, 1.0, list("abcd")), (200, "TEXT/HTML", words, 0.99, ["a"])]
    df = spark.createDataFrame(rows, "s int, c string, t string, e double, f array<string>").select(F.lit(1).alias("k"), warc.gate(*map(F.col, "sctef")).alias("gate"))
    assert sorted(r.gate for r in df.collect()) == sorted(["status", "content_type", "no_text", "too_short", "too_long", "language", "no_firm", "many_firms", "kept"])
    assert tuple(warc.gate_counts(df, ["k"]).first()) == (1, 9, 8, 7, 6, 5, 4, 3, 2, 1)


def test_json_feeds(spark):
    base = spark.createDataFrame([("A", dt.date(2020, 1, 1), dt.date(2020, 12, 31), '{"2020-03-31": {"filing_date": "2020-05-01", "totalAssets": "10", "totalLiab": "4", "commonStockSharesOutstanding": "7"}, "2020-06-30": {"filing_date": null}, "2019-06-30": {"filing_date": "2020-02-01"}}',
                                   '[{"date": "2020-01-01", "close": 1.5}, {"date": "2020-12-31", "close": 2}]', '[["timestamp", "original"], ["20200102030405", "http://x"], ["bad", "http://y"]]'),
                                  ("B", dt.date(2020, 1, 1), dt.date(2020, 12, 31), "[]", "{}", "null")], "k string, s date, e date, q string, b string, c string")
    assert [tuple(r) for r in feeds.quarters(base, "q", "s", "e", ["k"]).collect()] == [("A", dt.date(2020, 5, 1), 6.0, 7.0)]
    assert [(r.k, r.trading_day, r.close) for r in feeds.bars(base, "b", "s", "e", ["k"]).collect()] == [("A", dt.date(2020, 1, 1), 1.5)]
    captures = feeds.captures(base, "c", ["k"]).orderBy("url").collect()
    assert [(r.url, r.captured_at is None) for r in captures] == [("http://x", False), ("http://y", True)]
    forms = spark.createDataFrame([(" 10-k ", "x"), (None, "8-K - report")], "c string, t string").select(feeds.entry_form(F.col("c"), F.col("t")).alias("f")).collect()
    assert [r.f for r in forms] == ["10-K", "8-K"]
    n, d = feeds.report_items(F.col("i"), ("1.01",))
    assert tuple(spark.createDataFrame([(["Item 1.01: Entry", "Item 9.01: Other", "junk"],)], "i array<string>").select(n.alias("n"), d.alias("d")).first()) == (["1.01"], ["Entry"])


def test_xml_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed xmlns="http://a"><entry><id>1</id><title>10-K x</title><updated>2020-01-01</updated><category term="10-K"/></entry><entry><id>2</id></entry></feed>')
    rows = feeds.feed_entries(spark, str(tmp_path / "f.xml")).orderBy("id").collect()
    assert [(r.id, r.category["_term"] if r.category else None) for r in rows] == [("1", "10-K"), ("2", None)]


def test_http():
    assert http.url("http://x", a=1, b=["p", "q"], c=None) == "http://x?a=1&b=p%2Cq"
    assert http.retry_after("3", 1.0) == 3.0 and http.retry_after(None, 1.0) == 1.0 and http.retry_after("junk", 1.0) == 1.0
    now = dt.datetime(2020, 1, 1, tzinfo=dt.UTC)
    assert http.retry_after("Wed, 01 Jan 2020 00:00:09 GMT", 1.0, now) == 9.0
    assert http.pause(429, {"Retry-After": "4"}, 0, 1.0) == 4.0 and 4 <= http.pause(503, {}, 2, 1.0) <= 5
    with pytest.raises(ValueError):
        http.pause(404, {}, 0, 1.0)
    assert http.inclusive_end(dt.date(2020, 1, 1)) == "2019-12-31"
    tries, waits = [], []

    class Answer(io.BytesIO):
        headers = {"Content-Type": "application/json"}

    def opener(request, timeout):
        tries.append(1)
        if len(tries) < 3:
            raise http.urllib.error.URLError("down")
        return Answer(b"{}")

    assert http.get("http://x", opener=opener, wait=waits.append) == b"{}" and len(waits) == 2
    days = [dt.date(2020, 1, d) for d in range(1, 20)]
    pages = list(http.pages_backwards(lambda end: [d for d in days if d <= end][-5:], min, dt.date(2020, 1, 8), dt.date(2020, 1, 19)))
    assert [len(p) for p in pages] == [5, 5, 5] and pages[-1][0] < dt.date(2020, 1, 8)


def test_sinks(spark, tmp_path):
    rows = [("a", dt.date(2020, 1, 2), "intraday", 30), ("a", dt.date(2020, 1, 2), "intraday", 30), ("b", dt.date(2020, 1, 3), "overnight", 10)]
    df = spark.createDataFrame(rows, "article_id string, trading_day date, session string, word_count int")
    root = str(tmp_path / "articles")
    sinks.write_articles(df, root)
    sinks.write_articles(df.where("article_id = 'b'"), root)
    assert files.articles_in_partitions(spark, root).select("article_id", "year", "session").collect()[0][:] == ("a", 2020, "intraday") and spark.read.parquet(root).count() == 2
    assert not sinks.write_if_any(df.limit(0), str(tmp_path / "none")) and sinks.write_if_any(df, str(tmp_path / "some"))
    table = sinks.KeyedTable(spark, f"file://{tmp_path}/keyed", ["k"], "k int, v string")
    assert table.read().count() == 0
    table.insert_new(spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string"))
    table.insert_new(spark.createDataFrame([(1, "z"), (2, "b")], "k int, v string"))
    table.upsert(spark.createDataFrame([(2, "new"), (3, "c")], "k int, v string"))
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "a"), (2, "new"), (3, "c")] and len(table.versions()) == 2
    sinks.write_text(df.select("session", F.col("article_id").alias("value")), str(tmp_path / "lines"), partitions=["session"])
    assert spark.read.text(str(tmp_path / "lines")).count() == 3
    texts = files.by_ids(spark.createDataFrame([("b", "same"), ("a", "same"), ("c", "x"), ("d", "y")], "article_id string, full_text string"), spark.createDataFrame([("a",), ("b",), ("c",)], "article_id string"))
    assert sorted(r.article_id for r in texts.collect()) == ["a", "c"]
