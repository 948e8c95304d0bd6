"""Windows that never end, on small tables."""

import datetime as dt

import pytest

from panelforge.plans import news, records


def day(n):
    return dt.date(2020, 1, n)


@pytest.fixture(scope="module")
def profiles(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("profiles"))
    windows = [("A" * 10, "[2020-01-03,)"), ("A" * 10, "[2020-01-01,2020-01-02)"), ("E" * 10, "[2020-01-01,)"), ("A", "[2020-01-03,)"), ("A", "[2020-01-01,2020-01-02)"), ("B", "(2020-01-02, 2020-01-04)"), ("C", "[2020-01-09,)"), ("D", "empty"), ("E", "[2019-01-01,9999-12-31)"), ("F", None)]
    spark.createDataFrame(windows, "cik string, validity_window string").write.parquet(f"{folder}/security_profile_history.parquet")
    spark.createDataFrame([(c, day(n)) for c in "ABCDEF" for n in range(1, 6)], "cik string, trading_day date").write.parquet(f"{folder}/snp_membership.parquet")
    articles = [("x", day(1), ["A" * 10]), ("y", day(6), ["E" * 10]), ("z", None, ["A" * 10])]
    spark.createDataFrame(articles, "article_id string, trading_day date, cik_list array<string>").write.parquet(f"{folder}/parsed_news_articles.parquet")
    return folder


def test_days_of_open_windows(spark, profiles):
    held = {("A", day(n)) for n in (1, 3, 4, 5)} | {("B", day(3))} | {("E", day(n)) for n in range(1, 6)}
    assert {tuple(r) for r in news.j3_window_days(spark, profiles).where("length(cik) = 1").select("cik", "trading_day").collect()} == held
    assert {tuple(r) for r in news.j2_membership_in_windows(spark, profiles).collect()} == {("A", 4), ("B", 1), ("E", 5)}
    assert {tuple(r) for r in news.j4_days_without_profile(spark, profiles).select("cik", "trading_day").collect()} == {(c, day(n)) for c in "ABCDEF" for n in range(1, 6)} - held


def test_coverage_of_open_windows(spark, profiles):
    got = {r.cik: r.day_coverage for r in news.a13_window_coverage(spark, profiles).collect()}
    assert got["A" * 10] == 0.5 and got["E" * 10] == 0.5 and "C" not in got


@pytest.fixture(scope="module")
def mappings(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("mappings"))
    windows = [("T", "1", "[2020-01-01,)"), ("t ", "2", "[2020-01-10,2020-01-20)"), ("U", "3", "[2020-01-01,2020-01-05)"), ("U", "3", "[2020-01-05,)"), ("V", "4", "[2020-01-03,)"), ("W", "5", "empty"),
               ("X", "6", "[2020-01-01,2020-01-09)"), ("X", "7", "[2020-01-05,)")]
    spark.createDataFrame(windows, "ticker string, cik string, validity_window string").write.parquet(f"{folder}/ticker_cik_mapping.parquet")
    seen = [("v", dt.datetime(2020, 1, 2, 12)), ("v", dt.datetime(2024, 5, 5, 12)), ("u", dt.datetime(2020, 1, 5, 12)), ("W", dt.datetime(2020, 1, 5, 12))]
    spark.createDataFrame(seen, "ticker string, first_seen_at timestamp").write.parquet(f"{folder}/wayback_cik_candidates.parquet")
    return folder


def test_aliases_of_open_windows(spark, mappings):
    got = {(r.ticker, r.seen_day) for r in records.j12_alias_rewriting(spark, mappings).collect()}
    assert got == {("V", day(2)), ("4", dt.date(2024, 5, 5)), ("3", day(5)), ("W", day(5))}


def test_overlaps_of_open_windows(spark, mappings):
    assert {tuple(r) for r in records.c1_overlapping_windows(spark, mappings).collect()} == {("T", 1), ("X", 1)}


def test_texts_of_open_windows(spark, mappings):
    got = {(r.ticker, r.cik, r.window, r.start_day, r.end_day) for r in records.t28_window_texts(spark, mappings).collect()}
    assert ("V", "4", "2020-01-03 to infinity", day(3), None) in got and ("T", "2", "2020-01-10 to 2020-01-20", day(10), day(20)) in got and len(got) == 7


def test_split_of_open_windows(spark, mappings):
    got = {(r.ticker, r.candidate_cik, r.start_day, r.end_day) for r in records.t39_window_split(spark, mappings).collect()}
    assert {g for g in got if g[0] in "TX"} == {("T", "1", day(1), day(10)), ("T", "2", day(10), day(20)), ("X", "6", day(1), day(5)), ("X", "7", day(5), None)}
    assert ("V", "4", day(3), None) in got
