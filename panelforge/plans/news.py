"""Queries over articles, membership, calendar and sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import dates, ids
from panelforge.operators import calendar, intensity, relational, sampling, temporal
from panelforge.operators.corpus import clean_articles, coverage_in_windows
from panelforge.operators.coverage import window_bounds
from panelforge.plans.intervals_and_asof import article_firms, padded_cik, table
from panelforge.streaming.events import windowed_counts

FIRST_CLOSE = dt.datetime(2016, 7, 29, 20, 0)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_news_articles")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "snp_membership").select("cik", "trading_day").dropna().distinct()


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of the membership's days, 13:30 to 20:00 UTC."""
    days = table(spark, sf_dir, "snp_membership").select("trading_day").dropna().distinct()
    at = lambda minutes: (F.unix_date("trading_day").cast("long") * 86400 + minutes * 60).cast("timestamp")
    return days.select("trading_day", at(810).alias("session_open_utc"), at(1200).alias("session_close_utc"))


def profile_windows(spark: SparkSession, sf_dir: str, days: DataFrame) -> DataFrame:
    """(cik, start_day, end_day) of the profile windows; none goes on beyond the last of the `days` (trading_day), so one that never ends can be spelled out."""
    rows = table(spark, sf_dir, "security_profile_history").select("cik", window_bounds(F.col("validity_window")).alias("w")).where(F.col("w").isNotNull())
    last = days.agg(F.unix_date(F.max("trading_day")).alias("_last")).where("_last is not null")
    clipped = rows.crossJoin(F.broadcast(last)).select("cik", F.col("w.lo").alias("lo"), F.least("w.hi", F.col("_last") + 1).alias("hi")).where("lo < hi")
    return clipped.select("cik", F.date_from_unix_date("lo").alias("start_day"), F.date_from_unix_date("hi").alias("end_day"))


def firm_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = articles(spark, sf_dir).withColumn("cik_list", F.transform("cik_list", padded_cik))
    return intensity.firm_day_counts(padded)


def a1_firm_day_counts(spark, sf_dir):
    return firm_days(spark, sf_dir)


def w4_selection_panel(spark, sf_dir):
    return intensity.selection_panel(firm_days(spark, sf_dir), membership(spark, sf_dir))


def a12_firm_coverage(spark, sf_dir):
    return article_firms(spark, sf_dir).groupBy("cik").agg(
        F.countDistinct("article_id").alias("n_articles"), F.countDistinct("trading_day").alias("n_days"), F.countDistinct(F.trunc("trading_day", "month")).alias("n_months"), F.countDistinct(F.year("trading_day")).alias("n_years"))


def a12_daily_sessions(spark, sf_dir):
    return articles(spark, sf_dir).where("trading_day is not null").groupBy("trading_day").agg(
        F.countDistinct(F.when(F.col("session") == "intraday", F.col("article_id"))).alias("n_intraday"), F.countDistinct(F.when(F.col("session") == "overnight", F.col("article_id"))).alias("n_overnight"))


def a13_window_coverage(spark, sf_dir):
    days = article_firms(spark, sf_dir).select("cik", "trading_day")
    universe = articles(spark, sf_dir).where("trading_day is not null")
    out = coverage_in_windows(days, profile_windows(spark, sf_dir, universe), "cik", "trading_day", universe)
    return out.select("cik", *[F.round(f"{p}_coverage", 6).alias(f"{p}_coverage") for p in ("year", "month", "day")])


def j2_membership_in_windows(spark, sf_dir):
    members = membership(spark, sf_dir)
    windows = profile_windows(spark, sf_dir, members)
    joined = temporal.interval_join(members, windows.withColumnRenamed("cik", "_cik").withColumn("cik", F.col("_cik")).drop("_cik"), ["cik"], "trading_day", "start_day", "end_day")
    return joined.select(members["cik"], members["trading_day"]).distinct().groupBy("cik").agg(F.count("*").alias("n_days"))


def j3_window_days(spark, sf_dir):
    members = membership(spark, sf_dir)
    return temporal.window_days(profile_windows(spark, sf_dir, members), ["cik"], "start_day", "end_day", members, "trading_day")


def j4_days_without_profile(spark, sf_dir):
    return relational.without(membership(spark, sf_dir), j3_window_days(spark, sf_dir), ["cik", "trading_day"])


def j5_firms_without_news(spark, sf_dir):
    return relational.without(membership(spark, sf_dir).select("cik").distinct(), article_firms(spark, sf_dir), ["cik"])


def j13_news_flag(spark, sf_dir):
    flagged = relational.membership_flag(membership(spark, sf_dir), article_firms(spark, sf_dir), ["cik", "trading_day"], "has_news")
    return flagged.groupBy("cik").agg(F.count("*").alias("n_days"), F.count_if("has_news").alias("n_news_days"))


def w10_presence_windows(spark, sf_dir):
    members = membership(spark, sf_dir)
    return temporal.presence_windows(members, "cik", "trading_day", members, "2025-08-01")


def u1_joiners_and_leavers(spark, sf_dir):
    return relational.joiners_and_leavers(membership(spark, sf_dir), "cik", "trading_day")


def s6_days_by_month(spark, sf_dir):
    return calendar.days_by_month(schedule(spark, sf_dir)).select("year", "month", F.array_join(F.transform("days", lambda d: F.date_format(d, "dd")), ",").alias("days"))


def t20_civil_calendar(spark, sf_dir):
    return calendar.civil_calendar(schedule(spark, sf_dir)).select("trading_day", "is_trading_day", "is_half_day", "is_weekend", "is_holiday")


def w5_overnight_fraction(spark, sf_dir):
    return calendar.overnight_fraction(schedule(spark, sf_dir), FIRST_CLOSE).select("trading_day", "next_trading_day", F.round("overnight_fraction", 9).alias("overnight_fraction"))


def x1_session_routing(spark, sf_dir):
    crawled = articles(spark, sf_dir).select("article_id", "warc_path", "warc_date_utc")
    routed = calendar.route_sessions(crawled, "warc_date_utc", F.date_from_unix_date(F.floor(F.unix_seconds("warc_date_utc") / 86400).cast("int")), schedule(spark, sf_dir))
    return routed.groupBy("trading_day", "session").agg(F.count("*").alias("n_records"))


def t27_session_caps(spark, sf_dir):
    fractions = calendar.overnight_fraction(schedule(spark, sf_dir), FIRST_CLOSE)
    return calendar.session_caps(fractions, 101, 42).select("trading_day", "intraday_cap", "overnight_cap")


def w11_session_sample(spark, sf_dir):
    dated = articles(spark, sf_dir).where("trading_day is not null").select("article_id", "trading_day", "session")
    return sampling.sample_by_session(dated, ["trading_day", "session"], "article_id", F.lit(2))


def o2_uniform_subset(spark, sf_dir):
    return sampling.uniform_subset(articles(spark, sf_dir).select("article_id").distinct(), "article_id", 500)


def f1_clean_articles(spark, sf_dir):
    return clean_articles(articles(spark, sf_dir), schedule(spark, sf_dir))


def f14_gate_funnel(spark, sf_dir):
    from panelforge.sources.warc import gate, gate_counts

    gated = articles(spark, sf_dir).select("session", gate(F.col("http_status"), F.col("http_content_type"), F.col("full_text"), F.col("language_confidence"), F.col("cik_list")).alias("gate"))
    return gate_counts(gated, ["session"])


def t12_article_ids(spark, sf_dir):
    return articles(spark, sf_dir).where("trading_day is not null").select("article_id", ids.article_id(F.col("trading_day"), F.col("session"), F.col("full_text")).alias("content_id")).distinct()


def t14_link_days(spark, sf_dir):
    named = articles(spark, sf_dir).select("article_id", F.concat(F.lit("crawl/NEWS-"), F.date_format("warc_date_utc", "yyyyMMddHHmmss"), F.lit("-1.warc.gz")).alias("line"))
    return named.select(dates.civil_day(dates.link_time(F.col("line"))).alias("local_day")).groupBy("local_day").agg(F.count("*").alias("n_links"))


def o4_first_capture(spark, sf_dir):
    best = relational.latest_per_key(articles(spark, sf_dir), ["article_id"], F.asc("warc_date_utc"), F.asc_nulls_last("warc_path"))
    return best.select("article_id", "warc_path", F.unix_micros("warc_date_utc").alias("captured_micros"))


def k4_insert_new_articles(spark, sf_dir):
    rows = articles(spark, sf_dir).select("article_id", "session")
    return relational.insert_new(rows.where("session = 'intraday'").dropDuplicates(["article_id"]), rows, ["article_id"])


def x3_event_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events, "ts", ["event_type"], "1 hour").select("window_start", "event_type", "n_events").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def m4_expected_durations(spark, sf_dir):
    durations = temporal.days_since_last(firm_days(spark, sf_dir), ["cik", "session"], "trading_day").where("duration_days > 0")
    out = intensity.recursion_by_aggregate(durations, ["cik", "session"], "trading_day", "duration_days", 1.0, 0.2, 0.5)
    return out.select("cik", "session", "trading_day", F.round("psi", 6).alias("psi"))


def m10_firm_year_intensity(spark, sf_dir):
    panel = w4_selection_panel(spark, sf_dir)
    return intensity.firm_year_intensity(intensity.event_intensities(panel), panel)


QUERIES = {f.__name__: f for f in (
    a1_firm_day_counts, w4_selection_panel, a12_firm_coverage, a12_daily_sessions, a13_window_coverage, j2_membership_in_windows, j3_window_days, j4_days_without_profile, j5_firms_without_news, j13_news_flag,
    w10_presence_windows, u1_joiners_and_leavers, s6_days_by_month, t20_civil_calendar, w5_overnight_fraction, x1_session_routing, t27_session_caps, w11_session_sample, o2_uniform_subset, f1_clean_articles,
    f14_gate_funnel, t12_article_ids, t14_link_days, o4_first_capture, k4_insert_new_articles, x3_event_windows, m4_expected_durations, m10_firm_year_intensity)}

_FIRMS = """
WITH RECURSIVE firms AS (
  SELECT article_id, lpad(trim(c), 10, '0') AS cik, min(trading_day) AS trading_day
  FROM (SELECT article_id, trading_day, unnest(cik_list) AS c FROM parsed_news_articles WHERE trading_day IS NOT NULL) WHERE trim(c) <> '' GROUP BY 1, 2),
firm_days AS (
  SELECT cik, session, trading_day, count(*) AS daily_article_count
  FROM (SELECT DISTINCT article_id, session, trading_day, lpad(trim(c), 10, '0') AS cik FROM (SELECT *, unnest(cik_list) AS c FROM parsed_news_articles WHERE trading_day IS NOT NULL AND session IS NOT NULL) WHERE trim(c) <> '')
  GROUP BY 1, 2, 3),
members AS (SELECT DISTINCT cik, trading_day FROM snp_membership WHERE cik IS NOT NULL AND trading_day IS NOT NULL),
windows AS (
  SELECT cik, lo, hi FROM (
    SELECT cik, TRY_CAST(substr(validity_window, 2, 10) AS DATE) + CASE WHEN validity_window LIKE '(%' THEN 1 ELSE 0 END AS lo,
           CASE WHEN regexp_matches(validity_window, ',\\s*[\\])]$') THEN DATE '9999-12-31'
                ELSE TRY_CAST(regexp_extract(validity_window, ',\\s*([0-9-]{10})', 1) AS DATE) + CASE WHEN validity_window LIKE '%]' THEN 1 ELSE 0 END END AS hi
    FROM security_profile_history) WHERE lo < hi),
window_days AS (SELECT DISTINCT w.cik, d.trading_day FROM windows w JOIN (SELECT DISTINCT trading_day FROM members) d ON d.trading_day >= w.lo AND d.trading_day < w.hi),
days AS (SELECT trading_day, lead(trading_day) OVER (ORDER BY trading_day) AS following, lag(trading_day) OVER (ORDER BY trading_day) AS before FROM (SELECT DISTINCT trading_day FROM members))
"""
_SPELLED = """, covered AS (
  SELECT DISTINCT w.cik, d.trading_day FROM windows w JOIN (SELECT DISTINCT trading_day FROM parsed_news_articles WHERE trading_day IS NOT NULL) d ON d.trading_day >= w.lo AND d.trading_day < w.hi),
flagged AS (SELECT c.cik, c.trading_day, f.cik IS NOT NULL AS hit FROM covered c LEFT JOIN (SELECT DISTINCT cik, trading_day FROM firms) f USING (cik, trading_day))
"""
ORACLES = {
    "a1_firm_day_counts": _FIRMS + "SELECT * FROM firm_days",
    "w4_selection_panel": _FIRMS + """SELECT m.cik, s.session, m.trading_day, coalesce(d.daily_article_count, 0) AS daily_article_count, d.duration_days
  FROM members m CROSS JOIN (VALUES ('intraday'), ('overnight')) s(session)
  LEFT JOIN (SELECT *, CAST(trading_day - lag(trading_day) OVER (PARTITION BY cik, session ORDER BY trading_day) AS INTEGER) AS duration_days FROM firm_days) d USING (cik, session, trading_day)""",
    "a12_firm_coverage": _FIRMS + "SELECT cik, count(DISTINCT article_id) AS n_articles, count(DISTINCT trading_day) AS n_days, count(DISTINCT date_trunc('month', trading_day)) AS n_months, count(DISTINCT year(trading_day)) AS n_years FROM firms GROUP BY cik",
    "a12_daily_sessions": "SELECT trading_day, count(DISTINCT article_id) FILTER (session = 'intraday') AS n_intraday, count(DISTINCT article_id) FILTER (session = 'overnight') AS n_overnight FROM parsed_news_articles WHERE trading_day IS NOT NULL GROUP BY 1",
    "a13_window_coverage": _FIRMS + _SPELLED + """SELECT cik, round(count(DISTINCT CASE WHEN hit THEN year(trading_day) END) / count(DISTINCT year(trading_day)), 6) AS year_coverage,
  round(count(DISTINCT CASE WHEN hit THEN date_trunc('month', trading_day) END) / count(DISTINCT date_trunc('month', trading_day)), 6) AS month_coverage,
  round(count(DISTINCT CASE WHEN hit THEN trading_day END) / count(DISTINCT trading_day), 6) AS day_coverage FROM flagged GROUP BY cik""",
    "j2_membership_in_windows": _FIRMS + "SELECT m.cik, count(*) AS n_days FROM members m WHERE EXISTS (SELECT 1 FROM windows w WHERE w.cik = m.cik AND m.trading_day >= w.lo AND m.trading_day < w.hi) GROUP BY 1",
    "j3_window_days": _FIRMS + "SELECT * FROM window_days",
    "j4_days_without_profile": _FIRMS + "SELECT * FROM members EXCEPT SELECT * FROM window_days",
    "j5_firms_without_news": _FIRMS + "SELECT DISTINCT cik FROM members WHERE cik NOT IN (SELECT cik FROM firms)",
    "j13_news_flag": _FIRMS + "SELECT m.cik, count(*) AS n_days, count(f.cik) AS n_news_days FROM members m LEFT JOIN (SELECT DISTINCT cik, trading_day FROM firms) f USING (cik, trading_day) GROUP BY 1",
    "w10_presence_windows": _FIRMS + """, marked AS (SELECT m.cik, m.trading_day, d.following, CASE WHEN lag(d.following) OVER (PARTITION BY m.cik ORDER BY m.trading_day) = m.trading_day THEN 0 ELSE 1 END AS opens FROM members m JOIN days d USING (trading_day)),
  runs AS (SELECT *, sum(opens) OVER (PARTITION BY cik ORDER BY trading_day) AS run FROM marked)
  SELECT cik, min(trading_day) AS start_day, coalesce(CAST(arg_max(coalesce(following, DATE '2025-08-02'), trading_day) AS DATE), DATE '2025-08-02') AS end_day FROM runs GROUP BY cik, run""",
    "u1_joiners_and_leavers": _FIRMS + """, pairs AS (SELECT * FROM days WHERE following IS NOT NULL)
  SELECT m.cik, m.trading_day, 'join' AS change FROM members m JOIN days d USING (trading_day) WHERE d.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM members p WHERE p.cik = m.cik AND p.trading_day = d.before)
  UNION ALL SELECT m.cik, d.following, 'leave' FROM members m JOIN pairs d USING (trading_day) WHERE NOT EXISTS (SELECT 1 FROM members p WHERE p.cik = m.cik AND p.trading_day = d.following)""",
    "s6_days_by_month": _FIRMS + "SELECT CAST(year(trading_day) AS INTEGER) AS year, CAST(month(trading_day) AS INTEGER) AS month, string_agg(strftime(trading_day, '%d'), ',' ORDER BY trading_day) AS days FROM days GROUP BY 1, 2",
    "t20_civil_calendar": _FIRMS + """, civil AS (SELECT CAST(unnest(generate_series((SELECT min(trading_day) FROM days), (SELECT max(trading_day) FROM days), INTERVAL 1 DAY)) AS DATE) AS trading_day)
  SELECT c.trading_day, d.trading_day IS NOT NULL AS is_trading_day, false AS is_half_day, d.trading_day IS NULL AND dayofweek(c.trading_day) IN (0, 6) AS is_weekend, d.trading_day IS NULL AND dayofweek(c.trading_day) NOT IN (0, 6) AS is_holiday
  FROM civil c LEFT JOIN days d USING (trading_day)""",
    "w5_overnight_fraction": _FIRMS + """SELECT trading_day, following AS next_trading_day, round(night / (night + 390.0), 9) AS overnight_fraction FROM (
  SELECT trading_day, following, greatest(0, (trading_day - coalesce(before, DATE '2016-07-29')) * 1440 + 810 - 1200) AS night FROM days)""",
    "x1_session_routing": _FIRMS + """, crawled AS (SELECT warc_date_utc AT TIME ZONE 'UTC' AS moment FROM parsed_news_articles),
  bounds AS (SELECT min(trading_day) AS a, max(trading_day) AS b FROM days),
  placed AS (SELECT moment, CAST(moment AS DATE) AS day, moment - CAST(moment AS DATE) AS clock FROM crawled),
  own AS (SELECT p.*, d.trading_day AS own FROM placed p LEFT JOIN days d ON d.trading_day = p.day),
  flagged AS (SELECT *, own IS NOT NULL AND moment >= own + INTERVAL 810 MINUTE AND moment < own + INTERVAL 1200 MINUTE AS inside, own IS NOT NULL AND moment < own + INTERVAL 810 MINUTE AS early FROM own),
  routed AS (SELECT CASE WHEN inside OR early THEN own WHEN day >= (SELECT a FROM bounds) THEN (SELECT min(trading_day) FROM days d WHERE d.trading_day > flagged.day) END AS trading_day, inside FROM flagged)
  SELECT trading_day, CASE WHEN inside THEN 'intraday' WHEN trading_day IS NOT NULL THEN 'overnight' END AS session, count(*) AS n_records FROM routed GROUP BY 1, 2""",
    "t12_article_ids": "SELECT DISTINCT article_id, sha1(concat_ws('|', strftime(trading_day, '%Y-%m-%d'), session, full_text)) AS content_id FROM parsed_news_articles WHERE trading_day IS NOT NULL",
    "t14_link_days": "SELECT CAST(date_trunc('second', warc_date_utc) AT TIME ZONE 'America/New_York' AS DATE) AS local_day, count(*) AS n_links FROM parsed_news_articles GROUP BY 1",
    "o4_first_capture": "SELECT article_id, warc_path, epoch_us(warc_date_utc) AS captured_micros FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY warc_date_utc NULLS FIRST, warc_path NULLS LAST) AS rn FROM parsed_news_articles) WHERE rn = 1",
    "k4_insert_new_articles": "SELECT article_id, CASE WHEN bool_or(session = 'intraday') THEN 'intraday' ELSE min(session) END AS session FROM parsed_news_articles GROUP BY 1",
    "x3_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2",
    "m4_expected_durations": _FIRMS + """, gaps AS (SELECT *, CAST(trading_day - lag(trading_day) OVER (PARTITION BY cik, session ORDER BY trading_day) AS INTEGER) AS x FROM firm_days),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY cik, session ORDER BY trading_day) AS t FROM gaps WHERE x > 0),
  psi AS (SELECT cik, session, t, trading_day, x, CAST(1.0 / (1 - 0.2 - 0.5) AS DOUBLE) AS psi FROM numbered WHERE t = 1
    UNION ALL SELECT n.cik, n.session, n.t, n.trading_day, n.x, 1.0 + 0.2 * p.x + 0.5 * p.psi FROM psi p JOIN numbered n ON n.cik = p.cik AND n.session = p.session AND n.t = p.t + 1)
  SELECT cik, session, trading_day, round(psi, 6) AS psi FROM psi""",
    "f14_gate_funnel": """WITH g AS (SELECT session, CASE WHEN http_status IS DISTINCT FROM 200 THEN 1 WHEN NOT coalesce(contains(lower(http_content_type), 'html'), false) THEN 2 WHEN coalesce(full_text, '') = '' THEN 3
  WHEN len(regexp_extract_all(full_text, '\\S+')) < 25 THEN 4 WHEN len(regexp_extract_all(full_text, '\\S+')) > 3000 THEN 5 WHEN NOT coalesce(language_confidence >= 0.99, false) THEN 6
  WHEN coalesce(len(cik_list), 0) < 1 THEN 7 WHEN len(cik_list) > 3 THEN 8 ELSE 9 END AS g FROM parsed_news_articles)
  SELECT session, count(*) AS records, count(*) FILTER (g > 1) AS passed_status, count(*) FILTER (g > 2) AS passed_content_type, count(*) FILTER (g > 3) AS passed_no_text, count(*) FILTER (g > 4) AS passed_too_short,
  count(*) FILTER (g > 5) AS passed_too_long, count(*) FILTER (g > 6) AS passed_language, count(*) FILTER (g > 7) AS passed_no_firm, count(*) FILTER (g > 8) AS passed_many_firms FROM g GROUP BY session""",
}
