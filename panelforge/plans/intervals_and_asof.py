"""Queries p1_ and p5_: validity periods and gaps, and firm attributes as known on the trading day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.asof import latest_versions, utc_day
from panelforge.operators.coverage import day_text, merge_periods, window_bounds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def padded_cik(c: Column) -> Column:
    """A cik with its leading zeros; null where it is blank."""
    bare = F.trim(c)
    return F.when(F.length(bare) >= 10, bare).when(bare != "", F.lpad(bare, 10, "0"))


def validity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (table_name, entity, kind, lo, hi) over the three tables with validity windows, in one merge."""
    entities = {
        "security_profile_history": F.col("cik"),
        "ticker_cik_mapping": ticker_key(F.col("ticker")),
        "wayback_cik_candidates": F.concat(ticker_key(F.col("ticker")), F.lit("/"), F.col("candidate_cik")),
    }
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), e.alias("entity"), "validity_window") for t, e in entities.items()]
    return merge_periods(parts[0].union(parts[1]).union(parts[2]), ["table_name", "entity"], window_bounds(F.col("validity_window")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity_coverage(spark, sf_dir).select("table_name", "entity", "kind", day_text(F.col("lo")).alias("start_day"), day_text(F.col("hi")).alias("end_day"))


def p1_coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered days of each entity; null covered_days where a period never ends."""
    days = (F.col("hi") - F.col("lo")).cast("long")
    endless = (F.col("kind") == "period") & (day_text(F.col("hi")) == "infinity")
    return (
        validity_coverage(spark, sf_dir).groupBy("table_name", "entity")
        .agg(F.count(F.when(F.col("kind") == "period", 1)).alias("n_periods"),
             F.count(F.when(F.col("kind") == "gap", 1)).alias("n_gaps"),
             F.when(~F.max(endless), F.sum(F.when(F.col("kind") == "period", days))).alias("covered_days"),
             F.coalesce(F.sum(F.when(F.col("kind") == "gap", days)), F.lit(0)).cast("long").alias("gap_days"))
    )


def article_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, cik, trading_day), one row for each article and firm; of several trading days the first counts."""
    return (
        table(spark, sf_dir, "parsed_news_articles").where(F.col("trading_day").isNotNull() & F.col("article_id").isNotNull())
        .select("article_id", "trading_day", F.explode("cik_list").alias("cik"))
        .select("article_id", padded_cik(F.col("cik")).alias("cik"), "trading_day").where(F.col("cik").isNotNull())
        .groupBy("article_id", "cik").agg(F.min("trading_day").alias("trading_day"))
    )


def firms_as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, cik, trading_day, evidence_id, company_name) of the firms whose membership was known on the day, too."""
    firms = article_firms(spark, sf_dir)
    members = (
        table(spark, sf_dir, "snp_membership").where(utc_day(F.col("ingested_at")) <= F.unix_date("trading_day"))
        .select("cik", "trading_day").distinct()
    )
    days = firms.select("cik", "trading_day").distinct().join(members, ["cik", "trading_day"], "left_semi")
    names = latest_versions(
        days, table(spark, sf_dir, "security_profile_history"), "cik", "trading_day", window_bounds(F.col("validity_window")), utc_day(F.col("ingested_at")),
        {"ingested_at": F.col("ingested_at"), "evidence_id": F.col("evidence_id")}, ["evidence_id", "company_name"],
    )
    return firms.join(names, ["cik", "trading_day"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firms_as_known(spark, sf_dir).select("article_id", "cik", "evidence_id")


def p5_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firms_as_known(spark, sf_dir).select("article_id", "cik", "trading_day", "company_name")


QUERIES = {"p1_found": p1_found, "p1_coverage_totals": p1_coverage_totals, "p5_found": p5_found, "p5_company_names": p5_company_names}

_WINDOWS = """
WITH RECURSIVE raw AS (
  SELECT 'security_profile_history' AS table_name, cik AS entity, validity_window AS w FROM security_profile_history
  UNION ALL SELECT 'ticker_cik_mapping', upper(trim(ticker)), validity_window FROM ticker_cik_mapping
  UNION ALL SELECT 'wayback_cik_candidates', upper(trim(ticker)) || '/' || candidate_cik, validity_window FROM wayback_cik_candidates),
parts AS (
  SELECT table_name, entity, w, TRY_CAST(substr(w, 2, 10) AS DATE) AS a,
         TRY_CAST(regexp_extract(w, ',\\s*([0-9-]{10})', 1) AS DATE) AS b, regexp_matches(w, ',\\s*[\\])]$') AS open_end
  FROM raw WHERE w IS NOT NULL AND entity IS NOT NULL),
days AS (
  SELECT table_name, entity, CASE WHEN w LIKE '(%' THEN a + 1 ELSE a END AS lo,
         CASE WHEN open_end THEN DATE '9999-12-31' WHEN w LIKE '%]' THEN b + 1 ELSE b END AS hi FROM parts),
ok AS (SELECT DISTINCT table_name, entity, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi FROM days WHERE lo < hi),
marked AS (
  SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY table_name, entity ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM ok),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY table_name, entity ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT table_name, entity, min(lo) AS lo, max(hi) AS hi FROM islands GROUP BY table_name, entity, island),
chained AS (SELECT *, lead(lo) OVER (PARTITION BY table_name, entity ORDER BY lo) AS following FROM periods),
spans AS (
  SELECT table_name, entity, 'period' AS kind, lo, hi FROM chained
  UNION ALL SELECT table_name, entity, 'gap', hi, following FROM chained WHERE following IS NOT NULL)
"""
_AS_KNOWN = """
WITH firms AS (
  SELECT article_id, lpad(trim(c), 10, '0') AS cik, min(trading_day) AS trading_day
  FROM (SELECT article_id, trading_day, unnest(cik_list) AS c FROM parsed_news_articles WHERE trading_day IS NOT NULL)
  WHERE trim(c) <> '' GROUP BY 1, 2),
profiles AS (
  SELECT cik, evidence_id, company_name, ingested_at, CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) AS known,
         TRY_CAST(substr(validity_window, 2, 10) AS DATE) + CASE WHEN validity_window LIKE '(%' THEN 1 ELSE 0 END AS lo,
         CASE WHEN regexp_matches(validity_window, ',\\s*[\\])]$') THEN DATE '9999-12-31'
              ELSE TRY_CAST(regexp_extract(validity_window, ',\\s*([0-9-]{10})', 1) AS DATE) + CASE WHEN validity_window LIKE '%]' THEN 1 ELSE 0 END END AS hi
  FROM security_profile_history WHERE ingested_at IS NOT NULL),
ranked AS (
  SELECT f.article_id, f.cik, f.trading_day, p.evidence_id, p.company_name,
         row_number() OVER (PARTITION BY f.article_id, f.cik ORDER BY p.ingested_at DESC, p.evidence_id DESC) AS rn
  FROM firms f JOIN profiles p ON p.cik = f.cik AND p.known <= f.trading_day AND p.lo <= f.trading_day AND f.trading_day < p.hi
  WHERE EXISTS (SELECT 1 FROM snp_membership m WHERE m.cik = f.cik AND m.trading_day = f.trading_day
                AND CAST(m.ingested_at AT TIME ZONE 'UTC' AS DATE) <= m.trading_day))
"""
ORACLES = {
    "p1_found": _WINDOWS + """SELECT table_name, entity, kind, strftime(lo, '%Y-%m-%d') AS start_day,
  CASE WHEN hi = DATE '9999-12-31' THEN 'infinity' ELSE strftime(hi, '%Y-%m-%d') END AS end_day FROM spans""",
    "p1_coverage_totals": _WINDOWS + """SELECT table_name, entity, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps,
  CASE WHEN max(hi) < DATE '9999-12-31' THEN CAST(sum(hi - lo) FILTER (kind = 'period') AS BIGINT) END AS covered_days,
  CAST(coalesce(sum(hi - lo) FILTER (kind = 'gap'), 0) AS BIGINT) AS gap_days FROM spans GROUP BY table_name, entity""",
    "p5_found": _AS_KNOWN + "SELECT article_id, cik, evidence_id FROM ranked WHERE rn = 1",
    "p5_company_names": _AS_KNOWN + "SELECT article_id, cik, trading_day, company_name FROM ranked WHERE rn = 1",
}
