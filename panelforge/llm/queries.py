"""Queries of the operators for training data and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.contamination import find_leaks, remove_leaks
from panelforge.llm.encoding import garbled_records
from panelforge.llm.frequency import term_frequencies
from panelforge.llm.packing import pack_documents
from panelforge.llm.reservoir import sample_distinct
from panelforge.llm.topn import latest_together, top_n


#: Articles in the sample of p2.
SAMPLE = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_article_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5,000 articles of those in the news, or all if there are fewer, with the crawl file in which each came first."""
    return sample_distinct(table(spark, sf_dir, "parsed_news_articles"), "article_id", "warc_path", SAMPLE)


def p2_sample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the sample, its distinct articles, those whose first crawl file is the right one, and the population."""
    sample = p2_article_sample(spark, sf_dir)
    first = table(spark, sf_dir, "parsed_news_articles").where("article_id is not null").groupBy("article_id").agg(F.min("warc_path").alias("first"))
    known = sample.join(first, "article_id", "left")
    return known.agg(F.count("*").alias("n_rows"), F.countDistinct("article_id").alias("n_articles"), F.count(F.when(F.col("warc_path").eqNullSafe(F.col("first")), 1)).alias("n_first"), F.max("population").alias("population"))


def p3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(
        table(spark, sf_dir, "lda_document_terms"), table(spark, sf_dir, "lda_vocabulary"),
        corpus="corpus_version", record="article_id", term="term_id", count="term_count", token=F.upper(F.trim(F.col("token"))),
    ).withColumn("is_active", F.col("mark").isNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_token_counts(spark, sf_dir).where(F.col("mark").isNotNull()).select("corpus_version", "token", "mark")


def _ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three lists as rows (list_name, run_id, group_key, item_key, score, tie_number, n), an article's rows of a run in one partition; ties go by number, then item."""
    exposure = latest_together(
        table(spark, sf_dir, "lda_article_topic_exposure").where("topic_exposure >= 0 and topic_exposure <= 1 and not isnan(topic_exposure)").dropna(subset=["run_id", "article_id", "topic_id"]),
        ["run_id", "article_id"], ["run_id", "article_id", "corpus_version", "topic_id"], "created_at", "topic_exposure")
    topic = F.col("topic_id").cast("string")
    lists = F.array(
        F.struct(F.lit("article").alias("list_name"), F.col("article_id").alias("group_key"), topic.alias("item_key"), F.col("topic_id").cast("long").alias("tie_number"), F.lit(3).alias("n")),
        F.struct(F.lit("topic").alias("list_name"), topic.alias("group_key"), F.col("article_id").alias("item_key"), F.lit(0).cast("long").alias("tie_number"), F.lit(10).alias("n")),
    )
    both = exposure.select("run_id", F.col("topic_exposure").alias("score"), F.explode(lists).alias("x")).select("run_id", "score", "x.*")
    forecast = F.col("forecast_annual_log_return")
    forecasts = (
        table(spark, sf_dir, "return_forecasts").where(forecast.isNotNull() & ~F.isnan(forecast) & (F.abs(forecast) < float("inf")))
        .dropna(subset=["run_id", "cik", "forecast_year", "session"])
        .groupBy("run_id", "cik", "forecast_year", "session").agg(F.max(F.struct("created_at", forecast.alias("score"))).alias("latest"))
        .select("run_id", F.col("latest.score").alias("score"), F.lit("forecast").alias("list_name"), F.concat_ws("/", F.col("forecast_year").cast("string"), "session").alias("group_key"),
                F.col("cik").alias("item_key"), F.lit(0).cast("long").alias("tie_number"), F.lit(10).alias("n"))
    )
    return both.unionByName(forecasts)


def p4_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n(_ranked_lists(spark, sf_dir), ["list_name", "run_id", "group_key"], "score", ["tie_number", "item_key"], F.col("n"), whole=F.col("list_name") == "article")
    return best.select("list_name", "run_id", "group_key", "item_key", "score", "rank")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_ranked(spark, sf_dir).select("list_name", "run_id", "group_key", "item_key")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused room for each container size."""
    packed = p6_packing(spark, sf_dir).where(F.col("container_id").isNotNull())
    totals = packed.groupBy("spec_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("spec_id", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return totals.withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("item_id", "doc_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_records(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id")


QUERIES = {"p2_article_sample": p2_article_sample, "p2_sample_totals": p2_sample_totals, "p3_found": p3_found, "p3_token_counts": p3_token_counts, "p4_found": p4_found, "p4_ranked": p4_ranked,
           "p6_packing": p6_packing, "p6_fill": p6_fill, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_clean": p7_clean, "p8_found": p8_found, "p8_restored": p8_restored}

_TERMS = """
WITH words AS (SELECT term_id, upper(trim(token)) AS token FROM lda_vocabulary WHERE token IS NOT NULL),
once AS (SELECT corpus_version, article_id, term_id, max(term_count) AS n FROM lda_document_terms
         WHERE article_id IS NOT NULL AND term_count >= 1 AND corpus_version IS NOT NULL GROUP BY ALL),
hits AS (SELECT o.corpus_version, o.article_id, w.token, o.n FROM once o JOIN words w USING (term_id)),
sizes AS (SELECT corpus_version, count(DISTINCT article_id) AS n_records FROM hits GROUP BY 1),
counts AS (
  SELECT corpus_version, token, CAST(sum(n) AS BIGINT) AS global_term_count, count(DISTINCT article_id) AS document_frequency, any_value(n_records) AS n_records,
         CASE WHEN count(DISTINCT article_id) < 5 THEN 'rare' WHEN count(DISTINCT article_id) * 100 > any_value(n_records) * 30 THEN 'common' END AS mark
  FROM hits JOIN sizes USING (corpus_version) GROUP BY corpus_version, token)
"""
_BEST = """
WITH exposure AS (
  SELECT run_id, article_id, topic_id, topic_exposure AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, article_id, corpus_version, topic_id ORDER BY created_at DESC NULLS LAST, topic_exposure DESC) AS rn
    FROM lda_article_topic_exposure WHERE topic_exposure BETWEEN 0 AND 1 AND NOT isnan(topic_exposure)) WHERE rn = 1),
forecast AS (
  SELECT run_id, cik, forecast_year || '/' || session AS slot, forecast_annual_log_return AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, cik, forecast_year, session ORDER BY created_at DESC NULLS LAST, forecast_annual_log_return DESC) AS rn
    FROM return_forecasts WHERE isfinite(forecast_annual_log_return)) WHERE rn = 1),
ranked AS (
  SELECT 'article' AS list_name, run_id, article_id AS group_key, CAST(topic_id AS VARCHAR) AS item_key, score,
         row_number() OVER (PARTITION BY run_id, article_id ORDER BY score DESC, topic_id) AS rank, 3 AS n FROM exposure
  UNION ALL SELECT 'topic', run_id, CAST(topic_id AS VARCHAR), article_id, score, row_number() OVER (PARTITION BY run_id, topic_id ORDER BY score DESC, article_id), 10 FROM exposure
  UNION ALL SELECT 'forecast', run_id, slot, cik, score, row_number() OVER (PARTITION BY run_id, slot ORDER BY score DESC, cik), 10 FROM forecast)
"""
_LEAKS = """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
item_runs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13)),
doc_runs AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
found AS (
  SELECT item_id, doc_id FROM item_runs JOIN doc_runs USING (run)
  UNION SELECT item_id, doc_id FROM docs JOIN items ON len(items.w) BETWEEN 1 AND 12
    AND contains(' ' || array_to_string(docs.w, ' ') || ' ', ' ' || array_to_string(items.w, ' ') || ' '))
"""
ORACLES = {
    "p2_sample_totals": f"WITH known AS (SELECT count(DISTINCT article_id) AS n FROM parsed_news_articles) SELECT least({SAMPLE}, n) AS n_rows, least({SAMPLE}, n) AS n_articles, least({SAMPLE}, n) AS n_first, n AS population FROM known",
    "p7_found": _LEAKS + "SELECT item_id, doc_id FROM found",
    "p3_found": _TERMS + "SELECT corpus_version, token, mark FROM counts WHERE mark IS NOT NULL",
    "p3_token_counts": _TERMS + "SELECT *, mark IS NULL AS is_active FROM counts",
    "p4_found": _BEST + "SELECT list_name, run_id, group_key, item_key FROM ranked WHERE rank <= n",
    "p4_ranked": _BEST + "SELECT list_name, run_id, group_key, item_key, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= n",
}
