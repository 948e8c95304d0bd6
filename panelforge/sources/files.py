"""Readers of text, CSV, TSV and Parquet sources with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = "topic_id int, term string, weight double"
SAMPLE_COUNTERS = ("records", "html_200_count", "text_count", "long_enough_count", "short_enough_count", "english_count", "matched_any_firm", "kept_count", "error_count")


def lines(spark: SparkSession, paths: str | list[str], prefix: str = "") -> DataFrame:
    """(value, path): the lines of text files, each behind `prefix`; blank lines go."""
    read = spark.read.option("recursiveFileLookup", "true").text(paths)
    return read.where(F.trim("value") != "").select(F.concat(F.lit(prefix), F.trim("value")).alias("value"), F.col("_metadata.file_path").alias("path"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, in their order; for sources in which a missing one means no records."""
    out = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            out.append(path)
    return out


def session_lines(spark: SparkSession, root: str, keys: list[tuple[int, int, int, str]]) -> DataFrame:
    """(value, path) of `root/YYYY/MM/DD/session/samples.txt` of each key that has one."""
    paths = existing(spark, [f"{root}/{y:04d}/{m:02d}/{d:02d}/{s}/samples.txt" for y, m, d, s in keys])
    return lines(spark, paths) if paths else spark.createDataFrame([], "value string, path string")


def month_of_path(path: Column, name: str = "warc_queue.txt") -> tuple[Column, Column]:
    """Year and month of `.../YYYY/MM/<name>`, null elsewhere."""
    pattern = rf"/(\d{{4}})/(\d{{2}})/{name.replace('.', '[.]')}$"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit("")).cast("int")
    return part(1), part(2)


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("comment", "#").csv(path)


def snapshots(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """(date, tickers) of a CSV of index snapshots from `first` to `last`, both included."""
    read = spark.read.schema("date string, tickers string").option("header", "true").csv(path)
    return read.select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), "tickers").where(F.col("date").between(first, last)).orderBy("date")


def listed_tickers(df: DataFrame, day: str = "date", column: str = "tickers") -> DataFrame:
    """(day, ticker): one row for each ticker of a comma-separated list; empty ones go."""
    parts = df.select(day, F.explode(F.split(column, ",")).alias("ticker")).select(day, F.nullif(F.trim("ticker"), F.lit("")).alias("ticker"))
    return parts.where(F.col("ticker").isNotNull())


def document_topics(spark: SparkSession, path: str) -> DataFrame:
    """(doc_index, instance_id, topic_id, topic_proportion) of a trainer's text: index, id and one proportion a topic, by white space. A bad number fails the job; `#` lines and blank ones are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#")).select(F.split("v", r"\s+").alias("f"))
    checked = rows.select(F.when(F.size("f") >= 3, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.array_join("f", " ")))).alias("f"))
    return checked.select(F.element_at("f", 1).cast("int").alias("doc_index"), F.element_at("f", 2).alias("instance_id"), F.posexplode(F.slice("f", F.lit(3), F.size("f"))).alias("topic_id", "p")).select(
        "doc_index", "instance_id", "topic_id", F.col("p").cast("double").alias("topic_proportion"))


def topic_word_weights(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, term, weight) of a TSV with exactly these fields; any other line fails the job."""
    return spark.read.schema(WEIGHTS).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def runs_by_name(spark: SparkSession, glob: str, pattern: str = r"seed(\d+)") -> DataFrame:
    """Parquet files with the run that their name gives as `run_id`."""
    return spark.read.parquet(glob).withColumn("run_id", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))


def articles_in_partitions(spark: SparkSession, root: str, least_words: int = 25) -> DataFrame:
    """Articles under year/month/day/session folders with enough words; both filters reach the scan."""
    return spark.read.parquet(root).where(F.col("word_count") >= least_words)


def sample_totals(stats: DataFrame, keys: list[str], counters: tuple[str, ...] = SAMPLE_COUNTERS) -> DataFrame:
    return stats.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counters])


def by_ids(df: DataFrame, ids: DataFrame, id_column: str = "article_id", text: str = "full_text") -> DataFrame:
    """The rows of the ids, one for each text; of equal texts that of the smallest id."""
    kept = df.join(ids.select(id_column).distinct(), id_column, "left_semi")
    first = kept.groupBy(F.sha2(text, 256).alias("_h")).agg(F.min(id_column).alias(id_column)).select(id_column)
    return kept.join(first, id_column, "left_semi").dropDuplicates([id_column])
