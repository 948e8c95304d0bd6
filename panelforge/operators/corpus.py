"""From articles to a sparse document-term matrix, and counts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.text import is_clean_article


def clean_articles(articles: DataFrame, calendar_days: DataFrame | None = None) -> DataFrame:
    """Ids of the articles that pass the gate, on the given trading days if any are."""
    days = articles if calendar_days is None else articles.join(calendar_days.select("trading_day").distinct(), "trading_day", "left_semi")
    return days.where(is_clean_article(F.col("full_text"), F.col("language_confidence"))).select("article_id").distinct()


def document_terms(tokens: DataFrame, doc: str, token: str = "token") -> DataFrame:
    """(doc, token, term_count)."""
    return tokens.where(F.col(token).isNotNull()).groupBy(doc, token).agg(F.count("*").alias("term_count"))


def vocabulary_counts(terms: DataFrame, token: str = "token") -> DataFrame:
    """(token, global_term_count, document_frequency) of a document-term matrix."""
    return terms.groupBy(token).agg(F.sum("term_count").alias("global_term_count"), F.count("*").alias("document_frequency"))


def prune(terms: DataFrame, doc: str, min_documents: int = 25, token: str = "token") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, terms, documents) of the tokens in at least `min_documents` documents; documents have their total and unique term counts."""
    vocabulary = vocabulary_counts(terms, token).where(F.col("document_frequency") >= min_documents)
    kept = terms.join(vocabulary.select(token), token, "left_semi")
    documents = kept.groupBy(doc).agg(F.sum("term_count").alias("total_term_count"), F.count("*").alias("unique_term_count"))
    return vocabulary, kept, documents


def term_ids(vocabulary: DataFrame, token: str = "token", blocks: int = 64) -> DataFrame:
    """`vocabulary` with a dense `term_id` from 1 on, in the order of hash blocks and of tokens within one."""
    blocked = vocabulary.withColumn("_block", F.pmod(F.xxhash64(token), F.lit(blocks)).cast("int"))
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # `blocks` rows
    offsets = sizes.withColumn("_offset", before).select("_block", "_offset")
    return blocked.join(F.broadcast(offsets), "_block").withColumn("term_id", (F.col("_offset") + F.row_number().over(Window.partitionBy("_block").orderBy(token))).cast("long")).drop("_block", "_offset")


def frequency_of_frequencies(counts: DataFrame, column: str, cap: int = 1000) -> DataFrame:
    """How many tokens have each frequency up to `cap`."""
    return counts.where(F.col(column) <= cap).groupBy(F.col(column).alias("frequency")).agg(F.count("*").alias("n_tokens"))


def rebuilt_texts(terms: DataFrame, doc: str, order: Column, token: str = "token") -> DataFrame:
    """(doc, text): every token as often as it occurs, in the order of `order`, joined by spaces."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(token).alias("t"), F.col("term_count").cast("int").alias("n"))))
    return terms.groupBy(doc).agg(F.array_join(F.flatten(F.transform(rows, lambda s: F.array_repeat(s.t, s.n))), " ").alias("text"))


def export_lines(texts: DataFrame, doc: str, label: Column, text: str = "text") -> DataFrame:
    """One column `value`: id, label and text by tabs, as a topic trainer reads them."""
    return texts.select(F.concat_ws("\t", F.col(doc), label, F.col(text)).alias("value"))


def coverage_in_windows(days: DataFrame, windows: DataFrame, key: str, day: str, universe: DataFrame) -> DataFrame:
    """Share of the years, months and days of the universe within each key's windows (start_day, end_day) on which the key has rows; 0 where there are none."""
    spelled = windows.where("start_day < end_day").select(key, F.explode(F.sequence("start_day", F.date_sub("end_day", 1))).alias(day)).distinct()
    total = spelled.join(universe.select(day).distinct(), day)
    flagged = total.join(days.select(key, day).distinct().withColumn("_hit", F.lit(True)), [key, day], "left")
    out = [key]
    parts = {"year": F.trunc(day, "year"), "month": F.trunc(day, "month"), "day": F.col(day)}
    counts = flagged.groupBy(key).agg(*[F.countDistinct(p).alias(f"_all_{n}") for n, p in parts.items()], *[F.countDistinct(F.when(F.col("_hit"), p)).alias(f"_hit_{n}") for n, p in parts.items()])
    return counts.select(*out, *[F.coalesce(F.try_divide(F.col(f"_hit_{n}"), F.col(f"_all_{n}")), F.lit(0.0)).alias(f"{n}_coverage") for n in parts])
