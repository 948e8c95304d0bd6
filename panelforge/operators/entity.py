"""Resolution of one key to one of several candidates by its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rank of the kinds of evidence that a period's report gives; the lowest is best, others are last.
PERIODIC_RANK = {"10-K": 0, "20-F": 0, "10-KT": 1, "10-QT": 1, "10-K/A": 1, "20-F/A": 1, "10-Q": 2, "10-Q/A": 3}


def form_rank(form: str = "form_type"):
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, rank in PERIODIC_RANK.items():
        out = out.when(F.col(form) == name, rank)
    return out


def candidate_features(evidence: DataFrame, keys: list[str], candidate: str = "candidate_cik", form: str = "form_type") -> DataFrame:
    """(keys, candidate, has_periodic, n_candidates, n_periodic): one row for each candidate of a key."""
    each = evidence.groupBy(*keys, candidate).agg(F.coalesce(F.bool_or(F.col(form).isin(list(PERIODIC_RANK))), F.lit(False)).alias("has_periodic"))
    of_key = Window.partitionBy(*keys)
    return each.withColumn("n_candidates", F.count("*").over(of_key)).withColumn("n_periodic", F.sum(F.col("has_periodic").cast("int")).over(of_key))


def accepted_candidates(evidence: DataFrame, keys: list[str], candidate: str = "candidate_cik", form: str = "form_type") -> DataFrame:
    """(keys, candidate, source): the single candidate of a key if it has a periodic report, or the only one of several that has."""
    features = candidate_features(evidence, keys, candidate, form).where("has_periodic and n_periodic = 1")
    return features.select(*keys, candidate, F.when(F.col("n_candidates") == 1, "single_candidate").otherwise("single_periodic").alias("source"))


def canonical_evidence(evidence: DataFrame, keys: list[str], form: str = "form_type", filed: str = "filed_at", evidence_id: str = "evidence_id") -> DataFrame:
    """The best row of each key: best form, then latest filing, then greatest id."""
    order = Window.partitionBy(*keys).orderBy(form_rank(form).asc_nulls_last(), F.col(filed).desc_nulls_last(), F.col(evidence_id).desc_nulls_last())
    return evidence.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def resolved(evidence: DataFrame, keys: list[str], candidate: str = "candidate_cik") -> DataFrame:
    """(keys, candidate, source, canonical_evidence_id) of every key that the rules settle."""
    best = canonical_evidence(evidence, [*keys, candidate]).select(*keys, candidate, F.col("evidence_id").alias("canonical_evidence_id"))
    return accepted_candidates(evidence, keys, candidate).join(best, [*keys, candidate])


def name_spans(evidence: DataFrame, keys: list[str], name: str, ts: str) -> DataFrame:
    """First and last time and number of rows of each name of a key, and how many names the key has."""
    spans = evidence.groupBy(*keys, name).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("n_evidence"))
    return spans.withColumn("n_names", F.count(name).over(Window.partitionBy(*keys)))
