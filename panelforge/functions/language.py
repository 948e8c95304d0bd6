"""Confidence that a text is in a language, by character trigrams learnt from labelled rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the hashed trigram table of a language, whatever the corpus.
BUCKETS = 1 << 15
#: Languages beyond this number are refused: each has a table in the model.
MOST_LANGUAGES = 100
COUNTS = "lang string, bucket int, n bigint"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def language_code(c: Column) -> Column:
    """Two lower-case letters of a label such as `EN`, `en-US`; null for others and for `und` and `xx`."""
    code = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when((code != "") & (code != "xx"), code)


def _trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of a text's lower-cased words, each with a blank on either side."""
    codes = np.frombuffer((" " + NOT_LETTERS.sub(" ", text.lower()) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    return ((codes[:-2] * 0x9E3779B1) ^ (codes[1:-1] * 0x85EBCA77) ^ (codes[2:] * 0xC2B2AE3D)) % BUCKETS


class LanguageModel:
    """Log probabilities of hashed trigrams by language, add-one smoothed."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        table = np.stack([counts[k] for k in self.languages]).astype(np.float64) if counts else np.zeros((0, BUCKETS))
        self.logs = np.log((table + 0.1) / (table.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)

    def confidence(self, text: str | None, language: str) -> float | None:
        """Probability of the language, all being equally likely before; a text's trigrams count for at most 30, as they depend on one another."""
        if text is None or language not in self.languages:
            return None
        seen = _trigrams(text)
        if not len(seen):
            return 1 / len(self.languages)
        total = self.logs[:, seen].sum(axis=1, dtype=np.float64) * min(1.0, 30 / len(seen))
        return float(1 / np.exp(total - total[self.languages.index(language)]).sum()) if math.isfinite(total.max()) else None


def train_languages(df: DataFrame, text: str, label: str) -> LanguageModel:
    """The model of all rows with a text and a usable label; only sums by language and bucket leave the executors."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for one, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(code, np.zeros(BUCKETS, dtype=np.int64))
                np.add.at(sums[code], _trigrams(one), 1)
        for code, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([code] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": counts[at]})

    read = df.select(F.col(text).alias("t"), language_code(F.col(label)).alias("l")).dropna()
    rows = read.mapInArrow(count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if rows["lang"].nunique() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = {}
    for code, part in rows.groupby("lang"):
        counts[code] = np.zeros(BUCKETS, dtype=np.int64)
        counts[code][part["bucket"]] = part["n"]
    return LanguageModel(counts)


def confidence(model: LanguageModel, df: DataFrame, text: Column, language: str = "en") -> Column:
    """Confidence that the text is in `language`; null for a null text or a language without rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.confidence(t, language) for t in texts], dtype="float64")

    return run(text)
