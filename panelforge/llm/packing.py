"""Texts of varying length in containers of fixed capacity, with as little room left as possible."""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.storage import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts were cut before merging (contractions, words, numbers, other characters, white space).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: More container sizes than this are refused: they are held in the plan.
MOST_SPECS = 1000


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document; 0 for a null or empty text. `tokenizer` is a vocabulary file that the driver reads (under 1 MB) and sends to the executors."""
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    out = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks.value).encode_ordinary
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())})

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, out)


class _Stock:
    """Unpacked items by size: how many there are of each, and the sizes in order."""

    def __init__(self, sizes: Iterable[int]) -> None:
        self.count = Counter(sizes)
        self.order = sorted(self.count)

    def take(self, size: int) -> int:
        self.count[size] -= 1
        if not self.count[size]:
            del self.order[bisect_left(self.order, size)]
        return size

    def put(self, size: int) -> None:
        self.count[size] += 1
        if self.count[size] == 1:
            insort(self.order, size)

    def largest(self, room: int) -> int:
        """The largest size that fits, or 0."""
        at = bisect_right(self.order, room)
        return self.order[at - 1] if at else 0

    def pair(self, room: int, above: int) -> tuple[int, int] | None:
        """The two items with the largest sum that is at most `room` and more than `above`."""
        order, best, found = self.order, above, None
        low, high = 0, bisect_right(order, room) - 1
        while low <= high and best < room:
            total = order[low] + order[high]
            if total > room or (low == high and self.count[order[low]] < 2):
                high -= 1
            else:
                if total > best:
                    best, found = total, (order[high], order[low])
                low += 1
        return found


def best_two_fit(sizes: Iterable[int], capacity: int) -> list[list[int]]:
    """Bins of at most `capacity` for positive sizes of at most `capacity`, all of them and each once.

    A bin takes the largest item that fits until none does; then its smallest item gives way to two unpacked ones as long as
    these fill the room it leaves, and the gap, more tightly than it did.
    """
    stock, bins = _Stock(sizes), []
    while stock.order:
        items, gap = [], capacity
        while size := stock.largest(gap):
            items.append(stock.take(size))
            gap -= size
        while gap and stock.order and (two := stock.pair(gap + min(items), min(items))):
            smallest = min(items)
            items.remove(smallest)
            items += [stock.take(two[0]), stock.take(two[1])]
            stock.put(smallest)
            gap += smallest - sum(two)
        bins.append(items)
    return bins


def _pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Bins of one shard: the sizes are packed, then the rows of each size are given out in order of document and piece."""
    rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ignore_index=True)
    at = {int(s): int(i) for s, i in zip(*np.unique(rows["n_tokens"].to_numpy(), return_index=True), strict=True)}
    container = [0] * len(rows)
    for number, items in enumerate(best_two_fit(rows["n_tokens"].tolist(), int(rows["capacity"].iloc[0]))):
        for size in items:
            container[at[size]] = number
            at[size] += 1
    return rows.assign(container_id=[f"{key[1]}-{c}" for c in container])[["spec_id", "capacity", "container_id", "doc_id", "piece", "token_start", "n_tokens"]]


def pack_documents(documents: DataFrame, specs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spec_id: str = "spec_id",
                   capacity: str = "capacity_tokens", tokenizer: str = TOKENIZER, shard_items: int = 16_384) -> DataFrame:
    """(spec_id, capacity, container_id, doc_id, piece, token_start, n_tokens): where each document goes, for every container size.

    A document longer than the capacity is cut into full containers and a rest; any other is whole. Every token of every
    document is in one container of each size. A null or empty text has no token and comes out once a size without a
    container. Specs with a null id or a capacity that is null or below 1 are left out, repeated ones count once. A document
    that stands twice under one id is packed twice. Empty tables give an empty result; other columns have no effect.

    Sizes come from one pass over the texts and are kept as a narrow table. Items are then dealt by hash into shards of about
    `shard_items`, as many as the counted items ask for, so no task grows with the data; each shard is packed alone and
    leaves about one container partly empty, which is below 0.1 percent of its containers.
    """
    sizes = materialize(token_counts(documents, doc_id, text, tokenizer), "token-counts")
    chosen = specs.select(F.col(spec_id).cast("int"), F.col(capacity).cast("long")).where(F.col(capacity) >= 1).dropna().distinct().orderBy(spec_id, capacity).limit(MOST_SPECS + 1).collect()
    if len(chosen) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container sizes")
    items = [F.sum(F.ceil(F.col("n_tokens") / F.lit(c))) for _, c in chosen]
    totals = sizes.agg(F.count("*"), *items).first()[1:]
    spec = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity"), F.lit(max(1, math.ceil((n or 0) / shard_items))).alias("shards"))
                               for (s, c), n in zip(chosen, totals, strict=True)]).cast("array<struct<spec_id:int,capacity:bigint,shards:int>>"))
    pieces = sizes.select("doc_id", F.col("n_tokens").alias("total"), spec.alias("s")).select("doc_id", "total", "s.*")
    none = pieces.where("total = 0").select("spec_id", "capacity", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece"),
                                            F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"))
    items = (
        pieces.where("total > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / F.col("capacity")) - 1).cast("int"))))
        .withColumn("token_start", F.col("piece") * F.col("capacity"))
        .withColumn("n_tokens", F.least("capacity", F.col("total") - F.col("token_start")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "spec_id"), F.col("shards")).cast("int"))
    )
    schema = T.StructType([T.StructField("spec_id", T.IntegerType()), T.StructField("capacity", T.LongType()), T.StructField("container_id", T.StringType()),
                           T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return items.groupBy("spec_id", "capacity", "shard").applyInPandas(lambda key, rows: _pack_shard((key[0], key[2]), rows), schema).union(none)
