"""How often every distinct term occurs, in how many records, and which terms are too rare or too common."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from panelforge.operators.grouping import group_starts
from panelforge.storage import materialize

#: Identifier that stands for "any term": the records that hold it are all records.
ANY = 0
#: Hash blocks in which tokens are numbered: about one for so many rows of the vocabulary, and never more than the second number, which the plan holds.
BLOCK_TOKENS, MOST_BLOCKS = 100_000, 4096
#: Terms of a token that are told apart in one row of a record.
SLOTS = 4


def term_dictionary(vocabulary: DataFrame, term: str, token: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(term, token, token_id, slot): a dense integer, from 1 on, for every distinct `token`; the first `SLOTS` terms of a token have a `slot` from 0 on, others none.

    Rows with a null term or token are left out; of a repeated term the smallest token counts. Tokens are numbered within
    hash blocks of about `block_tokens` and the blocks laid end to end, so no task sorts the whole vocabulary and the driver
    gets one count for each block.
    """
    blocks = max(1, min(MOST_BLOCKS, math.ceil(vocabulary.count() / block_tokens)))
    terms = vocabulary.select(F.col(term).alias("term"), token.alias("token")).dropna().groupBy("term").agg(F.min("token").alias("token"))
    tokens = terms.select("token").distinct().withColumn("_block", F.pmod(F.xxhash64("token"), F.lit(blocks)).cast("int"))
    numbered = materialize(tokens.withColumn("_n", F.row_number().over(Window.partitionBy("_block").orderBy("token"))), "tokens")
    sizes = dict(numbered.groupBy("_block").count().collect())
    offsets = np.cumsum([0, *[sizes.get(b, 0) for b in range(blocks - 1)]]).tolist()
    ids = numbered.select("token", (F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_block") + 1) + F.col("_n")).alias("token_id"))
    order = Window.partitionBy("token").orderBy("term")  # few terms a token pass the limit, which is applied before the shuffle, too
    slots = terms.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SLOTS).select("term", (F.col("_n") - 1).alias("slot"))
    return materialize(terms.join(ids, "token").join(slots, "term", "left").select("term", "token", "token_id", "slot"), "dictionary")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _block_arrays(width: int, corpus_type: pa.DataType):
    """Counts of a partition sorted by (id_range, corpus, token_id) as arrays by corpus and identifier range.

    Of a range's `width` places the arrays have those that occur, with their place, so they are never wider than the rows they
    add up. A range that goes on in the next batch comes out twice, which its sum doesn't mind.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranges, ids, n, records = (np.asarray(batch.column(c)) for c in ("id_range", "token_id", "n", "record"))
            group = np.zeros(batch.num_rows, dtype=bool)
            group[group_starts(pa.Table.from_batches([batch]), ["id_range", "corpus"])] = True
            group = np.cumsum(group)
            places = _runs(group, ids)
            arrays = _runs(group[places])
            offsets = pa.array(np.append(arrays, len(places)).astype(np.int32))
            first = pa.array(places[arrays])
            lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("corpus").take(first).cast(corpus_type), batch.column("id_range").take(first), lists((ids - ranges * width)[places].astype(np.int32)),
                 lists(np.add.reduceat(n, places)), lists(np.add.reduceat(records, places))], names=["corpus", "id_range", "place", "occurrences", "records"])

    return run


def _summed(width: int, corpus_type: pa.DataType):
    """The arrays of all partitions added by (corpus, identifier range), as one row for each identifier that occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros((2, width), dtype=np.int64)

        def rows() -> pa.RecordBatch:
            at = np.flatnonzero(total[1])
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), corpus_type), pa.array(at + key[1] * width), pa.array(total[0][at]), pa.array(total[1][at])], names=["corpus", "token_id", "occurrences", "records"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts(pa.Table.from_batches([batch]), ["corpus", "id_range"])
            ends = np.asarray(batch.column("place").value_lengths()).cumsum()
            places, occurrences, records = (np.asarray(batch.column(c).flatten()) for c in ("place", "occurrences", "records"))
            at = 0
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = (batch.column("corpus")[int(a)].as_py(), batch.column("id_range")[int(a)].as_py())
                if key is not None and here != key:
                    yield rows()
                    total[:] = 0
                key, end = here, int(ends[b - 1])
                np.add.at(total[0], places[at:end], occurrences[at:end])
                np.add.at(total[1], places[at:end], records[at:end])
                at = end
        if key is not None:
            yield rows()

    return run


def term_frequencies(postings: DataFrame, vocabulary: DataFrame, *, corpus: str, record: str, term: str, count: str, token: Column,
                     rare_below: int = 5, common_percent: int = 30, width: int = 256, broadcast_terms: int = 500_000, broadcast_corpora: int = 100_000) -> DataFrame:
    """(corpus, token, global_term_count, document_frequency, n_records, mark) of every token that occurs, by corpus.

    A posting counts if none of its columns is null, its count is at least 1 and its term is in `vocabulary`, where `token`
    is the form under which terms are one. Repeats of (corpus, record, term) are one posting, of unlike counts the greatest.
    `mark` is `rare` below `rare_below` records, else `common` above `common_percent` percent of the corpus's records with a
    counting posting, else null. Extra columns are ignored, so their names may clash; empty tables give an empty result.
    `corpus` may have any type that can be ordered.

    The terms get a dense identifier, and postings are encoded where they lie. One shuffle, with a combine before it, then
    leaves one row for each (corpus, record, token), which keeps the counts of the token's first `SLOTS` terms apart; a further
    term has a row of its own. It also carries one row for each (corpus, record), under an identifier that every record holds,
    which gives the corpus's size. So neither a hot term nor a hot record gathers in one task. Each partition, sorted by range
    of `width` identifiers, adds its rows up in arrays (occurrences, and records that hold the term), and the arrays, not the
    postings, are shuffled and summed by range. The dictionary's three fields a term are broadcast if it has at most
    `broadcast_terms` (some 20 MB), and the corpora's sizes if they are at most `broadcast_corpora`, else they are joined by a
    shuffle.
    """
    dictionary = term_dictionary(vocabulary, term, token)
    codes = dictionary.select("term", "token_id", "slot")
    codes = F.broadcast(codes) if dictionary.count() <= broadcast_terms else codes
    coded = (
        postings.select(F.col(corpus).alias("corpus"), F.col(record).alias("record"), F.col(term).alias("term"), F.col(count).cast("long").alias("n"))
        .where("corpus is not null and record is not null and term is not null and n >= 1").join(codes, "term")
    )
    no_term = F.lit(None).cast(postings.schema[term].dataType)
    row = lambda token_id, one, slot, n: F.struct(token_id.cast("long").alias("token_id"), one.alias("term"), slot.cast("int").alias("slot"), n.cast("long").alias("n"))
    token_id, slot, nothing = F.col("token_id"), F.col("slot"), F.lit(0)
    whole = row(F.lit(ANY), no_term, nothing, nothing)
    rows = F.when(slot.isNotNull(), F.array(row(token_id, no_term, slot, F.col("n")), whole)).otherwise(F.array(row(token_id, F.col("term"), nothing, F.col("n")), row(token_id, no_term, nothing, nothing), whole))
    once = (
        coded.select("corpus", F.col("record").alias("holder"), F.explode(rows).alias("_x"))
        .groupBy("corpus", "holder", F.col("_x.token_id").alias("token_id"), F.col("_x.term").alias("term"))
        .agg(*[F.coalesce(F.max(F.when(F.col("_x.slot") == i, F.col("_x.n"))), F.lit(0)).alias(f"_{i}") for i in range(SLOTS)])
        .select("corpus", "token_id", sum((F.col(f"_{i}") for i in range(1, SLOTS)), F.col("_0")).alias("n"), F.col("term").isNull().cast("long").alias("record"))
    )
    kind = postings.schema[corpus].dataType
    long = T.ArrayType(T.LongType())
    arrays = T.StructType([T.StructField("corpus", kind), T.StructField("id_range", T.LongType()), T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("occurrences", long), T.StructField("records", long)])
    counted = T.StructType([T.StructField("corpus", kind), *[T.StructField(c, T.LongType()) for c in ("token_id", "occurrences", "records")]])
    blocks = (
        once.select(F.expr(f"token_id div {int(width)}").alias("id_range"), "corpus", "token_id", "n", "record")
        .sortWithinPartitions("id_range", "corpus", "token_id").mapInArrow(_block_arrays(width, to_arrow_type(kind)), arrays)
    )
    counts = materialize(blocks.repartition("corpus", "id_range").sortWithinPartitions("corpus", "id_range").mapInArrow(_summed(width, to_arrow_type(kind)), counted), "counts")
    sizes = counts.where(F.col("token_id") == ANY).select("corpus", F.col("records").alias("n_records"))
    sizes = F.broadcast(sizes) if sizes.count() <= broadcast_corpora else sizes
    few, many = F.col("records") < rare_below, F.col("records") * 100 > F.col("n_records") * common_percent
    return (
        counts.where(F.col("token_id") != ANY).join(sizes, "corpus")
        .join(dictionary.select("token", "token_id").distinct(), "token_id")
        .select(F.col("corpus").alias(corpus), "token", F.col("occurrences").alias("global_term_count"), F.col("records").alias("document_frequency"),
                "n_records", F.when(few, "rare").when(many, "common").alias("mark"))
    )
