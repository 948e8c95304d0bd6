import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelforge.llm.frequency import _block_arrays, _summed, term_dictionary, term_frequencies

POSTINGS, VOCABULARY = "version smallint, doc string, term int, n int, token string, corpus int", "term int, token string, record string"
OPTIONS = dict(corpus="version", record="doc", term="term", count="n")


def brute(postings, vocabulary, rare, percent):
    names = {}
    for term, token, _ in vocabulary:
        if term is not None and token is not None:
            names[term] = min(names.get(term, "￿"), token.strip().upper())
    once = {}
    for version, doc, term, n, *_ in postings:
        if None not in (version, doc, term, n) and n >= 1 and term in names:
            once[version, doc, term] = max(n, once.get((version, doc, term), 0))
    total, docs, sizes = defaultdict(int), defaultdict(set), defaultdict(set)
    for (version, doc, term), n in once.items():
        total[version, names[term]] += n
        docs[version, names[term]].add(doc)
        sizes[version].add(doc)
    mark = lambda k, df: "rare" if df < rare else "common" if df * 100 > len(sizes[k[0]]) * percent else None
    return {(*k, t, len(docs[k]), len(sizes[k[0]]), mark(k, len(docs[k]))) for k, t in total.items()}


def run(spark, postings, vocabulary, **options):
    df = term_frequencies(spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(vocabulary, VOCABULARY), **OPTIONS, token=F.upper(F.trim(F.col("token"))), **options)
    assert df.columns == ["version", "token", "global_term_count", "document_frequency", "n_records", "mark"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [(t, rng.choice(["", " "]) + rng.choice("abcdefgh") * rng.randrange(1, 9), "r") for t in range(60)] + [(None, "x", "r"), (99, None, "r")]
    vocabulary += vocabulary[:10]
    postings = [(rng.choice([1, 2, None]), rng.choice(["hot"] * 9 + [f"d{i}" for i in range(30)] + [None]), rng.choice([7] * 20 + list(range(70)) + [None]), rng.choice([None, -1, 0, 1, 2, 50]), "clash", 3) for _ in range(3000)]
    vocabulary += [(t, "many", "r") for t in range(60, 70)]
    postings += postings[:200]
    for width, broadcast in ((4, 0), (256, 1000)):
        assert run(spark, postings, vocabulary, width=width, broadcast_terms=broadcast, broadcast_corpora=broadcast) == brute(postings, vocabulary, 5, 30)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a", "r")]) == set()
    assert run(spark, [(1, "d", 1, 1, "t", 1)], []) == set()
    assert run(spark, [(1, "d", 1, 1, "t", 1)], [(1, "x" * 100_000, "r")]) == {(1, "X" * 100_000, 1, 1, 1, "rare")}


def test_dictionary_is_dense(spark):
    rows = [(i, f"t{i % 300}") for i in range(500)]
    ids = term_dictionary(spark.createDataFrame(rows, "term int, token string"), "term", F.col("token"), block_tokens=100).collect()
    assert sorted({r.token_id for r in ids}) == list(range(1, 301)) and len(ids) == 500
    assert len({(r.token, r.token_id) for r in ids}) == 300


def test_corpora_of_any_type(spark):
    rows = [("news", "a", 1, 2), ("news", "b", 1, 1), ("9" * 9, "a", 2, 70_000), ("news", "a", 2, 1), (None, "a", 1, 1)]
    df = term_frequencies(spark.createDataFrame(rows, "version string, doc string, term int, n int"), spark.createDataFrame([(1, "x"), (2, "X "), (3, "y")], "term int, token string"), **OPTIONS, token=F.upper(F.trim(F.col("token"))))
    assert {tuple(r) for r in df.collect()} == {("news", "X", 4, 2, 2, "rare"), ("9" * 9, "X", 70_000, 1, 1, "rare")}


def test_arrays_of_thin_ranges_stay_as_small_as_their_rows():
    rng = np.random.default_rng(0)
    ids = np.sort(rng.integers(1, 10_000_000, 50_000))
    batch = pa.record_batch({"id_range": ids // 256, "corpus": np.ones(len(ids), dtype=np.int16), "token_id": ids, "n": np.full(len(ids), 3), "record": np.ones(len(ids), dtype=np.int64)})
    arrays = list(_block_arrays(256, pa.int16())([batch.slice(0, 20_001), batch.slice(20_001)]))
    assert sum(a.nbytes for a in arrays) <= 2 * batch.nbytes
    summed = pa.Table.from_batches(_summed(256, pa.int16())(arrays))
    known, times = np.unique(ids, return_counts=True)
    order = np.argsort(summed["token_id"].to_numpy())
    got = {k: summed[k].to_numpy()[order] for k in ("token_id", "occurrences", "records")}
    place = np.searchsorted(got["token_id"], known)
    assert len(np.unique(got["token_id"])) == len(known) and got["occurrences"].sum() == 3 * len(ids) and (np.bincount(np.searchsorted(known, got["token_id"]), weights=got["records"]) == times).all() and (got["token_id"][place] == known).all()
