import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm.packing import TOKENIZER, best_two_fit, pack_documents, token_counts


@pytest.mark.parametrize("capacity,most", [(10, 10), (512, 512), (512, 60), (2048, 900)])
def test_best_two_fit(capacity, most):
    rng = random.Random(capacity + most)
    sizes = [rng.randrange(1, most + 1) for _ in range(3000)]
    bins = best_two_fit(sizes, capacity)
    assert Counter(s for b in bins for s in b) == Counter(sizes)
    assert all(sum(b) <= capacity for b in bins)
    assert len(bins) <= first_fit_decreasing(sizes, capacity) * 1.01


def first_fit_decreasing(sizes, capacity):
    room = []
    for size in sorted(sizes, reverse=True):
        for i, r in enumerate(room):
            if size <= r:
                room[i] -= size
                break
        else:
            room.append(capacity - size)
    return len(room)


def test_two_replace_the_smallest():
    assert best_two_fit([9, 5, 3, 3, 3], 15) == [[9, 3, 3], [5, 3]]
    assert best_two_fit([7, 2, 3, 6], 10) == [[7, 3], [6, 2]]
    assert best_two_fit([6, 3, 2, 2], 10) == [[6, 2, 2], [3]]
    assert best_two_fit([], 10) == []


pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


def test_documents(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["net", "sales", "übernimmt", "2024", "—"]) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "   "), (903, "x " * 30_000), (904, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(1)).withColumn("spec_id", F.lit("clash")).withColumn("total", F.lit(0))
    specs = spark.createDataFrame([(1, 64), (2, 500), (2, 500), (3, None), (None, 10), (4, 0)], "spec_id int, capacity_tokens int")
    counts = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert counts[900] == counts[901] == 0 and counts[902] > 0 and counts[903] >= 30_000
    packed = pack_documents(docs, specs, shard_items=200).collect()
    for spec, capacity in ((1, 64), (2, 500)):
        mine = [r for r in packed if r.spec_id == spec]
        pieces, fill = defaultdict(list), Counter()
        for r in mine:
            pieces[r.doc_id].append(r)
            if r.container_id is not None:
                fill[r.container_id] += r.n_tokens
        assert pieces.keys() == counts.keys() and max(fill.values()) <= capacity
        for doc, parts in pieces.items():
            parts.sort(key=lambda r: r.piece)
            assert sum(p.n_tokens for p in parts) == counts[doc] and len(parts) == max(1, math.ceil(counts[doc] / capacity))
            assert [p.token_start for p in parts] == [i * capacity for i in range(len(parts))]
            assert all((p.container_id is None) == (counts[doc] == 0) for p in parts)
        shards = len({c.split("-")[0] for c in fill})
        assert len(fill) <= math.ceil(sum(fill.values()) / capacity) * 1.02 + shards
    assert {r.spec_id for r in packed} == {1, 2}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    specs = spark.createDataFrame([(1, 64)], "spec_id int, capacity_tokens int")
    assert pack_documents(docs, specs).collect() == []
    assert pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), specs.limit(0)).collect() == []
