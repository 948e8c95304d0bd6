import random

from pyspark.sql import functions as F

from panelforge.llm.contamination import ItemAutomaton, cut_spans, find_leaks, remove_leaks, words_of


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def brute(docs, items, least):
    out = {}
    for d, t in docs:
        for i, s in items:
            a, b = words_of(t), words_of(s)
            n = longest(a, b)
            if b and n >= min(least, len(b)):
                key = (i, d)
                out[key] = max(out.get(key, 0), n)
    return out


def test_words():
    assert words_of("It’s 3.5% of ÉTÉ_x") == ["it", "s", "3", "5", "of", "t", "x"]
    assert words_of(None) == words_of("") == words_of(" —") == []


def test_automaton_against_brute_force():
    rng = random.Random(7)
    for size in (2, 3, 6):
        for least in (1, 3, 5):
            items = [(i, [rng.choice("abcdef"[:size]) for _ in range(rng.randrange(1, 14))]) for i in range(12)]
            items.append((12, items[0][1]))
            automaton = ItemAutomaton(items, least)
            for _ in range(20):
                doc = [rng.choice("abcdefxy") for _ in range(40)]
                found, spans = automaton.scan(doc)
                expected = {}
                for i, words in items:
                    n = longest(doc, words)
                    if n >= min(least, len(words)):
                        expected[i] = n
                assert {automaton.ids[i]: n for i, n in found.items()} == expected
                assert all(0 <= a < b <= len(doc) for a, b in spans) and bool(spans) == bool(expected)


def data():
    rng = random.Random(3)
    word = lambda: rng.choice(["rate", "loan", "sum", "net", "x1", "of"])
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 20, 30])))) for i in range(20)] + [(90, None), (91, ""), (92, " — ")]
    docs = []
    for d in range(60):
        text = [rng.choice(["alpha", "beta", "gamma", word()]) for _ in range(30)]
        if d % 2:
            quote = words_of(items[rng.randrange(20)][1])
            text[10:10] = [w.upper() + rng.choice([",", "\n", " *"]) for w in quote[: rng.choice([12, 13, 99])]]
        docs.append((d, " ".join(text)))
    return docs + [(200, None), (201, ""), (202, "pad " * 50_000 + items[2][1])], items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("d", F.lit("clash"))
    return d.repartition(3), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5)).withColumn("i", F.lit(0))


def test_find_leaks_against_brute_force(spark):
    docs, items = data()
    expected = brute([(d, t if d != 202 else t[-2000:]) for d, t in docs], items, 13)
    d, i = frames(spark, docs, items + items[:3])
    for block in (40, 300_000):
        got = {(r.item_id, r.doc_id): r.longest_words for r in find_leaks(d, i, block_words=block).collect()}
        assert got == expected
    assert len(expected) > 20


def test_empty_tables(spark):
    d, i = frames(spark, *data())
    assert find_leaks(d.limit(0), i).collect() == [] and find_leaks(d, i.limit(0)).collect() == []
    assert remove_leaks(d.limit(0), i).collect() == [] and remove_leaks(d, i.limit(0)).collect() == []


def test_ids_of_other_types(spark):
    d = spark.createDataFrame([("d1", "alpha beta")], "doc_id string, text string")
    i = spark.createDataFrame([(7, "Alpha, beta")], "item_id int, text string")
    assert [tuple(r) for r in find_leaks(d, i).collect()] == [(7, "d1", 2, 2)]
    assert [r.doc_id for r in remove_leaks(d, i).collect()] == ["d1"]


def test_cut_spans():
    assert cut_spans("One two, THREE four. Five", [(1, 3), (2, 4)]) == ("One . Five", 3)
    assert cut_spans("İİ a bb ccc", [(1, 3)])[0].endswith(" ccc") or cut_spans("İİ a bb ccc", [(1, 3)])[1] == 2


def test_removed_text_is_clean(spark):
    docs, items = data()
    d, i = frames(spark, docs, items)
    leaked = {r.doc_id for r in find_leaks(d, i).collect()}
    cut = remove_leaks(d, i).collect()
    assert {r.doc_id for r in cut} == leaked
    texts = dict(docs)
    for r in cut:
        assert len(words_of(r.clean_text)) == r.n_words - r.leaked_words == len(words_of(texts[r.doc_id])) - r.leaked_words
        assert r.drop == (r.leaked_words > 0.5 * r.n_words)


def test_a_shared_preamble_is_looked_up_once_a_text():
    """4,000 items share 60 words: a text that repeats the preamble ten times looks each state's items up no more often than a text with one."""
    class Counted(list):
        reads = 0

        def __iter__(self):
            Counted.reads += len(self)
            return super().__iter__()

    preamble = [f"p{i}" for i in range(60)]
    known = ItemAutomaton([(i, preamble + [f"own{i}"]) for i in range(4000)], 13)
    known.holders = [Counted(h) for h in known.holders]
    known.scan(preamble)
    once, Counted.reads = Counted.reads, 0
    found, _ = known.scan((preamble + ["between"]) * 10)
    assert Counted.reads <= once and len(found) == 4000 and set(found.values()) == {60}
