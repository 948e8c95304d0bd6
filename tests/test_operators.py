import datetime as dt
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelforge.operators import calendar, checks, corpus, entity, intensity, relational, sampling, temporal, topics

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(5)
    left = [(rng.choice(["a", "b", None]), D(rng.randrange(400)), i) for i in range(300)]
    right = [(rng.choice(["a", "b"]), D(rng.randrange(400)), float(i)) for i in range(40)]
    out = temporal.as_of_join(spark.createDataFrame(left, "k string, day date, i int"), spark.createDataFrame(right, "k string, filed date, v double"), "k", "day", "filed", ["v"], 30)
    expected = []
    for k, day, i in left:
        able = [(f, v) for kk, f, v in right if kk == k and f <= day and (day - f).days <= 30]
        expected.append((i, *(max(able) if able else (None, None))))
    assert sorted((r.i, r.filed, r.v) for r in out.collect()) == sorted(expected)


def test_presence_and_changes(spark):
    presence = spark.createDataFrame([("A", D(0)), ("A", D(1)), ("B", D(1)), ("B", D(2)), ("B", D(2)), (None, D(3))], "k string, day date")
    snapshots = spark.createDataFrame([(D(i),) for i in range(4)], "day date")
    assert rows(temporal.presence_windows(presence, "k", "day", snapshots, "2020-01-09")) == [("A", D(0), D(2)), ("B", D(1), D(3))]
    assert rows(temporal.presence_windows(presence, "k", "day", snapshots.where(F.col("day") < D(3)), "2020-01-09")) == [("A", D(0), D(2)), ("B", D(1), D(9))]
    assert rows(relational.joiners_and_leavers(presence.where("k is not null"), "k", "day")) == [("A", D(2), "leave"), ("B", D(1), "join")]


def test_aliases_and_splits(spark):
    df = spark.createDataFrame([("AABA", D(5)), ("AABA", D(40)), ("X", D(5))], "t string, d date")
    aliases = spark.createDataFrame([("AABA", "YHOO", D(0), D(31))], "alias string, canonical string, start_date date, end_date date")
    assert rows(temporal.rewrite_aliases(df, "t", "d", aliases)) == [("AABA", D(40)), ("X", D(5)), ("YHOO", D(5))]
    ev = spark.createDataFrame([("T", "1", D(0), D(100), D(10)), ("T", "1", D(0), D(100), D(60)), ("T", "2", D(0), D(100), D(60)), ("U", "9", D(0), D(9), D(5))], "ticker string, candidate_cik string, start_day date, end_day date, filed_day date")
    splits = spark.createDataFrame([("T", D(50), "1", "2")], "ticker string, split_day date, pre_cik string, post_cik string")
    assert rows(temporal.split_windows(ev, splits)) == [("T", "1", D(0), D(50), D(10)), ("T", "2", D(50), D(100), D(60)), ("U", "9", D(0), D(9), D(5))]


def test_price_features_against_pandas(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"k": ["a"] * 300, "d": [D(i) for i in range(300)], "p": np.exp(rng.normal(0, 0.1, 300).cumsum())})
    got = temporal.price_features(spark.createDataFrame(p), "k", "d", "p").orderBy("d").toPandas()
    r = np.log(p.p / p.p.shift(1))
    assert np.allclose(got.log_return, r, equal_nan=True)
    assert np.allclose(got.vol_21, r.rolling(21).std().shift(1) * math.sqrt(252), equal_nan=True) and got.vol_21.first_valid_index() == 22
    assert np.allclose(got.vol_252, r.rolling(252).std().shift(1) * math.sqrt(252), equal_nan=True)
    assert np.allclose(got.mom_21, p.p.pct_change(21).shift(1), equal_nan=True)


def test_relational(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "w")], "k int, v string")
    assert len(relational.without(a, b, ["k"]).collect()) == 2
    assert rows(relational.upsert(a.dropna(), b, ["k"])) == [(1, "x"), (2, "new"), (3, "w")]
    assert rows(relational.insert_new(a.dropna(), b.union(b), ["k"])) == [(1, "x"), (2, "y"), (3, "w")]
    assert rows(relational.override(a.dropna(), b, ["k"], "v")) == [(1, "x"), (2, "new"), (3, "w")]
    words = spark.createDataFrame([("d", w) for w in "APPLE APPLE INC PEAR".split()] + [("d", ""), ("e", "APPLE")], "doc string, w string")
    names = spark.createDataFrame([("Apple Inc", "APPLE"), ("Apple Inc", "INC"), ("Pear", "PEAR"), ("Inc", "INC"), ("Empty", "")], "name string, w string")
    assert rows(relational.contained_sets(words, names, "doc", "name", "w", ("INC",))) == [("d", "Apple Inc")]


def test_calendar(spark):
    ts = lambda d, h: dt.datetime(2020, 1, 1, h, tzinfo=dt.UTC) + dt.timedelta(d)
    schedule = spark.createDataFrame([(D(1), ts(1, 14), ts(1, 21)), (D(2), ts(2, 14), ts(2, 18)), (D(5), ts(5, 14), ts(5, 21))], "trading_day date, session_open_utc timestamp, session_close_utc timestamp")
    flags = {r.trading_day: (r.is_trading_day, r.is_half_day, r.is_weekend, r.is_holiday) for r in calendar.civil_calendar(schedule).collect()}
    assert flags == {D(1): (True, False, False, False), D(2): (True, True, False, False), D(3): (False, False, True, False), D(4): (False, False, True, False), D(5): (True, False, False, False)}
    records = spark.createDataFrame([(1, ts(1, 10)), (2, ts(1, 14)), (3, ts(1, 21)), (4, ts(3, 12)), (5, ts(5, 22)), (6, ts(0, 1))], "i int, at timestamp")
    routed = {r.i: (r.trading_day, r.session) for r in calendar.route_sessions(records, "at", F.to_date("at"), schedule).collect()}
    assert routed == {1: (D(1), "overnight"), 2: (D(1), "intraday"), 3: (D(2), "overnight"), 4: (D(5), "overnight"), 5: (None, None), 6: (None, None)}
    fractions = calendar.overnight_fraction(schedule, dt.datetime(2020, 1, 1, 21))
    got = {r.trading_day: r.overnight_fraction for r in fractions.collect()}
    assert abs(got[D(1)] - 17 / 24) < 1e-9 and abs(got[D(5)] - 68 / 75) < 1e-9
    caps = calendar.session_caps(fractions, 10, 1).collect()
    assert all(r.intraday_cap + r.overnight_cap == 10 and r.intraday_cap >= 0 for r in caps)


def test_session_sample(spark):
    df = spark.createDataFrame([("d", f"a{i % 50}") for i in range(200)] + [("e", "x")], "g string, id string")
    got = sampling.sample_by_session(df, ["g"], "id", F.lit(7)).collect()
    assert sum(r.g == "d" for r in got) == 7 and len({r.id for r in got}) == 8
    assert sampling.sample_by_session(df, ["g"], "id", F.lit(0)).count() == 0


def test_corpus_counts(spark):
    tokens = spark.createDataFrame([("doc1", "keep"), ("doc1", "drop"), ("doc2", "keep"), ("doc3", "keep"), ("doc3", "keep"), ("doc3", None)], "doc string, token string")
    terms = corpus.document_terms(tokens, "doc")
    assert rows(corpus.vocabulary_counts(terms)) == [("drop", 1, 1), ("keep", 4, 3)]
    vocabulary, kept, documents = corpus.prune(terms, "doc", 2)
    assert rows(vocabulary) == [("keep", 4, 3)] and rows(documents) == [("doc1", 1, 1), ("doc2", 1, 1), ("doc3", 2, 1)]
    texts = corpus.rebuilt_texts(terms, "doc", F.col("token"))
    assert rows(texts) == [("doc1", "drop keep"), ("doc2", "keep"), ("doc3", "keep keep")]
    ids = [r.term_id for r in corpus.term_ids(corpus.vocabulary_counts(terms)).collect()]
    assert sorted(ids) == [1, 2]


def test_rules(spark):
    ev = [("AAA", "C1", "10-K", 1, "E1"), ("AAA", "C1", "8-K", 2, "E2"), ("BBB", "C2", "10-K", 3, "E3"), ("BBB", "C3", "8-K", 4, "E4"), ("CCC", "C4", "8-K", 5, "E5"), ("CCC", "C5", "8-K", 6, "E6")]
    df = spark.createDataFrame(ev, "ticker string, candidate_cik string, form_type string, filed_at int, evidence_id string")
    assert rows(entity.resolved(df, ["ticker"])) == [("AAA", "C1", "single_candidate", "E1"), ("BBB", "C2", "single_periodic", "E3")]
    df = spark.createDataFrame([("A", "10-Q", 9, "E1"), ("A", "10-K", 1, "E2"), ("A", "10-K", 5, "E3"), ("A", None, 9, "E4")], "t string, form_type string, filed_at int, evidence_id string")
    assert entity.canonical_evidence(df, ["t"]).first().evidence_id == "E3"


def brute_cv(docs, words, window):
    n = hits = 0
    single, joint = {w: 0 for w in words}, {(u, v): 0 for u in words for v in words}
    for doc in docs:
        for s in range(max(1, len(doc) - window + 1)):
            here = set(doc[s : s + window])
            n += 1
            for u in words:
                single[u] += u in here
                for v in words:
                    joint[u, v] += u in here and v in here
    npmi = lambda u, v: 1.0 if joint[u, v] == n else math.log((joint[u, v] / n + 1e-12) / (single[u] / n * single[v] / n)) / -math.log(joint[u, v] / n + 1e-12) if single[u] and single[v] else 0.0
    vectors = np.array([[npmi(u, v) for v in words] for u in words])
    total = vectors.sum(axis=0)
    return np.mean([v @ total / np.linalg.norm(v) / np.linalg.norm(total) for v in vectors])


def test_coherence_against_brute_force(spark):
    rng = random.Random(2)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.choice([2, 5, 12, 40]))] for _ in range(30)]
    tokens = spark.createDataFrame([(i, p, t) for i, d in enumerate(docs) for p, t in enumerate(d)], "doc int, pos int, token string")
    words = spark.createDataFrame([("r", 0, ["a", "b", "c"]), ("r", 1, ["d", "h"])], "run_id string, topic_id int, terms array<string>")
    got = {r.topic_id: r.coherence for r in topics.coherence_cv(tokens, words, "doc", window=6).collect()}
    assert abs(got[0] - brute_cv(docs, ["a", "b", "c"], 6)) < 1e-9 and abs(got[1] - brute_cv(docs, ["d", "h"], 6)) < 1e-9


def test_top_words(spark):
    df = spark.createDataFrame([(0, "b", 1.0), (0, "a", 1.0), (0, "c", 2.0), (0, "z", 0.1)], "topic int, term string, weight double")
    assert topics.top_words(df, ["topic"], n=3).first().terms == ["c", "a", "b"]


def test_duration_model(spark):
    rng = np.random.default_rng(1)
    x, psi = np.empty(3000), 1.0
    for t in range(3000):
        x[t] = psi * rng.exponential()
        psi = 0.2 + 0.2 * x[t] + 0.6 * psi
    omega, alpha, beta = intensity.fit_durations(x, True)
    assert abs(alpha - 0.2) < 0.06 and abs(beta - 0.6) < 0.12
    days = spark.createDataFrame([("a", D(i), float(v)) for i, v in enumerate([2, 1, 4])], "k string, d date, x double")
    folded = [r.psi for r in intensity.recursion_by_aggregate(days, ["k"], "d", "x", 1.0, 0.2, 0.5).orderBy("d").collect()]
    assert np.allclose(folded, intensity.expected_durations(np.array([2.0, 1, 4]), 1.0, 0.2, 0.5, 1 / 0.3))
    group = pd.DataFrame({"cik": "c", "session": "s", "trading_day": [D(0), D(1)], "duration_days": [None, 1]})
    assert list(intensity.firm_intensities(group).tier) == [3, 3]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 4, 9), ("a", 9, 12), ("b", 1, 2)], "k string, lo int, hi int")
    assert rows(checks.overlapping_windows(df, ["k"], "lo", "hi")) == [("a", 4, 9)]
    assert rows(checks.failing(df, {"small": F.col("hi") < 10, "null": F.lit(None).cast("boolean")})) == [("null", 0), ("small", 1)]
    assert checks.orphans(df, spark.createDataFrame([("a",)], "key string"), {"k": "key"}).count() == 1


def test_outside_window(spark):
    rows = [(1, 1, 3), (2, 1, 3), (3, 1, 3), (0, 1, 3), (None, 1, 3), (5, None, 3)]
    df = spark.createDataFrame(rows, "day int, lo int, hi int")
    from panelforge.operators.checks import outside_window

    assert sorted(r.day for r in outside_window(df, F.col("day"), F.col("lo"), F.col("hi")).collect()) == [0, 3]


def test_sets_that_share_words_are_compared_by_two(spark):
    """The sets of a holder are met by two elements, so none of the pairs that share only the rarest is compared; nothing but the counted dictionary is broadcast."""
    texts = [("d", "RADVEX RADVEX MONT MONT PLC INC"), ("d", "TARY"), ("e", "RADVEX RADVEX MONT TARY TARY"), (None, "MONT MONT TARY TARY INC")]
    words = spark.createDataFrame([(d, w) for d, t in texts for w in t.split()], "doc string, w string")
    named = ["Radvex", "RADVEX", "Radvex Inc", "Mont Radvex", "radvex mont plc", "Radvex Tary", "Mont Tary", "Radvex Mont Tary", "Tary Inc", "Plc"]
    names = spark.createDataFrame([(n, w) for n in named for w in n.upper().split()] + [(None, "RADVEX")], "name string, w string")
    want = sorted([("d", n) for n in ("Radvex", "RADVEX", "Radvex Inc", "Mont Radvex", "radvex mont plc")] + [("e", n) for n in ("Radvex", "RADVEX", "Radvex Tary")] + [(None, n) for n in ("Mont Tary", "Tary Inc")], key=str)
    for most in (50_000, 2):
        found = relational.contained_sets(words, names, "doc", "name", "w", ("INC", "PLC"), most)
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == (most > 2)
        assert sorted(map(tuple, found.collect()), key=str) == want
