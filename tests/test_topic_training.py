"""Topics of every corpus version, and coherence of every language."""

from panelforge.plans import records


def test_topics_of_every_version(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(["oil", "gas", " Bank", "loan"])], "term_id int, token string").write.parquet(f"{tmp_path}/lda_vocabulary.parquet")
    postings = [(f"a{i}", 1, 2 * (i % 2) + j, 3) for i in range(20) for j in range(2)] + [(f"a{i}", 2, j, 3) for i in range(0, 20, 2) for j in range(2)] + [(None, 3, 1, 1), ("b", 3, 1, 0)]
    spark.createDataFrame(postings, "article_id string, corpus_version smallint, term_id int, term_count int").write.parquet(f"{tmp_path}/lda_document_terms.parquet")
    rows = records.m1_trained_topics(spark, str(tmp_path)).collect()
    assert {(r.corpus_version, r.topic_id) for r in rows} == {(v, t) for v in (1, 2) for t in range(200)}
    assert {r.term for r in rows if r.corpus_version == 1} == {"OIL", "GAS", "BANK", "LOAN"} and {r.term for r in rows if r.corpus_version == 2} == {"OIL", "GAS"}


def test_coherence_of_every_language(spark, tmp_path):
    labels = ["en", "PL", "pt-BR", "ru", " de ", None, "", "und", "xx"]
    spark.createDataFrame([(i, f"sales rose in market {i}", lang) for i, lang in enumerate(labels)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.run_id for r in records.m5_topic_coherence(spark, str(tmp_path)).collect()} == {"en", "pl", "pt", "ru", "de"}


def test_sampled_topics(spark):
    """One topic has the exact shares of the counting tokens; documents of one group of words each give topics of one group."""
    from panelforge.operators.topic_sampling import BETA, sampled_topics

    words = spark.createDataFrame([(1, "OIL"), (2, "GAS"), (3, "OIL"), (4, None), (5, "UNUSED"), (6, "BANK"), (6, "LOAN")], "term_id int, token string")
    postings = [("a", 1, 2), ("a", 1, 5), ("a", 3, 1), ("b", 2, 3), ("b", 4, 9), ("b", 77, 9), ("c", 6, 2)]
    one = {r.term: r.weight for r in sampled_topics(spark.createDataFrame(postings, "doc string, term_id int, term_count int"), words, "doc", 1, 10, 2).collect()}
    want = {t: (n + BETA) / (13 + 4 * BETA) for t, n in {"OIL": 6, "GAS": 3, "BANK": 2, "LOAN": 2}.items()}
    assert one.keys() == want.keys() and all(abs(one[t] - want[t]) < 1e-12 for t in want)

    words = spark.createDataFrame([(i, f"W{i}") for i in range(24)], "term_id int, token string")
    docs = spark.createDataFrame([(f"d{i}", i % 3 * 8 + (i + j) % 8, 2) for i in range(300) for j in range(6)], "doc string, term_id int, term_count int")
    found = sampled_topics(docs, words, "doc", 6, 24).collect()
    assert len(found) == 6 * 24
    shares = [[sum(r.weight for r in found if r.topic_id == t and int(r.term[1:]) // 8 == g) for g in range(3)] for t in range(6)]
    assert {s.index(max(s)) for s in shares if max(s) > 0.9} == {0, 1, 2}, shares
