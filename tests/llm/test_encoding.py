import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import encoding as E

SENTENCES = [
    "Die Aktien von Mühlbruck stiegen am Nachmittag, während der Markt zulegte.", "Le conseil d’administration a décidé de céder l’usine à Château-Brel.", "La compañía cerrará 12 almacenes; la inversión bajó más de lo previsto.",
    "A administração não comentou a possível aquisição, nem a produção.", "Spółka zapłaciła za część działu usług; wzrosła sprzedaż.", "Совет директоров одобрил выплату дивидендов и продажу склада.",
    "“Nothing is signed,” said Ylsø Tordex — “but we do talk.”", "Net debt was £404.5 million, up 3.2\xa0per cent from €391 million.", "INFORMAÇÃO AO MERCADO: NÃO HÁ PREVISÃO DE EMISSÃO.", "Plain ASCII about sales and margins.", "caf&eacute; &amp; bar sales rose",
]
MISREAD = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1250"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1252", "mac_roman"), ("cp1250", "cp1252")]


def test_chains_are_undone():
    assert E.undo_utf8("CafÃ© â€œxâ€\x9d", "cp1252") == "Café “x”"
    assert E.undo_utf8("15Â per", "cp1252") == "15\xa0per"
    assert E.undo_utf8("ã©tã©", "cp1252") == "été"
    assert E.undo_utf8("été", "cp1252") is None and E.undo_utf8("plain", "cp1252") is None
    assert E.undo_single("Ñîâåò", "cp1252", "cp1251") == "Совет" and E.undo_single("Совет", "cp1252", "cp1251") is None
    assert "é" in [r for r, _ in E.restorations("ÃƒÂ©")]


def corpus(seed=0, n=1500):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        text = "\n".join(rng.choice(SENTENCES).replace("12", str(rng.randrange(100))) for _ in range(rng.randrange(1, 4)))
        if rng.random() < 0.06 and not text.isascii():
            written_in, read_as = rng.choice(MISREAD)
            try:
                bad = text.encode(written_in).decode(read_as)
            except UnicodeError:
                bad = text.encode("utf-8").decode("latin-1")
            if bad != text:
                truth[i] = text
                text = bad
        docs.append((i, text))
    return docs, truth


@pytest.fixture(scope="module")
def found(spark):
    docs, truth = corpus()
    extra = [(9001, None), (9002, ""), (9003, "lost � here"), (9004, "Net debt was Â£404.5 million " + "word " * 40_000), (9005, "x" * 300_000), (9006, "ж" * 100_000)]
    df = spark.createDataFrame(docs + extra + extra[2:3], "doc_id long, text string").withColumn("t", F.lit("clash")).withColumn("d", F.lit(0)).repartition(4)
    return {r.doc_id: r for r in E.garbled_records(df).collect()}, truth


def test_found_and_restored(found):
    got, truth = found
    cases = {d for d in got if d < 9000}
    assert cases == set(truth)
    right = sum(got[d].restored_text == t for d, t in truth.items())
    assert right >= 0.95 * len(truth)


def test_special_rows(found):
    got, _ = found
    assert {d for d in got if d > 9000} == {9003, 9004}
    assert got[9003].n_lost == 1 and got[9003].restored_text == "lost � here" and got[9003].chains == ""
    assert got[9004].restored_text.startswith("Net debt was £404.5") and len(got[9004].restored_text) == 200_028


def test_empty_table(spark):
    assert E.garbled_records(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert E.garbled_records(spark.createDataFrame([(None, None), (None, "a�")], "doc_id long, text string")).count() == 1


def test_scalar_and_array_counts_agree():
    texts = [s for s in SENTENCES * 3]
    counts = {n: np.zeros(size, dtype=np.int64) for n, size in E.BUCKETS.items()}
    E.count_ngrams(texts[:5], counts)
    E.count_ngrams(texts[5:], counts)
    model = E.NgramModel(counts)
    for s in SENTENCES:
        for a in range(len(s) - 2):
            if not s[a : a + 3].isascii():
                codes = E._codes([s[a : a + 3]])[2:-2]
                assert model.three[E._buckets(codes, 3)[0]] >= 3
    assert model.score("für") > model.score("fÃ¼r") and model.score("abc") == 0.0


def test_copies_teach_nothing(spark):
    """Garbled texts whose copies are a third of the rows are found like single ones, and every copy comes out."""
    docs, truth = corpus(seed=3, n=900)
    plain = [(d, t) for d, t in docs if d not in truth]
    bad = [SENTENCES[5].encode("cp1251").decode("cp1252"), SENTENCES[2].encode("cp1252").decode("mac_roman")]
    copies = [(10_000 + i, bad[i % 2]) for i in range(len(plain) // 2)]
    df = spark.createDataFrame(plain + copies, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in E.garbled_records(df).collect()} == {d for d, _ in copies}


@pytest.mark.parametrize("times", [1, 2, 4, 5, 6])
def test_any_number_of_readings(times):
    for source in ("é", "“Café”"):
        text = source
        for _ in range(times):
            text = text.encode("utf-8").decode("latin-1")
        assert source in [r for r, _ in E.restorations(text)]


@pytest.mark.parametrize("source,written_in,read_as", [("中国股市上涨", "gbk", "cp1252"), ("日本の株", "shift_jis", "mac_roman"), ("Αθήνα", "cp1253", "cp1252"), ("한국", "euc_kr", "latin_1")])
def test_other_encodings(source, written_in, read_as):
    assert source in [r for r, _ in E.restorations(source.encode(written_in).decode(read_as))]


def test_single_bytes_after_utf8():
    once = "Совет".encode("cp1251").decode("cp1252")
    assert "Совет" in [r for r, _ in E.restorations(once.encode("utf-8").decode("cp1252"))]


def test_utf16_read_byte_by_byte():
    assert E.undo_zeros("a " + "Größe".encode("utf-16-le").decode("latin-1")) == ("a Größe", ["latin_1>utf_16_le"])
    assert E.undo_zeros("plain") == ("plain", [])


def test_other_scripts_are_found(spark):
    """Chinese, Greek and text read five times among clean records of the same languages."""
    clean = SENTENCES + ["中国股市上涨，投资者欢迎公司的决定。", "公司今天宣布在中国投资建厂。", "Η εταιρεία ανακοίνωσε αύξηση των πωλήσεων στην Αθήνα."]
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(clean) for _ in range(2))) for i in range(800)]
    five = SENTENCES[0]
    for _ in range(5):
        five = five.encode("utf-8").decode("latin-1")
    bad = {9001: clean[-3].encode("gbk").decode("cp1252", "ignore"), 9002: clean[-1].encode("cp1253").decode("cp1252"), 9003: five}
    found = {r.doc_id: r for r in E.garbled_records(spark.createDataFrame(docs + list(bad.items()), "doc_id long, text string")).collect()}
    assert set(found) == set(bad)
    assert found[9002].restored_text == clean[-1] and found[9003].restored_text == SENTENCES[0]
