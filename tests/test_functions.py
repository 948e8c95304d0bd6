import uuid

from pyspark.sql import functions as F

from panelforge.functions import dates, html, ids, text
from panelforge.functions.stemmer import stem


def column(spark, values, expression, kind="string"):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expression(F.col("x")).alias("y")).collect()]


def test_names(spark):
    assert column(spark, [" brk.b ", "A / B", None], text.canonical_ticker) == ["BRK-B", "A-B", None]
    assert column(spark, ["Apple, Inc.", "Johnson & Johnson", "Foo Holdings plc", None, ""], text.canonical_company) == ["APPLE", "JOHNSONJOHNSON", "FOO", None, ""]
    assert column(spark, ["o'Neil-9"], text.canonical_word) == ["ONEIL9"]
    assert column(spark, ["CIK 0000123456", "12"], text.digits_only) == ["0000123456", None]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Net sales rose 12% to $3,400,000 in Q3-2020"), (2, None), (3, " .. "), (4, "a " * 50_000)], "id int, t string")
    rows = text.tokens(df, "id", F.col("t")).collect()
    assert [r.token for r in rows if r.id == 1] == ["NET", "SALES", "ROSE", "12", "TO", "3", "400", "000", "IN", "Q3", "2020"]
    assert {r.id for r in rows} == {1, 4} and sum(r.id == 4 for r in rows) == 50_000
    kinds = column(spark, ["AB", "12", "A1"], text.token_type)
    assert kinds == ["alpha", "numeric", "alphanumeric"]
    assert column(spark, ["5", "1000000", "1000000000", "X"], text.canonical_number) == ["__NUM__", "__MIL__", "__BIL__", None]
    stems = [r.token for r in text.canonical_tokens(df.where("id = 1"), "id", F.col("t")).orderBy("pos").collect()]
    assert stems == ["net", "sale", "rose", "__NUM__", "__NUM__", "__NUM__", "__NUM__", "__NUM__"]


def test_stems():
    pairs = {"consistency": "consist", "knives": "knive", "relational": "relat", "hopping": "hop", "hoping": "hope", "generously": "generous", "communication": "communic", "ties": "tie", "cries": "cri", "by": "by", "skies": "sky", "luxuriated": "luxuri"}
    assert {w: stem(w) for w in pairs} == pairs


def test_article_gate(spark):
    rows = [("Good text", 0.999996), ("LAST PRICE of x", 1.0), ("Text COPYRIGHT 2020", 1.0), ("Good text", 0.89), (None, 1.0), ("Good", None)]
    df = spark.createDataFrame(rows, "t string, c double").select(text.is_clean_article(F.col("t"), F.col("c")).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, False, False, False, False, False]


def test_uuid5_and_ids(spark):
    names = ["a", "", "żółć"]
    assert column(spark, names, ids.uuid5) == [str(uuid.uuid5(ids.NAMESPACE, n)) for n in names]


def test_windows_and_months(spark):
    assert column(spark, ["2020-01-01 to 2020-02-01"], lambda c: dates.window_text(dates.window_start(c), dates.window_end(c))) == ["2020-01-01 to 2020-02-01"]
    d = dates.dt.date
    assert dates.month_bounds(2020, 12, d(2016, 8, 1), d(2025, 8, 1)) == (d(2020, 11, 24), d(2021, 1, 8))
    assert dates.month_bounds(2016, 8, d(2016, 8, 1), d(2025, 8, 1))[0] == d(2016, 8, 1)
    assert column(spark, ["s3/CC-NEWS-20240101030000-1.gz", "none"], lambda c: dates.civil_day(dates.link_time(c)).cast("string")) == ["2023-12-31", None]


def test_article_text(spark):
    body = " ".join(f"word{i}" for i in range(30))
    page = f"<html><head><title>no</title></head><body><nav>menu</nav><article><script>x()</script><p>{body} café</p><p>short</p></article></body></html>"
    found = html.article_text(page)
    assert found.startswith("WORD0 WORD1") and found.endswith("CAF") and "X()" not in found
    assert html.article_text("<p>too short</p>") is None and html.article_text(None) is None and html.article_text("") is None
    assert column(spark, [page, None], html.visible_text) == [found, None]
    table = "<table><tr><th>Ticker</th><th>CIK</th></tr><tr><td>ABC</td><td>000 123</td></tr></table>"
    assert html.column_for_key(table, "ticker", "cik", "abc") == "000 123"
    form = '<div><div class="infoHead">Filing Date</div><div class="info">2020-01-02</div><div class="infoHead">Items</div><div class="info">Item 1.01: x</div></div>'
    assert html.labelled_text(form, "Filing Date") == "2020-01-02" and html.labelled_text(form, "Items") == "Item 1.01: x" and html.labelled_text(form, "None") is None


def test_language_confidence(spark):
    from panelforge.functions import language

    rows = [("en", "the company said net sales rose and the board approved a plan for the year"), ("EN-us", "holders of the shares backed the motion at the meeting"), ("de", "der Vorstand kündigte an, Stellen zu streichen und das Werk zu schließen"),
            ("fr", "le conseil a décidé de céder l’usine malgré un carnet de commandes élevé"), (None, "the the the"), ("xx", "zzz"), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language.train_languages(df, "text", "lang")
    assert model.languages == ["de", "en", "fr"]
    ask = spark.createDataFrame([("the board approved the sale of shares",), ("der Vorstand streicht Stellen im Werk",), (None,), ("",), ("a " * 100_000,)], "t string")
    got = [r.c for r in ask.select(language.confidence(model, ask, F.col("t")).alias("c")).collect()]
    assert got[0] > 0.9 and got[1] < 0.1 and got[2] is None and abs(got[3] - 1 / 3) < 1e-9 and 0 <= got[4] <= 1
    assert language.train_languages(df.limit(0), "text", "lang").languages == []
