"""Queries over evidence, prices, topics and text, set operations and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import text
from panelforge.functions.dates import window_end, window_start, window_text
from panelforge.functions.ids import evidence_id
from panelforge.operators import checks, corpus, entity, relational, temporal, topic_sampling, topics
from panelforge.operators.coverage import NEVER, window_bounds
from panelforge.plans.intervals_and_asof import article_firms, table, ticker_key
from panelforge.plans.news import membership


# ---- evidence

def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ticker_cik_mapping")
    return rows.select(ticker_key(F.col("ticker")).alias("ticker"), F.col("cik").alias("candidate_cik"), "validity_window", F.col("evidence_type").alias("form_type"), "filed_at", "accession_num", "evidence_id").distinct()


def w6_canonical_evidence(spark, sf_dir):
    return entity.canonical_evidence(evidence(spark, sf_dir), ["ticker", "candidate_cik"]).select("ticker", "candidate_cik", "evidence_id", "form_type")


def a2_candidate_features(spark, sf_dir):
    return entity.candidate_features(evidence(spark, sf_dir), ["ticker"])


def a4_resolved_tickers(spark, sf_dir):
    return entity.resolved(evidence(spark, sf_dir), ["ticker"])


def a11_name_spans(spark, sf_dir):
    names = table(spark, sf_dir, "security_profile_history").select("cik", "evidence_id", "ingested_at", text.canonical_company(F.col("company_name")).alias("name")).distinct()
    spans = entity.name_spans(names, ["cik"], "name", "ingested_at")
    return spans.select("cik", "name", F.unix_micros("first_at").alias("first_micros"), F.unix_micros("last_at").alias("last_micros"), "n_evidence", "n_names")


def w13_first_and_last_seen(spark, sf_dir):
    seen = table(spark, sf_dir, "wayback_cik_candidates").select(ticker_key(F.col("ticker")).alias("ticker"), "candidate_cik", F.col("first_seen_at").alias("seen_at"), F.coalesce("first_seen_url", F.lit("")).alias("url"))
    out = temporal.first_and_last_seen(seen, ["ticker", "candidate_cik"], "seen_at", "url")
    return out.select("ticker", "candidate_cik", F.unix_micros("first_seen_at").alias("first_micros"), "first_seen_url", F.unix_micros("last_seen_at").alias("last_micros"), "last_seen_url")


def mapped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, cik, start_day, end_day) of the ticker mappings; `end_day` is null where one never ends."""
    rows = table(spark, sf_dir, "ticker_cik_mapping").select(ticker_key(F.col("ticker")).alias("ticker"), "cik", window_bounds(F.col("validity_window")).alias("w")).where("w is not null")
    return rows.select("ticker", "cik", F.date_from_unix_date("w.lo").alias("start_day"), F.when(F.col("w.hi") < NEVER, F.date_from_unix_date("w.hi")).alias("end_day")).distinct()


def j12_alias_rewriting(spark, sf_dir):
    seen = table(spark, sf_dir, "wayback_cik_candidates").select(ticker_key(F.col("ticker")).alias("ticker"), F.date_from_unix_date(F.floor(F.unix_seconds("first_seen_at") / 86400).cast("int")).alias("seen_day"))
    aliases = mapped_windows(spark, sf_dir).select(F.col("ticker").alias("alias"), F.col("cik").alias("canonical"), F.col("start_day").alias("start_date"), F.col("end_day").alias("end_date"))
    return temporal.rewrite_aliases(seen, "ticker", "seen_day", aliases).groupBy("ticker", "seen_day").agg(F.count("*").alias("n_rows"))


def j16_evidence_of_mapped_pairs(spark, sf_dir):
    candidates = table(spark, sf_dir, "wayback_cik_candidates").select(ticker_key(F.col("ticker")).alias("ticker"), "candidate_cik")
    return relational.within_keys(evidence(spark, sf_dir), candidates, ["ticker", "candidate_cik"]).select("ticker", "candidate_cik", "evidence_id")


def s33_candidate_override(spark, sf_dir):
    each = lambda t, c: table(spark, sf_dir, t).select(ticker_key(F.col("ticker")).alias("ticker"), F.col(c).alias("cik")).distinct().groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_list("cik")), ",").alias("ciks"))
    return relational.override(each("wayback_cik_candidates", "candidate_cik"), each("ticker_cik_mapping", "cik"), ["ticker"], "ciks")


def t1_tickers(spark, sf_dir):
    return table(spark, sf_dir, "ticker_cik_mapping").select(text.canonical_ticker(F.concat("ticker", F.lit(" ./x"))).alias("symbol")).distinct()


def t2_company_names(spark, sf_dir):
    return table(spark, sf_dir, "security_profile_history").select("company_name", text.canonical_company(F.col("company_name")).alias("canonical")).distinct()


def t13_evidence_ids(spark, sf_dir):
    return evidence(spark, sf_dir).select("evidence_id", evidence_id(F.col("ticker"), F.col("candidate_cik"), F.col("filed_at"), F.col("accession_num"), F.col("form_type")).alias("content_id"))


def t28_window_texts(spark, sf_dir):
    named = mapped_windows(spark, sf_dir).select("ticker", "cik", window_text(F.col("start_day"), F.col("end_day")).alias("window"))
    return named.select("ticker", "cik", "window", window_start(F.col("window")).alias("start_day"), window_end(F.col("window")).alias("end_day"))


def t39_window_split(spark, sf_dir):
    """Each ticker with two firms is cut on the day on which the second begins."""
    windows = mapped_windows(spark, sf_dir)
    firsts = windows.groupBy("ticker", "cik").agg(F.min("start_day").alias("d")).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("d", "cik"))).alias("s")).where(F.size("s") >= 2)
    splits = firsts.select("ticker", F.col("s")[1].d.alias("split_day"), F.col("s")[0].cik.alias("pre_cik"), F.col("s")[1].cik.alias("post_cik"))
    return temporal.split_windows(windows.withColumnRenamed("cik", "candidate_cik").withColumn("filed_day", F.col("start_day")), splits)


def j19_firm_mentions(spark, sf_dir):
    # an article's texts in one row, so the words stay where they are
    articles = table(spark, sf_dir, "parsed_news_articles").groupBy("article_id").agg(F.collect_set("full_text").alias("texts")).select("article_id", F.explode("texts").alias("full_text"))
    words = lambda c: F.regexp_extract_all(F.upper(c), F.lit("[A-Z0-9]+"), 0)
    elements = articles.select("article_id", F.explode(words(F.col("full_text"))).alias("word"))
    names = table(spark, sf_dir, "security_profile_history").select("company_name").distinct().select("company_name", F.explode(words(F.col("company_name"))).alias("word"))
    return relational.contained_sets(elements, names, "article_id", "company_name", "word", text.NAME_SUFFIXES)


def c1_overlapping_windows(spark, sf_dir):
    return checks.overlapping_windows(mapped_windows(spark, sf_dir), ["ticker"], "start_day", "end_day").groupBy("ticker").agg(F.count("*").alias("n_overlaps"))


def c2_broken_rules(spark, sf_dir):
    articles = table(spark, sf_dir, "parsed_news_articles")
    return checks.failing(articles, {
        "known_session": F.col("session").isin("intraday", "overnight"), "positive_word_count": F.col("word_count") > 0, "confidence_share": F.col("language_confidence").between(0, 1),
        "firms_named": F.size("cik_list") > 0, "few_firms_if_short": checks.implies(F.col("word_count") < 60, F.size("cik_list") <= 3), "crawled_after_day": F.to_date("warc_date_utc") >= F.col("trading_day")})


def c8_orphan_postings(spark, sf_dir):
    return checks.orphans(table(spark, sf_dir, "lda_document_terms"), table(spark, sf_dir, "lda_vocabulary"), {"term_id": "term_id"}).groupBy("corpus_version").agg(F.count("*").alias("n_rows"))


def c3_filed_outside_window(spark, sf_dir):
    """Evidence filed on a day (UTC) outside the window that it supports, by type."""
    rows = table(spark, sf_dir, "ticker_cik_mapping").select("evidence_type", "filed_at", window_bounds(F.col("validity_window")).alias("w"))
    filed = F.floor(F.unix_seconds("filed_at") / 86400)
    return checks.outside_window(rows, filed, F.col("w.lo"), F.col("w.hi")).groupBy("evidence_type").agg(F.count("*").alias("n_rows"))


def c6_repeated_members(spark, sf_dir):
    return checks.repeated_keys(table(spark, sf_dir, "snp_membership"), ["cik", "trading_day"])


def a22_expected_firms(spark, sf_dir):
    return checks.expect_count(table(spark, sf_dir, "security_profile_history").select("cik").distinct(), 120)


# ---- prices

def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("price"))


def j1_as_of_fundamentals(spark, sf_dir):
    panel = price_panel(spark, sf_dir)
    filed = panel.groupBy("l_suppkey", F.trunc("day", "quarter").alias("q")).agg(F.max("day").alias("filing_day"), F.count("*").alias("book")).drop("q")
    return temporal.as_of_join(panel, filed, "l_suppkey", "day", "filing_day", ["book"], 90).select("l_suppkey", "day", "filing_day", "book")


def w0_price_features(spark, sf_dir):
    out = temporal.price_features(price_panel(spark, sf_dir), "l_suppkey", "day", "price")
    return out.select("l_suppkey", "day", *[F.round(c, 6).alias(c) for c in ("log_return", "vol_21", "vol_252", "mom_21", "mom_252")])


def w12_forecast_ranks(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "return_forecasts").where("forecast_annual_log_return is not null and not isnan(forecast_annual_log_return)").select("run_id", "cik", "forecast_year", "session", "forecast_annual_log_return").distinct()
    order = Window.partitionBy("run_id", "forecast_year", "session").orderBy(F.desc("forecast_annual_log_return"))
    return rows.select("run_id", "cik", "forecast_year", "session", F.rank().over(order).alias("rank_within_year"), F.dense_rank().over(order).alias("dense_rank_within_year"))


def k3_latest_forecasts(spark, sf_dir):
    keys = ["run_id", "cik", "forecast_year", "session"]
    rows = relational.latest_per_key(table(spark, sf_dir, "return_forecasts").select(*keys, "created_at", "rank_within_year"), [*keys, "created_at"], F.asc_nulls_last("rank_within_year"))
    newest = relational.latest_per_key(rows, keys, F.desc("created_at"))
    oldest = relational.latest_per_key(rows, keys, F.asc("created_at"))
    return relational.upsert(oldest, newest, keys).select(*keys, F.unix_micros("created_at").alias("created_micros"))


# ---- topics and text

def term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, token, term_id, term_count) of the counting postings; a document is an article in a corpus version."""
    postings = table(spark, sf_dir, "lda_document_terms").where("article_id is not null and term_count >= 1 and term_id is not null").groupBy("article_id", "corpus_version", "term_id").agg(F.max("term_count").alias("term_count"))
    words = table(spark, sf_dir, "lda_vocabulary").select("term_id", F.upper(F.trim("token")).alias("token"))
    return postings.join(words, "term_id").select(F.concat_ws("/", "article_id", "corpus_version").alias("document"), "token", "term_id", "term_count", "corpus_version")


def w8_top_terms(spark, sf_dir):
    weights = term_rows(spark, sf_dir).groupBy("corpus_version", "token").agg(F.sum("term_count").alias("weight"))
    return topics.top_words(weights, ["corpus_version"], "token", "weight").select("corpus_version", F.array_join("terms", ",").alias("terms"))


def a16_rebuilt_texts(spark, sf_dir):
    rows = term_rows(spark, sf_dir)
    return corpus.rebuilt_texts(rows, "document", F.col("term_id")).select("document", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def a6_pruned_documents(spark, sf_dir):
    merged = term_rows(spark, sf_dir).groupBy("document", "token").agg(F.sum("term_count").alias("term_count"))
    return corpus.prune(merged, "document", 25)[2]


def a14_frequency_of_frequencies(spark, sf_dir):
    merged = term_rows(spark, sf_dir).groupBy("document", "token").agg(F.sum("term_count").alias("term_count"))
    return corpus.frequency_of_frequencies(corpus.vocabulary_counts(merged), "document_frequency")


def k21_term_ids(spark, sf_dir):
    merged = term_rows(spark, sf_dir).groupBy("document", "token").agg(F.sum("term_count").alias("term_count"))
    return corpus.term_ids(corpus.vocabulary_counts(merged)).select("term_id", "token", "document_frequency")


def t4_tokens(spark, sf_dir):
    found = text.tokens(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))


def t5_token_types(spark, sf_dir):
    found = text.tokens(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    kind = text.token_type(F.col("token"))
    bare = F.when(kind == "numeric", text.canonical_number(F.col("token"))).when(kind == "alphanumeric", F.regexp_replace("token", "[0-9]", "")).otherwise(F.col("token"))
    return found.groupBy(kind.alias("token_type"), bare.alias("token")).agg(F.count("*").alias("n"))


def t10_stemmed_counts(spark, sf_dir):
    found = text.canonical_tokens(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return corpus.vocabulary_counts(corpus.document_terms(found, "doc_id"))


def t11_coherence_tokens(spark, sf_dir):
    found = text.canonical_tokens(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), labels=text.COHERENCE_LABELS)
    return found.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s.token).alias("tokens"))


def f14_english_confidence(spark, sf_dir):
    """Confidence in English of every document by a model of the labelled ones."""
    from panelforge.functions import language

    docs = table(spark, sf_dir, "documents")
    model = language.train_languages(docs, "text", "lang")
    return docs.select("doc_id", language.language_code(F.col("lang")).alias("label"), language.confidence(model, docs, F.col("text")).alias("english"))


def s43_distinct_texts(spark, sf_dir):
    from panelforge.sources.files import by_ids

    ids = table(spark, sf_dir, "lda_document_terms").select("article_id").dropna()
    return by_ids(table(spark, sf_dir, "parsed_news_articles"), ids).select("article_id")


def a18_firm_topics(spark, sf_dir):
    shown = table(spark, sf_dir, "lda_article_topic_exposure").where("topic_exposure > 0 and not isnan(topic_exposure)").select("article_id", "run_id", "topic_id").distinct()
    firms = article_firms(spark, sf_dir)
    sessions = table(spark, sf_dir, "parsed_news_articles").select("article_id", "session").distinct()
    return shown.join(firms, "article_id").join(sessions, "article_id").select("cik", "session", F.year("trading_day").alias("year"), "topic_id").distinct().groupBy("cik", "session", "year").agg(F.count("*").alias("n_topics"))


def j11_topic_selection(spark, sf_dir):
    shown = table(spark, sf_dir, "lda_article_topic_exposure").where("topic_exposure >= 0.3 and topic_exposure <= 1").select("article_id", "topic_id").distinct()
    sessions = table(spark, sf_dir, "parsed_news_articles").select("article_id", "session").distinct()
    hits = shown.join(article_firms(spark, sf_dir), "article_id").join(sessions, "article_id").select("cik", "session", F.year("trading_day").alias("year"), "topic_id")
    panel = membership(spark, sf_dir).select("cik", F.year("trading_day").alias("year")).distinct().withColumn("session", F.explode(F.array(F.lit("intraday"), F.lit("overnight"))))
    chosen = topics.topic_selection(hits, panel, table(spark, sf_dir, "lda_article_topic_exposure").select("topic_id").dropna().distinct())
    return chosen.groupBy("topic_id").agg(F.count("*").alias("n_rows"), F.sum("selected").alias("n_selected"))


def a19_exposure_summary(spark, sf_dir):
    good = table(spark, sf_dir, "lda_article_topic_exposure").where("topic_exposure between 0 and 1 and not isnan(topic_exposure)").select("run_id", F.col("topic_exposure").alias("coherence"))
    return topics.coherence_summary(good).select("run_id", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")])


def m1_trained_topics(spark, sf_dir):
    """The ten heaviest terms of each of 200 topics, of a model of each corpus version."""
    rows = table(spark, sf_dir, "lda_document_terms").where("article_id is not null and term_count >= 1 and term_id is not null and corpus_version is not null")
    words = table(spark, sf_dir, "lda_vocabulary").select("term_id", F.upper(F.trim("token")).alias("token")).where("term_id is not null and token is not null").distinct()
    versions = [r.corpus_version for r in rows.select("corpus_version").distinct().orderBy("corpus_version").collect()]
    out = spark.createDataFrame([], "corpus_version smallint, topic_id int, term string, weight double")
    for version in versions:
        found = topic_sampling.sampled_topics(rows.where(F.col("corpus_version") == version), words, "article_id", 200, 10)
        out = out.unionByName(found.withColumn("corpus_version", F.lit(version).cast("smallint")))
    return out


def m5_topic_coherence(spark, sf_dir):
    """C_v, over documents, of the ten most used words of each usable language code as topics."""
    from panelforge.functions import language

    docs = table(spark, sf_dir, "documents").where("text is not null")
    found = text.tokens(docs, "doc_id", F.col("text"))
    counts = found.join(docs.select("doc_id", language.language_code(F.col("lang")).alias("run_id")), "doc_id").where("run_id is not null").groupBy("run_id", "token").agg(F.count("*").alias("weight"))
    words = topics.top_words(counts.withColumn("topic_id", F.lit(0)), ["run_id", "topic_id"], "token", "weight")
    return topics.coherence_cv(found, words, "doc_id").select("run_id", "topic_id", F.round("coherence", 6).alias("coherence"))


def a15_dropped_firms(spark, sf_dir):
    news = article_firms(spark, sf_dir).groupBy("cik").agg(F.countDistinct("trading_day").alias("n_days"))
    best = table(spark, sf_dir, "return_forecasts").where("not isnan(forecast_annual_log_return)").groupBy("cik").agg(F.max("forecast_annual_log_return").alias("best"))
    both = news.join(best, "cik", "full").select(F.coalesce("n_days", F.lit(0)).alias("n_days"), F.coalesce(F.col("best") > 0, F.lit(False)).alias("positive"))
    return both.groupBy("positive").agg(F.count("*").alias("n_firms"), F.round(F.avg("n_days"), 6).alias("mean_days"), F.min("n_days").alias("least_days"), F.max("n_days").alias("most_days"))


def u2_all_pairs(spark, sf_dir):
    pairs = lambda t, c: table(spark, sf_dir, t).select(ticker_key(F.col("ticker")).alias("ticker"), F.col(c).alias("cik"))
    a, b = pairs("ticker_cik_mapping", "cik"), pairs("wayback_cik_candidates", "candidate_cik")
    out = [a.union(b).distinct().withColumn("kind", F.lit("either")), a.intersect(b).withColumn("kind", F.lit("both")), a.distinct().exceptAll(b.distinct()).withColumn("kind", F.lit("mapped_only"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def t33_event_properties(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return events.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("greatest"))


QUERIES = {f.__name__: f for f in (
    w6_canonical_evidence, a2_candidate_features, a4_resolved_tickers, a11_name_spans, w13_first_and_last_seen, j12_alias_rewriting, j16_evidence_of_mapped_pairs, s33_candidate_override, t1_tickers, t2_company_names,
    t13_evidence_ids, t28_window_texts, t39_window_split, j19_firm_mentions, c1_overlapping_windows, c2_broken_rules, c3_filed_outside_window, c8_orphan_postings, c6_repeated_members, a22_expected_firms, j1_as_of_fundamentals, w0_price_features,
    w12_forecast_ranks, k3_latest_forecasts, w8_top_terms, a16_rebuilt_texts, a6_pruned_documents, a14_frequency_of_frequencies, k21_term_ids, t4_tokens, t5_token_types, t10_stemmed_counts, t11_coherence_tokens,
    f14_english_confidence, s43_distinct_texts, a18_firm_topics, j11_topic_selection, a19_exposure_summary, m1_trained_topics, m5_topic_coherence, a15_dropped_firms, u2_all_pairs, t33_event_properties)}

_EVIDENCE = """
WITH evidence AS (
  SELECT DISTINCT upper(trim(ticker)) AS ticker, cik AS candidate_cik, evidence_type AS form_type, filed_at, evidence_id,
    CASE evidence_type WHEN '10-K' THEN 0 WHEN '20-F' THEN 0 WHEN '10-KT' THEN 1 WHEN '10-QT' THEN 1 WHEN '10-K/A' THEN 1 WHEN '20-F/A' THEN 1 WHEN '10-Q' THEN 2 WHEN '10-Q/A' THEN 3 END AS form_rank
  FROM ticker_cik_mapping),
features AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_candidates, CAST(sum(CAST(has_periodic AS INTEGER)) OVER (PARTITION BY ticker) AS BIGINT) AS n_periodic
  FROM (SELECT ticker, candidate_cik, bool_or(form_rank IS NOT NULL) AS has_periodic FROM evidence GROUP BY 1, 2)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, candidate_cik ORDER BY form_rank NULLS LAST, filed_at DESC NULLS LAST, evidence_id DESC NULLS LAST) AS rn FROM evidence) WHERE rn = 1),
mapped AS (SELECT DISTINCT ticker, cik, CAST(lo AS DATE) AS start_day, CAST(hi AS DATE) AS end_day FROM (
    SELECT upper(trim(ticker)) AS ticker, cik, TRY_CAST(substr(validity_window, 2, 10) AS DATE) + CASE WHEN validity_window LIKE '(%' THEN 1 ELSE 0 END AS lo,
           TRY_CAST(regexp_extract(validity_window, ',\\s*([0-9-]{10})', 1) AS DATE) + CASE WHEN validity_window LIKE '%]' THEN 1 ELSE 0 END AS hi, regexp_matches(validity_window, ',\\s*[\\])]$') AS never_ends
    FROM ticker_cik_mapping) WHERE lo < hi OR (never_ends AND lo IS NOT NULL))
"""
_SUFFIXES = "'" + "', '".join(text.NAME_SUFFIXES) + "'"


def _canonical_sql(column: str) -> str:
    out = f"regexp_replace(upper(trim({column})), '[,&\\-/.]', '', 'g')"
    for suffix in text.NAME_SUFFIXES:
        out = f"regexp_replace({out}, '\\b{suffix}\\b\\.?', '', 'g')"
    return f"regexp_replace({out}, '\\s+', '', 'g')"


_PANEL = """
WITH panel AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
"""
_TERMS = """
WITH postings AS (SELECT article_id, corpus_version, term_id, max(term_count) AS term_count FROM lda_document_terms WHERE article_id IS NOT NULL AND term_count >= 1 AND term_id IS NOT NULL GROUP BY ALL),
terms AS (SELECT article_id || '/' || corpus_version AS document, corpus_version, upper(trim(token)) AS token, term_id, term_count FROM postings JOIN (SELECT term_id, token FROM lda_vocabulary) USING (term_id)),
merged AS (SELECT document, token, sum(term_count) AS term_count FROM terms GROUP BY 1, 2),
vocabulary AS (SELECT token, count(*) AS document_frequency FROM merged GROUP BY 1)
"""
_TOKENS = """
WITH found AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(upper(replace(replace(text, 'ß', 'SS'), 'ﬂ', 'FL')), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS token FROM documents WHERE text IS NOT NULL)
"""
_FIRMS = """
WITH firms AS (SELECT article_id, lpad(trim(c), 10, '0') AS cik, min(trading_day) AS trading_day FROM (SELECT article_id, trading_day, unnest(cik_list) AS c FROM parsed_news_articles WHERE trading_day IS NOT NULL) WHERE trim(c) <> '' GROUP BY 1, 2)
"""
ORACLES = {
    "w6_canonical_evidence": _EVIDENCE + "SELECT ticker, candidate_cik, evidence_id, form_type FROM best",
    "a2_candidate_features": _EVIDENCE + "SELECT * FROM features",
    "a4_resolved_tickers": _EVIDENCE + "SELECT ticker, candidate_cik, CASE WHEN n_candidates = 1 THEN 'single_candidate' ELSE 'single_periodic' END AS source, evidence_id AS canonical_evidence_id FROM features JOIN best USING (ticker, candidate_cik) WHERE has_periodic AND n_periodic = 1",
    "a11_name_spans": f"""WITH names AS (SELECT DISTINCT cik, evidence_id, ingested_at, {_canonical_sql('company_name')} AS name FROM security_profile_history),
  spans AS (SELECT cik, name, epoch_us(min(ingested_at)) AS first_micros, epoch_us(max(ingested_at)) AS last_micros, count(*) AS n_evidence FROM names GROUP BY 1, 2) SELECT *, count(name) OVER (PARTITION BY cik) AS n_names FROM spans""",
    "w13_first_and_last_seen": """WITH seen AS (SELECT upper(trim(ticker)) AS ticker, candidate_cik, epoch_us(first_seen_at) AS t, coalesce(first_seen_url, '') AS u FROM wayback_cik_candidates WHERE first_seen_at IS NOT NULL)
  SELECT ticker, candidate_cik, min(t) AS first_micros, arg_min(u, (t, u)) AS first_seen_url, max(t) AS last_micros, arg_max(u, (t, u)) AS last_seen_url FROM seen GROUP BY 1, 2""",
    "j12_alias_rewriting": _EVIDENCE + """, seen AS (SELECT row_number() OVER () AS id, upper(trim(ticker)) AS ticker, CAST(first_seen_at AT TIME ZONE 'UTC' AS DATE) AS seen_day FROM wayback_cik_candidates)
  SELECT coalesce(c, ticker) AS ticker, seen_day, count(*) AS n_rows FROM (SELECT s.id, s.ticker, s.seen_day, min(m.cik) AS c FROM seen s LEFT JOIN mapped m ON m.ticker = s.ticker AND s.seen_day >= m.start_day AND (m.end_day IS NULL OR s.seen_day < m.end_day) GROUP BY ALL) GROUP BY 1, 2""",
    "j16_evidence_of_mapped_pairs": """SELECT DISTINCT upper(trim(ticker)) AS ticker, cik AS candidate_cik, evidence_id FROM ticker_cik_mapping m WHERE EXISTS (SELECT 1 FROM wayback_cik_candidates w WHERE upper(trim(w.ticker)) = upper(trim(m.ticker)) AND w.candidate_cik = m.cik)""",
    "s33_candidate_override": """WITH a AS (SELECT upper(trim(ticker)) AS ticker, string_agg(DISTINCT candidate_cik, ',' ORDER BY candidate_cik) AS ciks FROM wayback_cik_candidates GROUP BY 1),
  b AS (SELECT upper(trim(ticker)) AS ticker, string_agg(DISTINCT cik, ',' ORDER BY cik) AS ciks FROM ticker_cik_mapping GROUP BY 1) SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(b.ciks, a.ciks) AS ciks FROM a FULL JOIN b ON a.ticker = b.ticker""",
    "t1_tickers": "SELECT DISTINCT regexp_replace(regexp_replace(upper(trim(ticker || ' ./x')), '\\s+', '', 'g'), '[./]', '-', 'g') AS symbol FROM ticker_cik_mapping",
    "t2_company_names": f"SELECT DISTINCT company_name, {_canonical_sql('company_name')} AS canonical FROM security_profile_history",
    "t28_window_texts": _EVIDENCE + "SELECT ticker, cik, strftime(start_day, '%Y-%m-%d') || ' to ' || coalesce(strftime(end_day, '%Y-%m-%d'), 'infinity') AS \"window\", start_day, end_day FROM mapped",
    "t39_window_split": _EVIDENCE + """, firsts AS (SELECT ticker, cik, min(start_day) AS d FROM mapped GROUP BY 1, 2), numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d, cik) AS n FROM firsts),
  splits AS (SELECT a.ticker, b.d AS split_day, a.cik AS pre_cik, b.cik AS post_cik FROM numbered a JOIN numbered b ON a.ticker = b.ticker AND a.n = 1 AND b.n = 2)
  SELECT m.ticker, m.cik AS candidate_cik, CASE WHEN m.cik = post_cik THEN greatest(start_day, split_day) ELSE start_day END AS start_day, CASE WHEN m.cik = pre_cik THEN least(end_day, split_day) ELSE end_day END AS end_day, start_day AS filed_day
  FROM mapped m LEFT JOIN splits s ON s.ticker = m.ticker WHERE CASE WHEN m.cik = pre_cik THEN start_day < split_day WHEN m.cik = post_cik THEN start_day >= split_day ELSE true END""",
    "j19_firm_mentions": f"""WITH words AS (SELECT article_id, word, count(*) AS n FROM (SELECT article_id, unnest(regexp_extract_all(upper(full_text), '[A-Z0-9]+')) AS word FROM (SELECT DISTINCT article_id, full_text FROM parsed_news_articles)) GROUP BY 1, 2),
  names AS (SELECT DISTINCT company_name, unnest(regexp_extract_all(upper(company_name), '[A-Z0-9]+')) AS word FROM security_profile_history),
  sizes AS (SELECT company_name, count(*) AS size, count(*) FILTER (word NOT IN ({_SUFFIXES})) AS keys FROM names GROUP BY 1),
  found AS (SELECT article_id, company_name, count(*) AS found, min(n) FILTER (word NOT IN ({_SUFFIXES})) AS least FROM words JOIN names USING (word) GROUP BY 1, 2)
  SELECT article_id, company_name FROM found JOIN sizes USING (company_name) WHERE found = size AND keys > 0 AND least > 1""",
    "c1_overlapping_windows": _EVIDENCE + "SELECT ticker, count(*) AS n_overlaps FROM (SELECT *, max(coalesce(end_day, DATE '9999-12-31')) OVER (PARTITION BY ticker ORDER BY start_day, end_day NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM mapped) WHERE start_day < busy GROUP BY 1",
    "c2_broken_rules": """SELECT unnest(['known_session', 'positive_word_count', 'confidence_share', 'firms_named', 'few_firms_if_short', 'crawled_after_day']) AS rule, unnest([count(*) FILTER (NOT session IN ('intraday', 'overnight')),
  count(*) FILTER (NOT word_count > 0), count(*) FILTER (NOT language_confidence BETWEEN 0 AND 1), count(*) FILTER (NOT len(cik_list) > 0), count(*) FILTER (NOT (NOT word_count < 60 OR len(cik_list) <= 3)), count(*) FILTER (NOT CAST(warc_date_utc AT TIME ZONE 'UTC' AS DATE) >= trading_day)]) AS n_rows FROM parsed_news_articles""",
    "c3_filed_outside_window": """WITH raw AS (SELECT evidence_type, CAST(filed_at AT TIME ZONE 'UTC' AS DATE) AS filed, TRY_CAST(substr(validity_window, 2, 10) AS DATE) + CASE WHEN validity_window LIKE '(%' THEN 1 ELSE 0 END AS lo,
    CASE WHEN regexp_matches(validity_window, ',\\s*[\\])]$') THEN DATE '9999-12-31' ELSE TRY_CAST(regexp_extract(validity_window, ',\\s*([0-9-]{10})', 1) AS DATE) + CASE WHEN validity_window LIKE '%]' THEN 1 ELSE 0 END END AS hi FROM ticker_cik_mapping)
  SELECT evidence_type, count(*) AS n_rows FROM raw WHERE lo < hi AND (filed < lo OR filed >= hi) GROUP BY 1""",
    "c8_orphan_postings": "SELECT corpus_version, count(*) AS n_rows FROM lda_document_terms WHERE term_id IS NOT NULL AND term_id NOT IN (SELECT term_id FROM lda_vocabulary) GROUP BY 1",
    "c6_repeated_members": "SELECT cik, trading_day, count(*) AS n_rows FROM snp_membership GROUP BY 1, 2 HAVING count(*) > 1",
    "a22_expected_firms": "SELECT count(DISTINCT cik) AS n_rows, CAST(120 AS BIGINT) AS expected, count(DISTINCT cik) = 120 AS ok FROM security_profile_history",
    "j1_as_of_fundamentals": _PANEL + """, filed AS (SELECT l_suppkey, max(day) AS filing_day, count(*) AS book FROM panel GROUP BY l_suppkey, date_trunc('quarter', day))
  SELECT p.l_suppkey, p.day, CASE WHEN p.day - f.filing_day <= 90 THEN f.filing_day END AS filing_day, CASE WHEN p.day - f.filing_day <= 90 THEN f.book END AS book FROM panel p ASOF LEFT JOIN filed f ON p.l_suppkey = f.l_suppkey AND p.day >= f.filing_day""",
    "w0_price_features": _PANEL + """, returns AS (SELECT *, ln(price / lag(price) OVER w) AS log_return FROM panel WINDOW w AS (PARTITION BY l_suppkey ORDER BY day))
  SELECT l_suppkey, day, round(log_return, 6) AS log_return, round(CASE WHEN count(log_return) OVER a = 21 THEN stddev_samp(log_return) OVER a * sqrt(252) END, 6) AS vol_21, round(CASE WHEN count(log_return) OVER b = 252 THEN stddev_samp(log_return) OVER b * sqrt(252) END, 6) AS vol_252,
  round(lag(price, 1) OVER w / lag(price, 22) OVER w - 1, 6) AS mom_21, round(lag(price, 1) OVER w / lag(price, 253) OVER w - 1, 6) AS mom_252 FROM returns
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY day), a AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""",
    "w12_forecast_ranks": """SELECT run_id, cik, forecast_year, session, CAST(rank() OVER w AS INTEGER) AS rank_within_year, CAST(dense_rank() OVER w AS INTEGER) AS dense_rank_within_year FROM (SELECT DISTINCT run_id, cik, forecast_year, session, forecast_annual_log_return AS f FROM return_forecasts WHERE NOT isnan(forecast_annual_log_return))
  WINDOW w AS (PARTITION BY run_id, forecast_year, session ORDER BY f DESC)""",
    "k3_latest_forecasts": "SELECT run_id, cik, forecast_year, session, epoch_us(max(created_at)) AS created_micros FROM return_forecasts GROUP BY ALL",
    "w8_top_terms": _TERMS + "SELECT corpus_version, string_agg(token, ',' ORDER BY rn) AS terms FROM (SELECT corpus_version, token, row_number() OVER (PARTITION BY corpus_version ORDER BY sum(term_count) DESC, token) AS rn FROM terms GROUP BY 1, 2) WHERE rn <= 10 GROUP BY 1",
    "a16_rebuilt_texts": _TERMS + ", texts AS (SELECT document, string_agg(rtrim(repeat(token || ' ', CAST(term_count AS INTEGER))), ' ' ORDER BY term_id) AS text FROM terms GROUP BY 1) SELECT document, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM texts",
    "a6_pruned_documents": _TERMS + "SELECT document, CAST(sum(term_count) AS BIGINT) AS total_term_count, count(*) AS unique_term_count FROM merged WHERE token IN (SELECT token FROM vocabulary WHERE document_frequency >= 25) GROUP BY 1",
    "a14_frequency_of_frequencies": _TERMS + "SELECT document_frequency AS frequency, count(*) AS n_tokens FROM vocabulary WHERE document_frequency <= 1000 GROUP BY 1",
    "t4_tokens": _TOKENS + "SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM found GROUP BY 1",
    "t5_token_types": _TOKENS + """, typed AS (SELECT token, CASE WHEN regexp_full_match(token, '[A-Z]+') THEN 'alpha' WHEN regexp_full_match(token, '[0-9]+') THEN 'numeric' ELSE 'alphanumeric' END AS token_type FROM found)
  SELECT token_type, CASE token_type WHEN 'numeric' THEN CASE WHEN CAST(token AS DOUBLE) >= 1e9 THEN '__BIL__' WHEN CAST(token AS DOUBLE) >= 1e6 THEN '__MIL__' ELSE '__NUM__' END WHEN 'alphanumeric' THEN regexp_replace(token, '[0-9]', '', 'g') ELSE token END AS token, count(*) AS n FROM typed GROUP BY 1, 2""",
    "s43_distinct_texts": "SELECT min(article_id) AS article_id FROM parsed_news_articles WHERE article_id IN (SELECT article_id FROM lda_document_terms) GROUP BY full_text",
    "a18_firm_topics": _FIRMS + """SELECT cik, session, CAST(year(trading_day) AS INTEGER) AS year, count(DISTINCT topic_id) AS n_topics FROM firms JOIN (SELECT DISTINCT article_id, session FROM parsed_news_articles) USING (article_id)
  JOIN (SELECT DISTINCT article_id, topic_id FROM lda_article_topic_exposure WHERE topic_exposure > 0 AND NOT isnan(topic_exposure)) USING (article_id) GROUP BY 1, 2, 3""",
    "j11_topic_selection": _FIRMS + """, hits AS (SELECT DISTINCT cik, session, year(trading_day) AS year, topic_id FROM firms JOIN (SELECT DISTINCT article_id, session FROM parsed_news_articles) USING (article_id) JOIN lda_article_topic_exposure USING (article_id) WHERE topic_exposure >= 0.3 AND topic_exposure <= 1),
  panel AS (SELECT DISTINCT cik, year(trading_day) AS year, session FROM snp_membership CROSS JOIN (VALUES ('intraday'), ('overnight')) s(session))
  SELECT t.topic_id, count(*) AS n_rows, count(h.cik) AS n_selected FROM panel p CROSS JOIN (SELECT DISTINCT topic_id FROM lda_article_topic_exposure WHERE topic_id IS NOT NULL) t LEFT JOIN hits h ON h.cik = p.cik AND h.year = p.year AND h.session = p.session AND h.topic_id = t.topic_id GROUP BY 1""",
    "a19_exposure_summary": "SELECT run_id, round(avg(topic_exposure), 6) AS mean, round(median(topic_exposure), 6) AS median, round(stddev_samp(topic_exposure), 6) AS std, min(topic_exposure) AS min, max(topic_exposure) AS max FROM lda_article_topic_exposure WHERE topic_exposure BETWEEN 0 AND 1 AND NOT isnan(topic_exposure) GROUP BY 1",
    "a15_dropped_firms": _FIRMS + """, news AS (SELECT cik, count(DISTINCT trading_day) AS n_days FROM firms GROUP BY 1), best AS (SELECT cik, max(forecast_annual_log_return) AS best FROM return_forecasts WHERE NOT isnan(forecast_annual_log_return) GROUP BY 1)
  SELECT coalesce(best > 0, false) AS positive, count(*) AS n_firms, round(avg(coalesce(n_days, 0)), 6) AS mean_days, min(coalesce(n_days, 0)) AS least_days, max(coalesce(n_days, 0)) AS most_days FROM news FULL JOIN best USING (cik) GROUP BY 1""",
    "u2_all_pairs": """WITH a AS (SELECT upper(trim(ticker)) AS ticker, cik FROM ticker_cik_mapping), b AS (SELECT upper(trim(ticker)) AS ticker, candidate_cik AS cik FROM wayback_cik_candidates)
  SELECT *, 'either' AS kind FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT *, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'mapped_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "t33_event_properties": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS greatest FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
}
