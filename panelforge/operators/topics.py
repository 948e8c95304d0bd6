"""Topic models: training, inference, top words, coherence, selection panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.storage import materialize


def top_words(weights: DataFrame, groups: list[str], term: str = "term", weight: str = "weight", n: int = 10) -> DataFrame:
    """(groups, terms): the `n` terms of greatest weight, in that order; ties go to the smaller term."""
    order = Window.partitionBy(*groups).orderBy(F.desc(weight), term)
    best = weights.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return best.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", term))), lambda s: s[term]).alias("terms"))


def topic_exposures(proportions: DataFrame, run: Column, version: int) -> DataFrame:
    """Long exposures (run_id, article_id, corpus_version, topic_id, topic_exposure) from parsed (instance_id, topic_id, topic_proportion)."""
    return proportions.select(run.alias("run_id"), F.col("instance_id").alias("article_id"), F.lit(version).cast("smallint").alias("corpus_version"), "topic_id", F.col("topic_proportion").alias("topic_exposure"))


def topic_metadata(words: DataFrame, coherence: DataFrame, seeds: DataFrame) -> DataFrame:
    """Run, topic, terms, coherence and seed, joined by their keys."""
    return words.join(coherence, ["run_id", "topic_id"]).join(seeds, "run_id", "left")


def coherence_summary(coherence: DataFrame) -> DataFrame:
    """Mean, median, deviation, least and greatest coherence of each run."""
    c = F.col("coherence")
    return coherence.groupBy("run_id").agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def train_topics(terms: DataFrame, doc: str, k: int, max_iterations: int = 20, seed: int = 42, vocabulary_size: int = 1 << 18, min_documents: int = 1):
    """(count model, topic model) of a document-term matrix (doc, token, term_count); asymmetric document priors are fitted.

    An iteration passes over about as many documents as there are; at Spark's own 5 percent, 20 of them would leave out a third of the corpus.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    # few bytes but much arithmetic, on each iteration anew: AQE would leave it all to one core
    words = materialize(documents_as_words(terms, doc).repartition(terms.sparkSession.sparkContext.defaultParallelism), "words")
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary_size, minDF=min_documents).fit(words)
    model = LDA(k=k, maxIter=max_iterations, seed=seed, optimizer="online", subsamplingRate=1.0, optimizeDocConcentration=True).fit(counter.transform(words))
    return counter, model


def documents_as_words(terms: DataFrame, doc: str, token: str = "token") -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.col(token).alias("t"), F.col("term_count").cast("int").alias("n"))))
    return terms.groupBy(doc).agg(F.flatten(F.transform(rows, lambda s: F.array_repeat(s.t, s.n))).alias("words"))


def infer_topics(counter, model, terms: DataFrame, doc: str) -> DataFrame:
    """(doc, topic_id, topic_exposure) of documents, seen or not, under the training vocabulary."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(counter.transform(documents_as_words(terms, doc)))
    return scored.select(doc, F.posexplode(vector_to_array("topicDistribution")).alias("topic_id", "topic_exposure"))


def topic_words(counter, model, n: int) -> DataFrame:
    """(topic_id, term, weight) of the `n` heaviest terms of each topic."""
    described = model.describeTopics(n)
    vocabulary = described.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "i int, term string")
    pairs = described.select(F.col("topic").alias("topic_id"), F.explode(F.arrays_zip("termIndices", "termWeights")).alias("x"))
    return pairs.select("topic_id", F.col("x.termIndices").alias("i"), F.col("x.termWeights").alias("weight")).join(vocabulary, "i").select("topic_id", "term", "weight")


def coherence_cv(tokens: DataFrame, topics: DataFrame, doc: str, window: int = 110, epsilon: float = 1e-12) -> DataFrame:
    """(run_id, topic_id, coherence): C_v over boolean sliding windows of `window` tokens of (doc, pos, token), for topics (run_id, topic_id, terms).

    Each topic word's vector of normalised pointwise mutual information with the topic's words is compared by cosine with the sum of all,
    and the cosines averaged. A document of n tokens has max(1, n - window + 1) windows. Only positions of topic words leave the scan;
    a pair's windows are counted from the spans in which its words stand, so no window is spelled out.
    """
    topics = topics.select("run_id", "topic_id", F.array_distinct("terms").alias("terms")).where(F.size("terms") > 0)
    words = topics.select(F.explode("terms").alias("token")).distinct()
    lengths = tokens.groupBy(doc).agg(F.max("pos").alias("_last"))
    windows = lengths.agg(F.sum(F.greatest(F.lit(1), F.col("_last") + 2 - window)).alias("_windows"))
    hits = tokens.join(words, "token").join(lengths, doc)
    # windows that hold a word at `pos` begin in [max(0, pos - window + 1), min(pos, starts - 1)]
    starts = F.greatest(F.lit(1), F.col("_last") + 2 - window)
    spans = hits.select(doc, "token", F.greatest(F.lit(0), F.least(F.col("pos") - window + 1, starts - 1)).alias("a"), F.least(F.col("pos"), starts - 1).alias("b"))
    per_word = spans.groupBy(doc, "token").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s"))
    merged = per_word.withColumn("s", F.expr("""aggregate(s, cast(array() as array<struct<a:int,b:int>>), (m, x) ->
        if(size(m) > 0 and x.a <= element_at(m, -1).b + 1, concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, x.b)))), concat(m, array(named_struct('a', x.a, 'b', x.b)))))"""))
    single = merged.groupBy("token").agg(F.sum(F.expr("aggregate(s, 0L, (n, x) -> n + x.b - x.a + 1)")).alias("n"))
    pairs = topics.select(F.explode("terms").alias("u"), "terms").select("u", F.explode("terms").alias("v")).where("u < v").distinct()
    left = merged.select(F.col(doc).alias("_d"), F.col("token").alias("u"), F.col("s").alias("su")).join(pairs, "u")
    both = left.join(merged.select(F.col(doc).alias("_d"), F.col("token").alias("v"), F.col("s").alias("sv")), ["_d", "v"])
    shared = F.expr("aggregate(su, 0L, (n, x) -> n + aggregate(sv, 0L, (k, y) -> k + greatest(0, least(x.b, y.b) - greatest(x.a, y.a) + 1)))")
    joint = both.groupBy("u", "v").agg(F.sum(shared).alias("n"))
    symmetric = joint.select("u", "v", "n").union(joint.select(F.col("v"), F.col("u"), "n")).union(single.select("token", "token", "n"))
    cells = topics.select("run_id", "topic_id", F.posexplode("terms").alias("i", "u"), "terms").select("run_id", "topic_id", "i", "u", F.posexplode("terms").alias("j", "v"))
    n = lambda side: single.select(F.col("token").alias(side), F.col("n").alias(f"_{side}"))
    filled = cells.join(symmetric, ["u", "v"], "left").join(n("u"), "u", "left").join(n("v"), "v", "left").join(F.broadcast(windows))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("_windows")
    known = (F.coalesce("_u", F.lit(0)) > 0) & (F.coalesce("_v", F.lit(0)) > 0)
    npmi = F.when(known, F.ln((share("n") + epsilon) / (share("_u") * share("_v"))) / -F.ln(share("n") + epsilon)).otherwise(0.0)
    npmi = F.when(share("n") >= 1, 1.0).otherwise(npmi)
    vectors = filled.withColumn("npmi", npmi).groupBy("run_id", "topic_id", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "npmi"))), lambda s: s.npmi).alias("w"))
    total = vectors.select("run_id", "topic_id", F.posexplode("w").alias("j", "x")).groupBy("run_id", "topic_id", "j").agg(F.sum("x").alias("x")).groupBy("run_id", "topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s.x).alias("t"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    cosine = F.coalesce(F.try_divide(dot(F.col("w"), F.col("t")), F.sqrt(dot(F.col("w"), F.col("w"))) * F.sqrt(dot(F.col("t"), F.col("t")))), F.lit(0.0))
    return vectors.join(total, ["run_id", "topic_id"]).groupBy("run_id", "topic_id").agg(F.avg(cosine).alias("coherence"))


def topic_selection(hits: DataFrame, panel: DataFrame, topics: DataFrame) -> DataFrame:
    """The panel (keys cik, session, year) for every topic, with 1 where the firm had an article with exposure to it that year, else 0. `topics` are few: the model's."""
    chosen = hits.select("cik", "session", "year", "topic_id").distinct().withColumn("selected", F.lit(1))
    ids = topics.select(F.sort_array(F.collect_set("topic_id")).alias("ids"))
    listed = ids.first()
    numbers = listed["ids"] if listed else []
    if not numbers:
        return panel.withColumn("topic_id", F.lit(None).cast("int")).withColumn("selected", F.lit(0)).limit(0)
    wide = panel.withColumn("topic_id", F.explode(F.array(*[F.lit(int(t)).cast("int") for t in numbers])))
    return wide.join(chosen, ["cik", "session", "year", "topic_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
