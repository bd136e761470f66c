"""Words, topics and term weighting.

Term statistics are long tables ``(doc, term, count)`` built with one
explode and one ``groupBy`` (map-side combine). A fitted vocabulary has all
terms unless the caller bounds it; it is joined with hot terms apart
(:func:`~chatspark.operators.joins.split_join`). Top-k per group uses pre-aggregated, bounded groups
(or the salted two-stage ranking for unbounded ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .joins import split_join
from .ordered import top_k_per_group

# \b\w\w+\b on lower-cased text: runs of two or more Unicode word characters
TERM_RUN = T.WORD_CHAR + "{2,}"

#: vocabSize of a vectorizer that keeps all terms
ALL_TERMS = 2**31 - 1


def terms(col: Column | str, stop_words: list[str] | None = None) -> Column:
    """Vectorizer tokens: lower case, 2+ word characters, optional stop words."""
    c = F.col(col) if isinstance(col, str) else col
    toks = F.regexp_extract_all(F.lower(c), F.lit(TERM_RUN), 0)
    if stop_words:
        toks = F.filter(toks, lambda w: ~w.isin(*stop_words))
    return toks


def exploded_terms(docs: DataFrame, cols: list, text: str = "content",
                   stop_words: list[str] | None = None) -> DataFrame:
    """One row per term occurrence; stop words are removed after the
    explode with a plain IN filter (compiled, no lambda per array)."""
    out = docs.select(*cols, F.explode(terms(text)).alias("term"))
    return out.filter(~F.col("term").isin(*stop_words)) if stop_words else out


def doc_terms(docs: DataFrame, key: str = "msg_id", text: str = "content",
              stop_words: list[str] | None = None) -> DataFrame:
    """(key, term, tf): term counts per document."""
    return (exploded_terms(docs, [key], text, stop_words)
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


def word_frequencies(msgs: DataFrame, k: int = 50) -> DataFrame:
    """The most frequent topic words (data behind the word cloud).
    ``orderBy().limit()`` plans as a per-partition top-k then a merge."""
    counts = (msgs.select(F.explode(T.topic_terms("content")).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    return counts.orderBy(F.desc("n"), F.asc("word")).limit(k)


def topk_topics_per_message(weights: DataFrame, k: int = 3, key: str = "msg_id") -> DataFrame:
    """Top-k topics by weight per message (ties: lower topic id)."""
    return top_k_per_group(weights, [key], [F.desc("w"), F.asc("topic")], k, rank_col="rank")


def user_topic_weights(weights: DataFrame, k: int = 3) -> DataFrame:
    """Keep each message's top-k topics, sum their weights per user."""
    top = topk_topics_per_message(weights, k)
    return top.groupBy("uid", "topic").agg(F.sum("w").cast("long").alias("weight"))


def topk_topics_per_user(weights: DataFrame, k: int = 3) -> DataFrame:
    """Top-k topics of a user by summed weight."""
    per_user = user_topic_weights(weights, k)
    return top_k_per_group(per_user, ["uid"], [F.desc("weight"), F.asc("topic")], k, rank_col="rank")


def topk_words(words: DataFrame, group: str, k: int = 10, salt_buckets: int = 8) -> DataFrame:
    """Top-k words per group by count. Counts are per (group, word);
    a group's vocabulary is unbounded, so ranking is salted two-stage."""
    counts = words.groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(counts, [group], [F.desc("n"), F.asc("word")], k, rank_col="rank",
                           salt_buckets=salt_buckets)


def fit_vocabulary(train_terms: DataFrame, max_features: int | None = None, key: str = "msg_id") -> DataFrame:
    """(term, df, cnt) of the training corpus; ``max_features`` keeps the
    most frequent terms (ties: term order)."""
    v = train_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cnt"))
    if max_features:
        v = v.orderBy(F.desc("cnt"), F.asc("term")).limit(max_features)
    return v


def tfidf(train: DataFrame, test: DataFrame, key: str = "msg_id", text: str = "content",
          max_features: int | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """Fit on ``train``, transform ``test`` -> (key, term, weight) with
    idf = ln((1+n)/(1+df)) + 1, raw tf, L2-normalised per document."""
    tr = doc_terms(train, key, text, stop_words)
    n = train.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    vocab = fit_vocabulary(tr, max_features)
    idf = _with_total(vocab, n)
    idf = idf.select("term", "df", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    te = doc_terms(test, key, text, stop_words)
    w = split_join(te, idf, "term", "df").withColumn("w", F.col("tf") * F.col("idf"))
    # L2 norm per document with a window over the document's own terms
    # (bounded by its distinct terms): no self-join, one pass over the text
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def _with_total(df: DataFrame, one_row: DataFrame) -> DataFrame:
    from .scalars import attach_one_row
    return attach_one_row(df, one_row)


def doc_term_counts(docs: DataFrame, key: str = "msg_id", text: str = "content", min_df: float = 0.1,
                    max_df: float = 0.9, stop_words: list[str] | None = None) -> DataFrame:
    """Bag of words restricted to terms in [min_df, max_df] of the
    documents -> (key, term, tf)."""
    # written once: counted and filtered from one pass over the texts
    dt = cut_lineage(doc_terms(docs, key, text, stop_words))
    n = docs.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    dfs = _with_total(dt.groupBy("term").agg(F.count(F.lit(1)).alias("_df")), n)
    keep = dfs.filter((F.col("_df") >= F.col("_n") * min_df) & (F.col("_df") <= F.col("_n") * max_df)).select("term")
    # a term of at least min_df of the documents: no more of them than the mean
    # number of distinct terms a document has, over min_df
    return dt.join(F.broadcast(keep) if min_df > 0 else keep, "term", "left_semi")


def class_tfidf(docs: DataFrame, cls: str, text: str = "content", top_n: int = 10,
                stop_words: list[str] | None = None) -> DataFrame:
    """Class-based TF-IDF (published BERTopic weighting): per class the
    L1-normalised term frequency times ln(1 + A / f(t)), A = mean words per
    class, f(t) = frequency of t over all classes; top terms per class."""
    ct = (exploded_terms(docs, [F.col(cls).alias("cls")], text, stop_words)
          .groupBy("cls", "term").agg(F.count(F.lit(1)).alias("tf")))
    # the (class, term) counts feed three branches: write them once to the
    # shared checkpoint folder instead of re-reading the text three times
    ct = cut_lineage(ct)
    per_class = ct.groupBy("cls").agg(F.sum("tf").alias("_words"))
    avg_words = per_class.agg(F.avg("_words").alias("_A"))
    ft = ct.groupBy("term").agg(F.sum("tf").alias("_ft"))
    w = (ct.join(per_class, "cls").join(ft, "term"))
    w = _with_total(w, avg_words).select(
        "cls", "term", (F.col("tf") / F.col("_words") * F.ln(1 + F.col("_A") / F.col("_ft"))).alias("weight"))
    return top_k_per_group(w, ["cls"], [F.desc("weight"), F.asc("term")], top_n, rank_col="rank", salt_buckets=8)


# ---------------------------------------------------------------- Spark ML
def lda_topics(docs: DataFrame, k: int = 10, vocab_size: int | None = None, max_iter: int = 10, seed: int = 69,
               key: str = "msg_id", text: str = "content", stop_words: list[str] | None = None, top_terms: int = 10):
    """LDA over counts of all terms, or of the ``vocab_size`` most
    frequent ones. Returns (model pipeline, transformed docs,
    topics table (topic, rank, term, weight))."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    d = docs.select(key, *[c for c in docs.columns if c not in (key, text)], terms(text, stop_words).alias("_terms"))
    cv = CountVectorizer(inputCol="_terms", outputCol="features", vocabSize=vocab_size or ALL_TERMS, minDF=1.0)
    lda = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="features", topicDistributionCol="topicDistribution")
    model = Pipeline(stages=[cv, lda]).fit(d)
    vocab = model.stages[0].vocabulary
    topics = model.stages[1].describeTopics(top_terms)
    spark = docs.sparkSession
    vocab_df = spark.createDataFrame([(i, t) for i, t in enumerate(vocab)], "idx int, term string")
    long = (topics.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "z"))
            .select("topic", "rank", F.col("z.termIndices").alias("idx"), F.col("z.termWeights").alias("weight")))
    topic_terms = F.broadcast(long).join(vocab_df, "idx").drop("idx")
    return model, model.transform(d), topic_terms


def dominant_topic(transformed: DataFrame, uid: str = "uid", col: str = "topicDistribution") -> DataFrame:
    """M04 (``col``: an ML vector or an array of shares): argmax of the mean topic distribution of a user's messages.
    One global model; per-(user, topic) means; bounded top-1 per user."""
    from pyspark.ml.functions import vector_to_array
    shares = F.col(col) if dict(transformed.dtypes)[col].startswith("array") else vector_to_array(col)
    dist = transformed.select(uid, F.posexplode(shares).alias("topic", "p"))
    means = dist.groupBy(uid, "topic").agg(F.avg("p").alias("mean_p"))
    return top_k_per_group(means, [uid], [F.desc("mean_p"), F.asc("topic")], 1)


def cluster_topics(vectors: DataFrame, col: str = "features", k: int = 5, dims: int = 5, seed: int = 69):
    """M05 (re-aimed embed -> reduce -> cluster): PCA to ``dims`` then
    k-means. Returns (model, assignments with ``topic``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA

    pca = PCA(k=dims, inputCol=col, outputCol="_reduced")
    km = KMeans(k=k, seed=seed, featuresCol="_reduced", predictionCol="topic")
    model = Pipeline(stages=[pca, km]).fit(vectors)
    return model, model.transform(vectors)


def topic_info(assigned: DataFrame, topic_terms: DataFrame | None = None, n_name_terms: int = 4) -> DataFrame:
    """Rows per topic, with a name from its top terms."""
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    if topic_terms is None:
        return counts.withColumn("name", F.concat_ws("_", F.col("topic").cast("string")))
    top = topic_terms.filter(F.col("rank") < n_name_terms)
    names = top.groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), "_").alias("_t"))
    return (counts.join(names, "topic", "left")
            .withColumn("name", F.concat_ws("_", F.col("topic").cast("string"), F.col("_t"))).drop("_t"))


def parse_topic_terms(col: Column | str) -> Column:
    """``"0.1*\\"w\\" + 0.05*\\"v\\""`` -> array<struct<weight, word>>."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, r" \+ ")
    return F.transform(parts, lambda p: F.struct(
        F.split(p, r"\*")[0].cast("double").alias("weight"),
        F.regexp_replace(F.split(p, r"\*")[1], '"', "").alias("word")))
