"""Topic and term-weighting queries (W04-W06, M01, M02, M06, X19) with
DuckDB oracles; LDA/clustering queries (M03-M05, M07) are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicons import ENGLISH_STOP_WORDS
from ..operators import sets as S
from ..operators import lda as LD
from ..operators import topics as TP
from ..session import cut_lineage
from ..sources.fixtures import Fixtures, duck_with
from . import duck as D
from .registry import query
from .text_q import DUCK_TOPIC_WORDS

_TERMS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}')"
_STOP = ", ".join(D.q(w) for w in ENGLISH_STOP_WORDS)


@query("topk_topics_per_message", "W04", duck_with("topic_weights") + """
SELECT msg_id, uid, topic, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY w DESC, topic) AS rank
FROM topic_weights) WHERE rank <= 3""")
def topk_topics_per_message(spark, sf_dir):
    r = TP.topk_topics_per_message(Fixtures(spark, sf_dir).topic_weights, 3)
    return r.select("msg_id", "uid", "topic", "w", F.col("rank").cast("bigint"))


@query("topk_topics_per_user", "W05", duck_with("topic_weights") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY w DESC, topic) AS rk FROM topic_weights),
u AS (SELECT uid, topic, CAST(sum(w) AS BIGINT) AS weight FROM r WHERE rk <= 3 GROUP BY uid, topic)
SELECT uid, topic, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY weight DESC, topic) AS rank FROM u) WHERE rank <= 3""")
def topk_topics_per_user(spark, sf_dir):
    r = TP.topk_topics_per_user(Fixtures(spark, sf_dir).topic_weights, 3)
    return r.select("uid", "topic", "weight", F.col("rank").cast("bigint"))


@query("topk_words", "W06", duck_with("msgs") + f"""
, w AS ({DUCK_TOPIC_WORDS.replace('{{', '{').replace('}}', '}')}),
c AS (SELECT split_part(uid, '-', 1) AS lang, word, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10""")
def topk_words(spark, sf_dir):
    from ..functions import text as T
    m = Fixtures(spark, sf_dir).msgs
    words = m.select(F.split_part("uid", F.lit("-"), F.lit(1)).alias("lang"), F.explode(T.topic_terms("content")).alias("word"))
    return TP.topk_words(words, "lang", 10).select("lang", "word", "n", F.col("rank").cast("bigint"))


_SPLIT = """(SELECT msg_id, content, CASE WHEN u < 0.75 THEN 'train' ELSE 'test' END AS split FROM
  (SELECT msg_id, content, CAST(('0x' || substr(md5(CAST(msg_id AS VARCHAR) || '69'), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u FROM msgs))"""


@query("tfidf", "M01", duck_with("msgs") + f"""
, sp AS {_SPLIT},
dt AS (SELECT msg_id, split, term, count(*) AS tf FROM (SELECT msg_id, split, unnest({_TERMS}) AS term FROM sp) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM sp WHERE split = 'train'),
v AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM dt WHERE split = 'train' GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM v, n),
w AS (SELECT msg_id, dt.term, tf * idf AS w FROM dt JOIN idf ON idf.term = dt.term WHERE split = 'test'),
nr AS (SELECT msg_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY msg_id)
SELECT w.msg_id, term, round(w / nrm, 6) AS weight FROM w JOIN nr ON nr.msg_id = w.msg_id""")
def tfidf(spark, sf_dir):
    m = S.split_hash(Fixtures(spark, sf_dir).msgs.select("msg_id", "content"), train_ratio=0.75, val_ratio=0.0)
    train = m.filter(F.col("split") == "train")
    test = m.filter(F.col("split") != "train")
    r = TP.tfidf(train, test)
    return r.select("msg_id", "term", F.round("weight", 6).alias("weight"))


@query("doc_term_counts", "M02", duck_with("msgs") + f"""
, dt AS MATERIALIZED (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest({_TERMS}) AS term FROM msgs) GROUP BY ALL),
k AS (SELECT term FROM dt WHERE term NOT IN ({_STOP}) GROUP BY term
  HAVING count(*) >= (SELECT count(*) FROM msgs) * 0.1 AND count(*) <= (SELECT count(*) FROM msgs) * 0.9)
SELECT msg_id, term, tf FROM dt SEMI JOIN k ON k.term = dt.term""")
def doc_term_counts(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs
    return TP.doc_term_counts(m, stop_words=ENGLISH_STOP_WORDS).select("msg_id", "term", "tf")


@query("class_tfidf", "M06", duck_with("msgs") + f"""
, ct AS (SELECT cls, term, count(*) AS tf FROM (SELECT split_part(uid, '-', 1) AS cls,
    unnest(list_filter({_TERMS}, lambda t: t NOT IN ({_STOP}))) AS term FROM msgs) GROUP BY ALL),
pc AS (SELECT cls, sum(tf) AS words FROM ct GROUP BY cls), a AS (SELECT avg(words) AS a FROM pc),
ft AS (SELECT term, sum(tf) AS ft FROM ct GROUP BY term),
w AS (SELECT ct.cls, ct.term, ct.tf / pc.words * ln(1 + a.a / ft.ft) AS weight FROM ct JOIN pc ON pc.cls = ct.cls JOIN ft ON ft.term = ct.term, a)
SELECT cls, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY weight DESC, term) AS rank FROM w)
WHERE rank <= 10""")
def class_tfidf(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs.select(F.split_part("uid", F.lit("-"), F.lit(1)).alias("lang"), "content")
    r = TP.class_tfidf(m, "lang", stop_words=ENGLISH_STOP_WORDS)
    return r.select("cls", "term", F.round("weight", 6).alias("weight"), F.col("rank").cast("bigint"))


@query("parse_topic_terms", "X19", duck_with("topic_weights") + """
, s AS (SELECT msg_id, string_agg(CAST(w / 100.0 AS VARCHAR) || '*"t' || CAST(topic AS VARCHAR) || '"', ' + ' ORDER BY topic) AS s
  FROM topic_weights GROUP BY msg_id),
p AS (SELECT msg_id, unnest(string_split(s, ' + ')) AS part FROM s)
SELECT msg_id, CAST(split_part(part, '*', 1) AS DOUBLE) AS weight, replace(split_part(part, '*', 2), '"', '') AS word FROM p""")
def parse_topic_terms(spark, sf_dir):
    tw = Fixtures(spark, sf_dir).topic_weights
    # the printed "weight*"word"" list per message (8 topics, bounded)
    item = F.concat(F.format_string("%s", (F.col("w") / 100.0).cast("string")), F.lit('*"t'), F.col("topic").cast("string"), F.lit('"'))
    s = tw.groupBy("msg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic", item.alias("x")))),
                                                          lambda r: r["x"]), " + ").alias("s"))
    return s.select("msg_id", F.explode(TP.parse_topic_terms("s")).alias("r")).select("msg_id", "r.weight", "r.word")


# ------------------------------------------- iterative models (rows only)
def _batch_lda(spark, sf_dir):
    """Messages and the model of 10 topics, 10 iterations over all messages
    and all terms but the stop words; in each a message's weights are updated
    until they stand still, at most 100 times (as published)."""
    m = Fixtures(spark, sf_dir).msgs.select("msg_id", "uid", "content")
    counts = TP.doc_terms(m, stop_words=ENGLISH_STOP_WORDS)
    return m, LD.lda_batch(counts, k=10, iterations=10, bounds=False, e_steps=100)


@query("lda_topics", "M03")
def lda_topics(spark, sf_dir):
    return _batch_lda(spark, sf_dir)[1].top_terms(10)


@query("dominant_topic", "M04")
def dominant_topic(spark, sf_dir):
    m, model = _batch_lda(spark, sf_dir)
    return TP.dominant_topic(m.select("msg_id", "uid").join(model.distributions(), "msg_id"), col="topic_distribution")


def _embedding_vectors(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    e = Fixtures(spark, sf_dir).embeddings
    return e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("cluster_topics", "M05")
def cluster_topics(spark, sf_dir):
    _, assigned = TP.cluster_topics(_embedding_vectors(spark, sf_dir), k=5)
    return assigned.select("vec_id", "topic")


#: topics left after merging (the published number)
NR_TOPICS = 5


@query("topic_info", "M07")
def topic_info(spark, sf_dir):
    """The topics of the messages, the smallest merged into the nearest until
    NR_TOPICS are left."""
    from ..operators.labels import argmax
    _, model = _batch_lda(spark, sf_dir)
    assigned = cut_lineage(model.distributions().select(argmax(F.col("topic_distribution")).alias("topic")))
    return LD.merged_info(model, assigned, NR_TOPICS)


@query("reduced_topics", "M07")
def reduced_topics(spark, sf_dir):
    """The labels of the embeddings as topics, merged until half are left."""
    e = Fixtures(spark, sf_dir).embeddings.select(F.col("label").alias("topic"), F.posexplode("embedding").alias("i", "x"))
    cells = e.groupBy("topic", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("count"))
    vectors = cells.groupBy("topic").agg(F.max("count").alias("count"), F.transform(
        F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vector"))
    n = vectors.count()
    return LD.reduce_topics(vectors.select("topic", "vector"), n // 2, vectors.select("topic", "count"))
