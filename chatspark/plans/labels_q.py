"""Labelling queries (L01-L14, J07) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicons import BASIC_EMOTIONS, EMOTION_TO_SENTIMENT, EMOTIONS, NEGATIVE_FLAGS, POSITIVE_FLAGS
from ..operators import labels as L
from ..sources.fixtures import Fixtures, duck_with
from . import duck as D
from .registry import query

_EMO_ARR = "[" + ", ".join(EMOTIONS) + "]"
_EMO_NAMES = "[" + ", ".join(D.q(e) for e in EMOTIONS) + "]"
_MAP_CASE = "CASE e " + " ".join(f"WHEN {D.q(k)} THEN {D.q(v)}" for k, v in EMOTION_TO_SENTIMENT.items()) + " ELSE 'neu' END"


@query("emotion_to_sentiment", "L01", duck_with("emotions_wide") + f"""
SELECT id, e AS emotion, {_MAP_CASE} AS sentiment FROM (
  SELECT id, CASE WHEN list_max({_EMO_ARR}) = 0 THEN 'Err'
    ELSE list_extract({_EMO_NAMES}, list_position({_EMO_ARR}, list_max({_EMO_ARR}))) END AS e FROM emotions_wide)""")
def emotion_to_sentiment(spark, sf_dir):
    w = Fixtures(spark, sf_dir).emotions_wide
    arr = F.array(*[F.col(c) for c in EMOTIONS])
    name = F.when(F.array_max(arr) == 0, F.lit("Err")).otherwise(
        F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), L.multihot_argmax(EMOTIONS) + 1))
    return w.select("id", name.alias("emotion")).withColumn("sentiment", L.emotion_to_sentiment("emotion"))


@query("collapse_multihot", "L04", duck_with("emotions_wide") + f"""
SELECT text, id, CASE WHEN p > n AND p > neutral THEN 'pos' WHEN n > p AND n > neutral THEN 'neg' ELSE 'neu' END AS sentiment
FROM (SELECT text, id, neutral, {' + '.join(POSITIVE_FLAGS)} AS p, {' + '.join(NEGATIVE_FLAGS)} AS n FROM emotions_wide)""")
def collapse_multihot(spark, sf_dir):
    return L.collapse_multihot(Fixtures(spark, sf_dir).emotions_wide)


@query("multihot_argmax", "L05", duck_with("emotions_wide") +
       f"SELECT id, CAST(list_position({_EMO_ARR}, list_max({_EMO_ARR})) - 1 AS INTEGER) AS emotion_idx FROM emotions_wide")
def multihot_argmax(spark, sf_dir):
    return Fixtures(spark, sf_dir).emotions_wide.select("id", L.multihot_argmax(EMOTIONS).alias("emotion_idx"))


_B_ARR = "[" + ", ".join(BASIC_EMOTIONS) + "]"


@query("basic_emotions", "L06", duck_with("emotions_wide") +
       f"SELECT id, list_extract([{', '.join(D.q(e) for e in BASIC_EMOTIONS)}], list_position({_B_ARR}, list_max({_B_ARR}))) AS emotion FROM emotions_wide")
def basic_emotions(spark, sf_dir):
    return Fixtures(spark, sf_dir).emotions_wide.select("id", L.basic_emotion().alias("emotion"))


_LEX_SCORE = """, ws AS (SELECT msg_id, lower(w) AS word FROM (SELECT msg_id, unnest(regexp_extract_all(content, '[\\p{L}\\p{N}_]+')) AS w FROM msgs)),
sc AS (SELECT ws.msg_id, sum(l.weight) AS s FROM ws JOIN lexicon l ON l.word = ws.word GROUP BY ws.msg_id),
scores AS (SELECT m.msg_id, CAST(coalesce(sc.s, 0) AS BIGINT) AS score FROM msgs m LEFT JOIN sc ON sc.msg_id = m.msg_id)
"""


@query("lexicon_score", "J07", duck_with("msgs", "lexicon") + _LEX_SCORE + "SELECT msg_id, score FROM scores")
def lexicon_score(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return L.lexicon_score(fx.msgs, fx.lexicon)


@query("label_sign", "L07", duck_with("msgs", "lexicon") + _LEX_SCORE +
       "SELECT msg_id, CASE WHEN score > 0 THEN 'pos' WHEN score < 0 THEN 'neg' ELSE 'neu' END AS label FROM scores")
def label_sign(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return L.lexicon_score(fx.msgs, fx.lexicon).select("msg_id", L.label_sign(F.col("score")).alias("label"))


@query("label_band", "L08", duck_with("msgs", "lexicon") + _LEX_SCORE + """
SELECT msg_id, round(c, 6) AS compound, CASE WHEN c > 0.05 THEN 'pos' WHEN c < -0.05 THEN 'neg' ELSE 'neu' END AS label
FROM (SELECT msg_id, CAST(score AS DOUBLE) / sqrt(CAST(score AS DOUBLE) * score + 15.0) AS c FROM scores)""")
def label_band(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    s = L.lexicon_score(fx.msgs, fx.lexicon).withColumn("c", L.normalized_compound(F.col("score")))
    return s.select("msg_id", F.round("c", 6).alias("compound"), L.label_band(F.col("c")).alias("label"))


@query("sentiment_to_id", "L02", duck_with("msgs") + """
SELECT msg_id, CASE sentiment WHEN 'neg' THEN 0 WHEN 'neu' THEN 1 WHEN 'pos' THEN 2 END AS sentiment_id,
  CASE sentiment WHEN 'neg' THEN 0 WHEN 'neu' THEN 1 WHEN 'pos' THEN 2 ELSE 0 END AS score FROM msgs""")
def sentiment_to_id(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs
    return m.select("msg_id", L.sentiment_to_id("sentiment").alias("sentiment_id"),
                    L.sentiment_to_id("sentiment", 0).alias("score"))


@query("id_to_label", "L03", duck_with("preds") +
       "SELECT msg_id, list_extract(['neg', 'neu', 'pos'], y_true + 1) AS label FROM preds")
def id_to_label(spark, sf_dir):
    return Fixtures(spark, sf_dir).preds.select("msg_id", L.id_to_label("y_true").alias("label"))


_SOFTMAX = """, lg AS (SELECT msg_id, a0 / 100.0 AS x0, a1 / 100.0 AS x1, a2 / 100.0 AS x2 FROM preds),
ex AS (SELECT msg_id, exp(x0 - greatest(x0, x1, x2)) AS e0, exp(x1 - greatest(x0, x1, x2)) AS e1, exp(x2 - greatest(x0, x1, x2)) AS e2 FROM lg),
pr AS (SELECT msg_id, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex),
am AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred, greatest(p0, p1, p2) AS pmax FROM pr)
"""


def _probs(spark, sf_dir, prefix="a"):
    p = Fixtures(spark, sf_dir).preds
    logits = F.array(*[F.col(f"{prefix}{i}") / F.lit(100.0) for i in range(3)])
    return p.select("msg_id", "y_true", L.softmax(logits).alias("probs"))


@query("softmax_argmax", "L12", duck_with("preds") + _SOFTMAX +
       "SELECT msg_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, pred FROM am")
def softmax_argmax(spark, sf_dir):
    pr = _probs(spark, sf_dir)
    return pr.select("msg_id", *[F.round(F.col("probs")[i], 6).alias(f"p{i}") for i in range(3)],
                     L.argmax(F.col("probs")).alias("pred"))


@query("label_low_confidence", "L09", duck_with("preds") + _SOFTMAX +
       "SELECT msg_id, CASE WHEN pmax < 0.5 THEN 'neu' ELSE list_extract(['neg', 'neu', 'pos'], pred + 1) END AS label FROM am")
def label_low_confidence(spark, sf_dir):
    return _probs(spark, sf_dir).select("msg_id", L.label_low_confidence(F.col("probs")).alias("label"))


@query("confidence_band", "L10", duck_with("preds") + _SOFTMAX +
       "SELECT msg_id, list_extract(['neg', 'neu', 'pos'], pred + 1) AS label, "
       "CASE WHEN pmax > 0.95 THEN 'ok' WHEN pmax > 0.75 THEN 'log' ELSE 'untrusted' END AS band FROM am")
def confidence_band(spark, sf_dir):
    pr = _probs(spark, sf_dir)
    return pr.select("msg_id", L.id_to_label(L.argmax(F.col("probs"))).alias("label"),
                     L.confidence_band(F.col("probs")).alias("band"))


def _vote_sql(normalize: bool) -> str:
    if normalize:
        m = ("CASE WHEN lower(label) IN ('pos', 'positive') THEN 'pos' WHEN lower(label) IN ('neg', 'negative') "
             "THEN 'neg' ELSE 'neu' END")
    else:
        m = "CASE WHEN lower(label) = 'positive' THEN 'pos' WHEN lower(label) = 'negative' THEN 'neg' ELSE 'neu' END"
    return duck_with("votes") + f"""
, v AS (SELECT msg_id, {m} AS label, chunk_id * 5 + labeler AS pos FROM votes),
c AS (SELECT msg_id, label, count(*) AS n, min(pos) AS f FROM v GROUP BY msg_id, label),
r AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY n DESC, f, label) AS rk FROM c)
SELECT msg_id, label, n AS votes FROM r WHERE rk = 1"""


@query("ensemble_vote", "L11", _vote_sql(True))
def ensemble_vote(spark, sf_dir):
    return L.ensemble_vote(Fixtures(spark, sf_dir).votes, normalize=True)


@query("ensemble_vote_literal", "L11", _vote_sql(False))
def ensemble_vote_literal(spark, sf_dir):
    return L.ensemble_vote(Fixtures(spark, sf_dir).votes, normalize=False)


@query("safe_label", "L13", duck_with("msgs_dirty") +
       "SELECT msg_id, CASE WHEN sentiment IN ('pos', 'neg', 'neu') THEN sentiment ELSE 'Err' END AS label FROM msgs_dirty")
def safe_label(spark, sf_dir):
    return Fixtures(spark, sf_dir).msgs_dirty.select("msg_id", L.safe_label("sentiment").alias("label"))


@query("remap_clamp_ids", "L14", duck_with("preds") +
       "SELECT msg_id, CAST((least(greatest(CAST(a0 // 100 AS BIGINT), 0), 2) + 1) // 2 AS INTEGER) AS y FROM preds")
def remap_clamp_ids(spark, sf_dir):
    p = Fixtures(spark, sf_dir).preds
    return p.select("msg_id", L.remap_clamp_ids(F.floor(F.col("a0") / 100)).alias("y"))


_CHUNKS = f"""
, ch AS (SELECT msg_id, chunk_id, chunk FROM (
  SELECT msg_id, CAST(i AS INTEGER) AS chunk_id, {D.py_strip('substring(content, i * 510 + 1, 510)')} AS chunk
  FROM (SELECT msg_id, content, unnest(range(greatest(length(content) - 1, 0) // 510 + 1)) AS i FROM msgs)) WHERE chunk <> ''),
cw AS (SELECT msg_id, chunk_id, lower(w) AS word FROM (SELECT msg_id, chunk_id, unnest(regexp_extract_all(chunk, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM ch)),
cs AS (SELECT ch.msg_id, ch.chunk_id, ch.chunk, coalesce(sum(l.weight), 0) AS s FROM ch LEFT JOIN cw ON cw.msg_id = ch.msg_id AND cw.chunk_id = ch.chunk_id
  LEFT JOIN lexicon l ON l.word = cw.word GROUP BY ch.msg_id, ch.chunk_id, ch.chunk),
votes3 AS (
  SELECT msg_id, chunk_id, 0 AS labeler, CASE WHEN s > 0 THEN 'pos' WHEN s < 0 THEN 'neg' ELSE 'neu' END AS label FROM cs
  UNION ALL SELECT msg_id, chunk_id, 1, CASE WHEN s / sqrt(s * s + 15.0) > 0.05 THEN 'pos' WHEN s / sqrt(s * s + 15.0) < -0.05 THEN 'neg' ELSE 'neu' END FROM cs
  UNION ALL SELECT msg_id, chunk_id, 2, CASE WHEN length(chunk) - length(replace(chunk, '!', '')) > length(chunk) - length(replace(chunk, '?', '')) THEN 'pos'
    WHEN length(chunk) - length(replace(chunk, '!', '')) < length(chunk) - length(replace(chunk, '?', '')) THEN 'neg' ELSE 'neu' END FROM cs),
c AS (SELECT msg_id, label, count(*) AS n, min(chunk_id * 3 + labeler) AS f FROM votes3 GROUP BY msg_id, label),
r AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY n DESC, f, label) AS rk FROM c)
SELECT msg_id, label, n AS votes FROM r WHERE rk = 1"""


def _raising(pdf):
    """A labeler that cannot stand a per cent sign."""
    bad = pdf["chunk"].str.contains("%", regex=False)
    if bad.any():
        raise ValueError("per cent")
    return ["pos" if len(c) % 2 else "neg" for c in pdf["chunk"]]


@query("isolated_labels", "L13", duck_with("msgs", "lexicon") + _CHUNKS.replace("{{", "{").replace("}}", "}").split(",\ncw AS")[0] + """
SELECT msg_id, chunk_id, CASE WHEN contains(chunk, '%') THEN 'Err' WHEN length(chunk) % 2 = 1 THEN 'pos' ELSE 'neg' END AS label,
  CASE WHEN contains(chunk, '%') THEN 'ValueError: per cent' END AS error FROM ch""")
def isolated_labels(spark, sf_dir):
    """Labels of a labeler that raises on some rows, and their rejects."""
    from ..operators.clean import chunk_text
    from ..streaming.streams import scratch
    path = scratch(spark, "l13")
    chunks = chunk_text(Fixtures(spark, sf_dir).msgs.select("msg_id", "content"))
    L.write_with_rejects(L.isolated_labeler(_raising)(chunks), f"{path}/labels", f"{path}/rejects")
    labels = spark.read.parquet(f"{path}/labels").drop("error")
    return labels.join(spark.read.parquet(f"{path}/rejects"), ["msg_id", "chunk_id"], "left")


@query("custom_labeler_vote", "F06", duck_with("msgs", "lexicon") + _CHUNKS.replace("{{", "{").replace("}}", "}"))
def custom_labeler_vote(spark, sf_dir):
    """Chunk every message (X05), run three pluggable labelers (two lexicon
    labelers and an Arrow-batched pandas labeler) and vote (L11)."""
    from ..operators.clean import chunk_text
    fx = Fixtures(spark, sf_dir)
    chunks = chunk_text(fx.msgs.select("msg_id", "content"))
    scores = L.chunk_scores(fx.lexicon)
    labelers = [L.lexicon_chunk_labeler(fx.lexicon, "sign", scores), L.lexicon_chunk_labeler(fx.lexicon, "band", scores),
                L.punctuation_labeler_pandas()]
    votes = L.run_labelers(chunks, labelers)
    return L.ensemble_vote(votes, normalize=True, n_labelers=3)
