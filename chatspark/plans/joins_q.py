"""Join, set and split queries (J01-J06, U01, U04, W07-W09) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import joins as J
from ..operators import sets as S
from ..sources.fixtures import Fixtures, duck_with
from .features_q import duck_user_features
from .registry import query


@query("merge_user_aliases", "J01", duck_with("msgs", "alias") +
       "SELECT m.msg_id, coalesce(a.canonical, m.uid) AS uid FROM msgs m LEFT JOIN alias a ON a.uid = m.uid")
def merge_user_aliases(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return J.merge_user_aliases(fx.msgs, fx.alias).select("msg_id", "uid")


_FEATS = FT.VECTOR_FEATURES


def _users_cte() -> str:
    body = duck_user_features(_FEATS)
    return body


@query("attach_user_vector", "J02", _users_cte().replace("SELECT * FROM (SELECT u.uid", "SELECT * FROM (SELECT u.uid", 1)
       .rsplit("\n", 1)[0] + "\n, uv AS (" + _users_cte().rsplit("\n", 1)[1] + ")\n"
       "SELECT msgs.msg_id, msgs.uid, " + ", ".join(f"coalesce(CAST(uv.{c} AS DOUBLE), 0.0) AS {c}" for c in _FEATS) +
       " FROM msgs LEFT JOIN uv ON uv.uid = msgs.uid")
def attach_user_vector(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    users = FT.user_features(fx.msgs, pos_lexicon=fx.pos_lexicon)
    return J.attach_user_vector(fx.msgs.select("msg_id", "uid"), users, _FEATS)


@query("messages_with_vector", "J03", _users_cte().rsplit("\n", 1)[0] + "\n, uv AS (" + _users_cte().rsplit("\n", 1)[1] +
       ")\nSELECT msg_id FROM msgs WHERE uid IN (SELECT uid FROM uv)")
def messages_with_vector(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    users = FT.user_features(fx.msgs, pos_lexicon=fx.pos_lexicon)
    return J.messages_with_vector(fx.msgs, users).select("msg_id")


@query("aligned_mismatches", "J04", duck_with("msgs_dirty") + """
SELECT * FROM (
  SELECT m.msg_id, 'content' AS "column", m.content AS source_value, d.content AS target_value FROM msgs m JOIN msgs_dirty d ON d.msg_id = m.msg_id WHERE m.content IS DISTINCT FROM d.content
  UNION ALL SELECT m.msg_id, 'sentiment', m.sentiment, d.sentiment FROM msgs m JOIN msgs_dirty d ON d.msg_id = m.msg_id WHERE m.sentiment IS DISTINCT FROM d.sentiment
  UNION ALL SELECT m.msg_id, 'uid', m.uid, d.uid FROM msgs m JOIN msgs_dirty d ON d.msg_id = m.msg_id WHERE m.uid IS DISTINCT FROM d.uid)""")
def aligned_mismatches(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return J.aligned_mismatches(fx.msgs, fx.msgs_dirty)


@query("resume_remaining", "J05", duck_with("msgs") +
       "SELECT msg_id FROM msgs WHERE msg_id NOT IN (SELECT msg_id FROM msgs WHERE sentiment IS NOT NULL)")
def resume_remaining(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs
    return J.resume_remaining(m.select("msg_id"), m.select("msg_id", F.col("sentiment").alias("label")))


@query("paired_predictions", "J06", duck_with("preds") + """
SELECT msg_id, y_true, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS pred_a,
  CASE WHEN b0 >= b1 AND b0 >= b2 THEN 0 WHEN b1 >= b2 THEN 1 ELSE 2 END AS pred_b FROM preds""")
def paired_predictions(spark, sf_dir):
    from ..operators.labels import argmax
    p = Fixtures(spark, sf_dir).preds
    truth = p.select("msg_id", "y_true")
    a = p.select("msg_id", argmax(F.array("a0", "a1", "a2")).alias("pred_a"))
    b = p.select("msg_id", argmax(F.array("b0", "b1", "b2")).alias("pred_b"))
    return J.paired_predictions(truth, a, b)


@query("union_datasets", "U01", duck_with("msgs") + """
SELECT msg_id, uid, sentiment FROM msgs
UNION ALL SELECT conv_id * 1000 + turn AS msg_id, role AS uid, NULL AS sentiment FROM conversations""")
def union_datasets(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    conv = fx.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("role").alias("uid"))
    return S.union_datasets(fx.msgs.select("msg_id", "uid", "sentiment"), conv)


@query("distinct_users", "U04", duck_with("msgs") + "SELECT DISTINCT uid FROM msgs")
def distinct_users(spark, sf_dir):
    return S.distinct_values(Fixtures(spark, sf_dir).msgs, "uid")


_SPLIT = """, r AS (SELECT msg_id, row_number() OVER (ORDER BY md5(CAST(msg_id AS VARCHAR) || '69'), msg_id) - 1 AS idx,
  count(*) OVER () AS n FROM msgs),
s AS (SELECT *, CAST(floor(n * 0.75) AS BIGINT) AS n_train FROM r),
t AS (SELECT *, CAST(floor((n - n_train) * (0.1 / (1 - (0.75 + 0.1)))) AS BIGINT) AS n_val FROM s)
"""


@query("split_exact", "W07", duck_with("msgs") + _SPLIT +
       "SELECT msg_id, CASE WHEN idx < n_train THEN 'train' WHEN idx < n_train + n_val THEN 'val' ELSE 'test' END AS split FROM t")
def split_exact(spark, sf_dir):
    return S.split_exact(Fixtures(spark, sf_dir).msgs.select("msg_id")).select("msg_id", "split")


@query("split_test_size", "W07", duck_with("msgs") + _SPLIT +
       "SELECT msg_id, CASE WHEN idx < (SELECT count(*) - ceil(count(*) * 0.15) FROM msgs) THEN 'train' ELSE 'test' END AS split FROM t")
def split_test_size(spark, sf_dir):
    return S.split_test_size(Fixtures(spark, sf_dir).msgs.select("msg_id"), 0.15).select("msg_id", "split")


@query("split_hash", "W08", duck_with("msgs") + """
SELECT msg_id, CASE WHEN u < 0.75 THEN 'train' WHEN u < 0.75 + (1 - 0.75) * (0.1 / (1 - (0.75 + 0.1))) THEN 'val' ELSE 'test' END AS split
FROM (SELECT msg_id, CAST(('0x' || substr(md5(CAST(msg_id AS VARCHAR) || '69'), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u FROM msgs)""")
def split_hash(spark, sf_dir):
    return S.split_hash(Fixtures(spark, sf_dir).msgs.select("msg_id")).select("msg_id", "split")


@query("shuffle_rows", "W09", duck_with("msgs") +
       "SELECT msg_id, row_number() OVER (ORDER BY md5(CAST(msg_id AS VARCHAR) || '69'), msg_id) - 1 AS pos FROM msgs")
def shuffle_rows(spark, sf_dir):
    return S.shuffle_rows(Fixtures(spark, sf_dir).msgs.select("msg_id")).select("msg_id", "pos")


@query("union_user_matrices", "U02", duck_user_features(_FEATS))
def union_user_matrices(spark, sf_dir):
    """Stack the vectors of two user groups (English / other sources)."""
    fx = Fixtures(spark, sf_dir)
    users = FT.user_features(fx.msgs, pos_lexicon=fx.pos_lexicon)
    en = users.filter(F.col("uid").startswith("en-"))
    other = users.filter(~F.col("uid").startswith("en-"))
    return S.union_datasets(en, other)


@query("shared_columns", "U03", duck_with("msgs", "msgs_dirty") + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM msgs) AS n_left, (SELECT count({c}) FROM msgs_dirty) AS n_right"
    for c in ("uid", "content", "sentiment")))
def shared_columns(spark, sf_dir):
    """The columns two tables share, minus one name, with the values they
    hold in either."""
    fx = Fixtures(spark, sf_dir)
    return S.shared_column_profile(fx.msgs, fx.msgs_dirty, minus=("msg_id",))
