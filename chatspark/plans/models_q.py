"""Spark ML queries (M08-M22). Model outputs are rows-only checks; the
SQL-expressible scalers (M09, M11) have DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import EMOTIONS
from ..operators import features as FT
from ..operators import joins as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import sets as S
from ..session import cut_lineage
from ..sources.fixtures import Fixtures
from .features_q import duck_user_features
from .registry import query

_FEATS = FT.VECTOR_FEATURES


def _users(spark, sf_dir) -> DataFrame:
    """The user vectors, written once: scalers and projections read them for
    their statistics and again for the result."""
    fx = Fixtures(spark, sf_dir)
    return cut_lineage(FT.user_features(fx.msgs, pos_lexicon=fx.pos_lexicon))


def _users_sql() -> str:
    body = duck_user_features(_FEATS)
    head, last = body.rsplit("\n", 1)
    return head + "\n, uv AS (" + last + ")\n"


@query("standard_scale", "M09", _users_sql() + ", st AS (SELECT " +
       ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _FEATS) + " FROM uv)\nSELECT uid, " +
       ", ".join(f"round(coalesce(({c} - m_{c}) / NULLIF(s_{c}, 0), 0.0), 6) AS {c}" for c in _FEATS) + " FROM uv, st")
def standard_scale(spark, sf_dir):
    s = MD.standard_scale(_users(spark, sf_dir).drop("n_msgs"), _FEATS)
    return s.select("uid", *[F.round(c, 6).alias(c) for c in _FEATS])


_TRAIN_U = "CAST(('0x' || substr(md5(uid || '69'), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 < 0.75"


@query("maxabs_scale", "M11", _users_sql() + ", mx AS (SELECT " +
       ", ".join(f"max(abs({c})) AS a_{c}" for c in _FEATS) + f" FROM uv WHERE {_TRAIN_U})\nSELECT uid, " +
       ", ".join(f"round(coalesce({c} / NULLIF(a_{c}, 0), {c}), 6) AS {c}" for c in _FEATS) + " FROM uv, mx")
def maxabs_scale(spark, sf_dir):
    u = _users(spark, sf_dir).drop("n_msgs")
    train = S.split_hash(u, key="uid", train_ratio=0.75, val_ratio=0.0).filter(F.col("split") == "train").drop("split")
    s = MD.maxabs_scale(train, u, _FEATS)
    return s.select("uid", *[F.round(c, 6).alias(c) for c in _FEATS])


@query("pca_users", "M08")
def pca_users(spark, sf_dir):
    return MD.pca_scores(_users(spark, sf_dir), _FEATS, k=5).select("uid", "pca")


@query("project_2d", "M10")
def project_2d(spark, sf_dir):
    p = MD.pca_scores(_users(spark, sf_dir), _FEATS, k=2)
    return p.select("uid", F.col("pca")[0].alias("x"), F.col("pca")[1].alias("y"))


# ---------------------------------------------------- classic text models
def _emotion_data(spark, sf_dir) -> DataFrame:
    """Emotion-table text with the argmax emotion as a 28-class label and
    balanced class weights (M12)."""
    w = Fixtures(spark, sf_dir).emotions_wide
    d = w.select(F.col("id").alias("msg_id"), F.col("text").alias("content"),
                 L.multihot_argmax(EMOTIONS).cast("double").alias("label"))
    d = M.balanced_weights(d, "label")
    return S.split_hash(d, train_ratio=0.75, val_ratio=0.0)


#: the reference's own vocabulary sizes
_MAX_FEATURES = {"tree": 300_000, "forest": 99_999, "svm": 300_000}


def _fit_text_model(spark, sf_dir, kind: str):
    from pyspark.ml import Pipeline
    d = MD.text_features(_emotion_data(spark, sf_dir))
    stages = MD.maxabs_tfidf_stages if kind == "forest" else MD.tfidf_stages
    feats = Pipeline(stages=stages(_MAX_FEATURES[kind], out="features")).fit(d.filter("split = 'train'"))
    v = feats.transform(d).select("msg_id", "label", "weight", "split", "features")
    train, test = v.filter("split = 'train'"), v.filter("split <> 'train'")
    model = MD.train_classifier(train, kind, weight="weight", numTrees=150, maxDepth=30)
    return model.transform(test).select("msg_id", "label", F.col("prediction"))


@query("train_decision_tree", "M13")
def train_decision_tree(spark, sf_dir):
    return _fit_text_model(spark, sf_dir, "tree")


@query("train_random_forest", "M14")
def train_random_forest(spark, sf_dir):
    return _fit_text_model(spark, sf_dir, "forest")


@query("train_linear_svm_ovr", "M15")
def train_linear_svm_ovr(spark, sf_dir):
    """Fitted on the training split's max-abs scaled TF-IDF vectors, with the
    published C, tolerance and rounds; predicts the other rows."""
    from ..operators import svm
    from ..operators.vectors import scaled_tfidf
    d = _emotion_data(spark, sf_dir).withColumn("is_train", F.col("split") == "train")
    vectors, index = scaled_tfidf(d, "is_train", max_features=_MAX_FEATURES["svm"])
    vectors = cut_lineage(vectors)
    model = svm.fit_linear_svm(vectors.filter("is_train"), index.count(), C=0.9, tol=1e-4, max_iter=1500)
    return model.predict(vectors.filter("not is_train")).select("msg_id", "label", "prediction")


# ---------------------------------------------- sentiment models
def sentiment_data(spark, sf_dir, with_user: bool = False) -> DataFrame:
    """Labelled messages (P05) with label ids (L02), hash split (W08) and,
    optionally, the user vector attached (J02, zeros for small users)."""
    fx = Fixtures(spark, sf_dir)
    m = fx.msgs.filter(F.col("sentiment").isin("pos", "neg", "neu"))
    m = m.withColumn("label", L.sentiment_to_id("sentiment").cast("double"))
    if with_user:
        m = J.attach_user_vector(m, _users(spark, sf_dir), _FEATS)
    m = S.split_hash(m, train_ratio=0.75, val_ratio=0.1)
    return MD.text_features(m)


def fit_sentiment(spark, sf_dir, with_user: bool = False):
    d = sentiment_data(spark, sf_dir, with_user)
    return MD.fit_logreg(d.filter("split = 'train'"), _FEATS if with_user else None), d


@query("train_baseline", "M17")
def train_baseline(spark, sf_dir):
    model, d = fit_sentiment(spark, sf_dir, False)
    return MD.batch_predict(model, d.filter("split = 'test'")).select("msg_id", "pred", "label")


@query("train_user_conditioned", "M18")
def train_user_conditioned(spark, sf_dir):
    model, d = fit_sentiment(spark, sf_dir, True)
    return MD.batch_predict(model, d.filter("split = 'test'")).select("msg_id", "pred", "label")


@query("batch_predict", "M19")
def batch_predict(spark, sf_dir):
    """Fitted on the labelled training split; scores every message, labelled
    or not."""
    model, _ = fit_sentiment(spark, sf_dir, False)
    out = MD.batch_predict(model, MD.text_features(Fixtures(spark, sf_dir).msgs))
    return out.select("msg_id", "pred", "label", *[F.round(F.col("probs")[i], 6).alias(f"p{i}") for i in range(3)])


@query("token_contributions", "M20")
def token_contributions(spark, sf_dir):
    model, d = fit_sentiment(spark, sf_dir, False)
    return MD.token_contributions(model, d.filter("split = 'test'").select("msg_id", "content"), top_k=10)


def _scored(model, d: DataFrame) -> DataFrame:
    p = MD.batch_predict(model, d)
    return p.join(d.select("msg_id", F.col("label").cast("int").alias("y_true")), "msg_id").select(
        "msg_id", "y_true", *[F.col("probs")[i].alias(f"p{i}") for i in range(3)], "pred")


@query("compare_models", "M21")
def compare_models(spark, sf_dir):
    """Baseline (text only) against the user-conditioned model on the same
    test rows: each metric (A26-A30) with verdict and p (A31, A34)."""
    base, d0 = fit_sentiment(spark, sf_dir, False)
    cand, d1 = fit_sentiment(spark, sf_dir, True)
    # scored once: each feeds five metrics and the paired tests
    a, b = (cut_lineage(_scored(m, d.filter("split = 'test'"))) for m, d in ((base, d0), (cand, d1)))
    return M.compared(a, b)


@query("grid_search", "M16")
def grid_search(spark, sf_dir):
    d = sentiment_data(spark, sf_dir).filter("split <> 'test'")
    _, rows = MD.grid_search(d)
    return spark.createDataFrame(rows, "reg_param double, max_iter int, accuracy double")


@query("select_best_model", "M22")
def select_best_model(spark, sf_dir):
    """Evaluate the baseline at growing iteration budgets (epochs) on the
    validation rows; keep the best, stop after 2 steps without gain."""
    d = sentiment_data(spark, sf_dir)
    train, val = d.filter("split = 'train'"), d.filter("split = 'val'")
    budgets = [2, 5, 10, 20, 40]
    found = MD.accuracy_by_steps(train, val, budgets)
    rows = [(step, iters, v) for step, (iters, v) in enumerate(zip(budgets, found))]
    metrics = spark.createDataFrame(rows, "step int, max_iter int, accuracy double")
    return MD.select_best(metrics)
