"""The text models' regression: Spark ML's coefficients and predictions, without its driver."""

import random

import numpy as np
from pyspark.sql import functions as F

from chatspark.operators import logreg as LR
from chatspark.operators import models as MD
from chatspark.plans.registry import load_all
from chatspark.sources import sinks as K

SF = "/root/testdata/sf0.001"


def _docs(spark, n=120):
    rnd = random.Random(5)
    rows = [(i, " ".join([rnd.choice(["good", "bad", "so", "so"][i % 3:][:2]) for _ in range(5)]
                         + [f"w{rnd.randrange(40)}" for _ in range(8)]), float(i % 3), rnd.random() * (i % 3), 7.0) for i in range(n)]
    return MD.text_features(spark.createDataFrame(rows, "msg_id long, content string, label double, u double, v double"))


def test_equals_spark_ml(spark):
    d = _docs(spark)
    for extra in (None, ["u", "v"]):
        want = MD.batch_predict(MD.text_pipeline(extra_cols=extra, max_iter=100).fit(d), d).collect()
        model = MD.fit_logreg(d, extra, max_iter=100)
        got = {r["msg_id"]: r for r in MD.batch_predict(model, d).collect()}
        assert len(got) == len(want) == 120
        for r in want:
            assert max(abs(a - b) for a, b in zip(r["probs"], got[r["msg_id"]]["probs"])) < 5e-3
    explained = [{(r["cls"], r["term"]): r["mean_abs"] for r in MD.token_contributions(m, d, top_k=5).collect()}
                 for m in (MD.text_pipeline(max_iter=100).fit(d), MD.fit_logreg(d, max_iter=100))]
    assert len(explained[1]) == 15
    assert max(abs(explained[0][c] - explained[1][c]) for c in explained[0].keys() & explained[1].keys()) < 5e-3


def test_no_vocabulary_on_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    def fit(self, d):
        raise AssertionError("a vocabulary was fitted on the driver")

    monkeypatch.setattr(CountVectorizer, "_fit", fit)
    assert load_all()["train_baseline"].build(spark, SF).count() > 0


def test_steps_of_a_longer_fit_and_repeated_or_null_keys(spark, tmp_path):
    d = _docs(spark, 60).withColumn("msg_id", F.when(F.col("msg_id") > 50, F.col("msg_id") % 3))
    d = d.unionByName(d.filter("label = 1"))
    data = LR.TermBlocks(d, "label", [])
    both = LR.fit_steps(data, 0.01, [3, 20])
    assert abs(both[0][0] - LR.fit_steps(data, 0.01, [3])[0][0]).max() < 1e-12
    scores = data.accuracies(both, d)
    assert scores == [m.transform(d).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
                      for m in data.models(both)]
    K.save_model(data.models(both)[1], str(tmp_path))
    assert MD.batch_predict(K.load_model(str(tmp_path)), d).count() == d.count() == 80


def test_margins_in_pieces_and_no_number_of_the_last_class(spark, monkeypatch):
    monkeypatch.setattr(LR, "PIECE", 7)
    d = _docs(spark, 30)
    data = LR.TermBlocks(d, "label", ["u"])
    assert data.blocks.schema["x"].dataType.typeName() == "binary"
    assert data.blocks.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    dense = np.zeros((30, 0))
    for terms, _, _, mean, scale, at, row, x in LR._matrices(data.blocks.toArrow().to_batches()):
        cells = np.zeros((30, len(terms)))
        cells[row, at] = x
        dense = np.concatenate([dense, (cells - mean) * scale], axis=1)
    r = np.random.default_rng(1).normal(size=(30, 2))
    assert abs(data.margins(r) - dense @ (dense.T @ r)).max() < 1e-9
    assert [a.shape for a, _ in LR.fit_steps(data, 0.01, [2, 15])] == [(30, 2), (30, 2)]


def test_steps_of_the_history_are_files(tmp_path):
    rng = np.random.default_rng(2)
    step = (rng.normal(size=(9, 2)), rng.normal(size=(9, 2)), rng.normal(size=3))
    pair = LR._Pair(str(tmp_path / "0.npy"), step, tuple(2 * v for v in step))
    whole = [np.concatenate([v, -v.sum(axis=1, keepdims=True)], axis=1) for v in step[:2]]
    curve = 2 * ((whole[0] * whole[1]).sum() + step[2] @ step[2])
    assert (pair.weight > 0) == (curve > 0)
    if pair.weight:
        assert abs(pair.weight * curve - 1) < 1e-9
        assert all((a == b).all() for a, b in zip(pair.read()[0], step))
    assert not any(isinstance(v, np.ndarray) and v.ndim > 1 for v in vars(pair).values())


def test_one_class_is_always_predicted(spark):
    d = _docs(spark, 30).withColumn("label", F.lit(2.0))
    assert {r["pred"] for r in MD.batch_predict(MD.fit_logreg(d), d).collect()} == {2}
