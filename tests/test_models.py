"""Model queries do the whole job: every row is scored, every term is kept."""

import pytest
from pyspark.sql import functions as F

from chatspark.operators import models as MD
from chatspark.plans.registry import load_all
from chatspark.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_batch_predict_scores_every_message(spark):
    msgs = Fixtures(spark, SF).msgs
    out = load_all()["batch_predict"].build(spark, SF).collect()
    assert sorted(r["msg_id"] for r in out) == sorted(r["msg_id"] for r in msgs.select("msg_id").collect())
    assert msgs.filter(F.col("sentiment").isNull()).count() > 0
    for r in out:
        assert r["label"] is not None and abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-5


def test_a_null_text_is_scored(spark):
    rows = [(1, "good one", 1.0), (2, "bad two", 0.0), (3, "good two", 1.0), (4, "bad one", 0.0), (5, None, 0.0)]
    d = MD.text_features(spark.createDataFrame(rows, "msg_id long, content string, label double"))
    out = MD.batch_predict(MD.text_pipeline(max_iter=5).fit(d), d)
    assert sorted(r["msg_id"] for r in out.collect()) == [1, 2, 3, 4, 5]


def _many_terms(spark):
    """Two labelled documents with 6,000 terms, most of them seen once."""
    texts = [(i, " ".join(f"t{j}" for j in range(i * 3000, (i + 1) * 3000)) + " both", float(i)) for i in range(2)]
    return spark.createDataFrame(texts, "msg_id long, content string, label double")


def test_vocabularies_keep_every_term(spark):
    from chatspark.operators import topics as TP
    d = _many_terms(spark)
    model = MD.text_pipeline(max_iter=2).fit(MD.text_features(d))
    assert len(model.stages[0].vocabulary) == 6001
    assert TP.tfidf(d, d).count() == 6002
    lda, _, topics = TP.lda_topics(d, k=2, max_iter=1)
    assert len(lda.stages[0].vocabulary) == 6001 and topics.count() == 20
    top = MD.token_contributions(model, d, top_k=7000).select("term").distinct().count()
    assert top == 6000   # "both" has idf 0 and so no coefficient


def test_a_callers_cap_holds(spark):
    model = MD.text_pipeline(vocab_size=10, max_iter=2).fit(MD.text_features(_many_terms(spark)))
    assert len(model.stages[0].vocabulary) == 10


def test_registered_text_models_use_the_published_vocabulary(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer
    seen, fit = [], CountVectorizer._fit
    monkeypatch.setattr(CountVectorizer, "_fit", lambda self, d: seen.append((self.getVocabSize(), self.getMinDF())) or fit(self, d))
    load_all()["train_decision_tree"].build(spark, SF)
    assert seen == [(300_000, 1.0)]


@pytest.mark.parametrize("name, kind, want", [
    ("train_random_forest", "classification.RandomForestClassifier", {"numTrees": 150, "maxDepth": 30})])
def test_registered_sizes_are_the_published_ones(spark, monkeypatch, name, kind, want):
    import pyspark.ml.classification
    import pyspark.ml.clustering

    class Stop(Exception):
        pass

    def fit(self, d):
        assert {p: self.getOrDefault(p) for p in want} == want
        raise Stop

    module, cls = kind.split(".")
    monkeypatch.setattr(getattr(getattr(pyspark.ml, module), cls), "_fit", fit)
    with pytest.raises(Stop):
        load_all()[name].build(spark, SF)


def test_registered_svm_has_the_published_size(spark, monkeypatch):
    from chatspark.operators import svm
    from chatspark.operators import vectors as VC

    class Stop(Exception):
        pass

    real, caps = VC.scaled_tfidf, []
    monkeypatch.setattr(VC, "scaled_tfidf", lambda *a, **k: caps.append(k["max_features"]) or real(*a, **k))

    def fit(vectors, n_features, C, tol, max_iter):
        assert (caps, C, tol, max_iter) == ([300_000], 0.9, 1e-4, 1500)
        assert n_features == vectors.select(F.max(F.array_max("j"))).first()[0] + 1
        assert vectors.filter("size(j) > 0").count() > 100
        raise Stop

    monkeypatch.setattr(svm, "fit_linear_svm", fit)
    with pytest.raises(Stop):
        load_all()["train_linear_svm_ovr"].build(spark, SF)


def test_registered_lda_has_the_published_size(spark, monkeypatch):
    from chatspark.operators import lda

    class Stop(Exception):
        pass

    def fit(counts, k, iterations, **_):
        assert (k, iterations) == (10, 10)
        # every message with a term, every term but the stop words
        assert counts.select("msg_id").distinct().count() > 100
        raise Stop

    monkeypatch.setattr(lda, "lda_batch", fit)
    for name in ("lda_topics", "dominant_topic", "topic_info"):
        with pytest.raises(Stop):
            load_all()[name].build(spark, SF)


@pytest.mark.parametrize("name", ["standard_scale", "maxabs_scale", "pca_users", "project_2d"])
def test_user_vectors_are_made_once(spark, monkeypatch, name):
    """A scaler's statistics and result read written user vectors, not the texts again."""
    from chatspark.operators import features as FT
    made = spark.sparkContext.accumulator(0)

    def users(*_, **__):
        def seen(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b
        rows = [(f"u{i}", 30, *[float(i * (j + 1) % 7) for j in range(len(FT.VECTOR_FEATURES))]) for i in range(9)]
        d = spark.createDataFrame(rows, "uid string, n_msgs long, " + ", ".join(f"{c} double" for c in FT.VECTOR_FEATURES))
        return d.mapInArrow(seen, d.schema)

    monkeypatch.setattr(FT, "user_features", users)
    assert len(load_all()[name].build(spark, SF).collect()) == 9
    assert made.value == 9
