"""Batch LDA against the same updates in numpy; topic merging by hand."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatspark.functions.distributions import log_gamma
from chatspark.operators import joins as J
from chatspark.operators import lda as LD


def test_digamma_and_log_gamma(spark):
    xs = [0.05, 0.1, 0.5, 1.0, 2.0, 3.7, 10.0, 1e3, 1e7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", LD.digamma(F.col("x")).alias("d"), log_gamma(F.col("x")).alias("g")).collect()
    for r in got:
        h = r["x"] * 1e-5
        assert abs(r["d"] - (math.lgamma(r["x"] + h) - math.lgamma(r["x"] - h)) / (2 * h)) < 1e-5 * max(1, abs(r["d"]))
        assert abs(r["g"] - math.lgamma(r["x"])) < 1e-9 * max(1, abs(r["g"]))


def _counts(seed=2):
    rng = random.Random(seed)
    rows = {}
    for d in range(30):
        for _ in range(rng.randint(5, 40)):
            t = f"{'abc'[d % 3]}{rng.randint(0, 8)}" if rng.random() < 0.9 else "the"
            rows[d, t] = rows.get((d, t), 0) + 1
    return [(d, t, n) for (d, t), n in rows.items()]


def _psi(x):
    x, out = np.array(x, float), 0.0
    for _ in range(30):
        out, x = out - 1 / x, x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4)


def test_updates_equal_numpy_and_bound_rises(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_SHARE", 20)  # some terms are joined apart
    k, rows = 3, _counts()
    df = spark.createDataFrame(rows, "msg_id int, term string, tf int")
    model = LD.lda_batch(df, k, 8, seed=1)
    terms, docs = sorted({t for _, t, _ in rows}), sorted({d for d, _, _ in rows})
    n = np.zeros((len(docs), len(terms)))
    for d, t, c in rows:
        n[docs.index(d), terms.index(t)] = c
    first = {r["term"]: [r[f"w{j}"] for j in range(k)] for r in
             df.select("term").distinct().select("term", *[LD.first_weight(F.col("term"), j, 1).alias(f"w{j}") for j in range(k)]).collect()}
    lam = np.array([first[t] for t in terms])
    gam = 1 / k + np.repeat(n.sum(1)[:, None] / k, k, axis=1)
    for _ in range(8):
        b, t = np.exp(_psi(lam) - _psi(lam.sum(0))), np.exp(_psi(gam) - _psi(gam.sum(1))[:, None])
        phi = t[:, None, :] * b[None, :, :]
        phi *= (n / phi.sum(2))[:, :, None]
        gam, lam = 1 / k + phi.sum(1), 1 / k + phi.sum(0)
    got = {r["term"]: [r[f"w{j}"] for j in range(k)] for r in model.topics.collect()}
    assert max(abs(np.array(got[t]) - lam[i]).max() for i, t in enumerate(terms)) < 1e-6
    theta = {r["msg_id"]: r["topic_distribution"] for r in model.distributions().collect()}
    assert max(abs(np.array(theta[d]) - gam[i] / gam[i].sum()).max() for i, d in enumerate(docs)) < 1e-8
    assert len(model.bounds) == 8 and all(a < b + 1e-9 for a, b in zip(model.bounds, model.bounds[1:]))
    top = model.top_terms(4).collect()
    assert len(top) == 12 and {r["rank"] for r in top} == {0, 1, 2, 3}


def _stored(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(top) for f in files)


def test_iterations_do_not_pile_up(spark):
    df = spark.createDataFrame(_counts(), "msg_id int, term string, tf int")
    sizes = []
    for iterations in (2, 8):
        before = _stored(spark)
        LD.lda_batch(df, 3, iterations, bounds=False)
        sizes.append(_stored(spark) - before)
    assert sizes[1] < 1.3 * sizes[0]


def test_empty_and_early_stop(spark):
    empty = LD.lda_batch(spark.createDataFrame([], "msg_id int, term string, tf int"), 2, 3)
    assert empty.topics.count() == 0 and empty.docs.count() == 0
    df = spark.createDataFrame(_counts(), "msg_id int, term string, tf int")
    assert len(LD.lda_batch(df, 2, 10, tolerance=0.5).bounds) == 2


@pytest.mark.parametrize("left,want", [(3, {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, -1: -1}), (1, {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, -1: -1}),
                                       (9, {t: t for t in (0, 1, 2, 3, 4, -1)})])
def test_topics_merge_into_the_nearest(spark, left, want):
    vectors = {0: [1.0, 0.0, 0.2], 1: [0.0, 1.0, 0.1], 2: [0.1, 1.0, 0.0], 3: [0.0, 0.0, 1.0], 4: [0.0, 0.1, 1.0], -1: [0.0, 0.0, 0.0]}
    topics = spark.createDataFrame([(t, v) for t, v in vectors.items()], "topic int, vector array<double>")
    counts = spark.createDataFrame([(0, 50), (1, 20), (2, 5), (3, 10), (4, 5), (-1, 99)], "topic int, count long")
    assert {r["topic"]: r["merged_into"] for r in LD.reduce_topics(topics, left, counts).collect()} == want


def test_weights_of_documents_stand_still_in_each_iteration(spark, monkeypatch):
    """As the published E step: a document's weights are updated until they change
    by less than the tolerance, and the returned ones are of the fitted topics."""
    monkeypatch.setattr(LD, "PIECE", 60)  # many pieces, documents that drop out early
    k, rows = 3, _counts(5)
    df = spark.createDataFrame(rows, "msg_id int, term string, tf int")
    model = LD.lda_batch(df, k, 4, seed=1, e_steps=2000, still=1e-9)
    terms, docs = sorted({t for _, t, _ in rows}), sorted({d for d, _, _ in rows})
    n = np.zeros((len(docs), len(terms)))
    for d, t, c in rows:
        n[docs.index(d), terms.index(t)] = c
    first = {r["term"]: [r[f"w{j}"] for j in range(k)] for r in
             df.select("term").distinct().select("term", *[LD.first_weight(F.col("term"), j, 1).alias(f"w{j}") for j in range(k)]).collect()}
    lam = np.array([first[t] for t in terms])
    gam = 1 / k + np.repeat(n.sum(1)[:, None] / k, k, axis=1)
    for i in range(5):
        b = np.exp(_psi(lam) - _psi(lam.sum(0)))
        for _ in range(2000):
            t = np.exp(_psi(gam) - _psi(gam.sum(1))[:, None])
            phi = t[:, None, :] * b[None, :, :]
            phi *= (n / phi.sum(2))[:, :, None]
            gam, old = 1 / k + phi.sum(1), gam
            if abs(gam - old).mean(1).max() < 1e-9:
                break
        if i < 4:
            lam = 1 / k + phi.sum(0)
    got = {r["term"]: [r[f"w{j}"] for j in range(k)] for r in model.topics.collect()}
    assert max(abs(np.array(got[t]) - lam[i]).max() for i, t in enumerate(terms)) < 1e-4
    theta = {r["msg_id"]: r["topic_distribution"] for r in model.distributions().collect()}
    assert max(abs(np.array(theta[d]) - gam[i] / gam[i].sum()).max() for i, d in enumerate(docs)) < 1e-4
    assert all(a < b + 1e-9 for a, b in zip(model.bounds, model.bounds[1:]))


def test_topic_info_merges_topics(spark):
    """The smallest of three topics goes into the nearest; the merged one's terms are
    weighted by documents, and its vectors have the products of the distributions."""
    topics = spark.createDataFrame([("a", 1, 8.0, 1.0, 7.0), ("b", 1, 1.0, 8.0, 1.0), ("c", 1, 1.0, 1.0, 2.0)],
                                   "term string, df long, w0 double, w1 double, w2 double")
    model = LD.BatchLda(3, "msg_id", topics, None)
    vectors = {r["topic"]: np.array(r["vector"]) for r in model.topic_vectors().collect()}
    p = np.array([[8, 1, 7], [1, 8, 1], [1, 1, 2]]) / 10
    assert all(abs(vectors[i] @ vectors[j] - p[:, i] @ p[:, j]) < 1e-12 for i in range(3) for j in range(3))
    assigned = spark.createDataFrame([(0,)] * 5 + [(1,)] * 4 + [(2,)] * 3, "topic int")
    got = {r["topic"]: (r["count"], r["name"]) for r in LD.merged_info(model, assigned, 2).collect()}
    assert got == {0: (8, "0_a_c_b"), 1: (4, "1_b_a_c")}


def test_registered_topic_info_merges_and_settles(spark, monkeypatch):
    from chatspark.plans import topics_q as Q
    seen, real = {}, LD.lda_batch

    def fit(counts, **given):
        seen.update(given)
        return real(counts, **given | {"iterations": 1})

    monkeypatch.setattr(LD, "lda_batch", fit)
    rows = Q.topic_info(spark, "/root/testdata/sf0.001").collect()
    assert seen["e_steps"] == 100 and 0 < len(rows) <= 5
    assert sum(r["count"] for r in rows) > 100
