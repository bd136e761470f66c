"""Metrics: published golden values, and rank statistics vs brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from chatspark.operators import metrics as M

# The two published 3x3 confusion matrices (rows = truth).
BASELINE_CM = [[1369, 85, 60], [146, 217, 98], [45, 44, 689]]
USERVEC_CM = [[1361, 90, 63], [134, 232, 95], [36, 54, 688]]


def _expand(spark, cm):
    rows = [(t, p) for t in range(3) for p in range(3) for _ in range(cm[t][p])]
    return spark.createDataFrame(rows, "y_true int, pred int")


def _report(spark, cm):
    r = M.class_report(_expand(spark, cm)).collect()
    return {x["class"]: (round(x["precision"], 2), round(x["recall"], 2), round(x["f1"], 2), x["support"]) for x in r}


def test_golden_baseline_report(spark):
    rep = _report(spark, BASELINE_CM)
    assert rep["neg"][:3] == (0.88, 0.90, 0.89)
    assert rep["neu"][:3] == (0.63, 0.47, 0.54)
    assert rep["pos"][:3] == (0.81, 0.89, 0.85)
    assert rep["macro avg"][:3] == (0.77, 0.75, 0.76)
    assert rep["weighted avg"][:3] == (0.82, 0.83, 0.82)
    acc = M.accuracy(_expand(spark, BASELINE_CM)).first()
    assert (acc["correct"], acc["n"], round(acc["accuracy"], 2)) == (2275, 2753, 0.83)


def test_golden_user_vector_report(spark):
    rep = _report(spark, USERVEC_CM)
    assert rep["neg"][:3] == (0.89, 0.90, 0.89)
    assert rep["neu"][:3] == (0.62, 0.50, 0.55)
    assert rep["pos"][:3] == (0.81, 0.88, 0.85)
    assert rep["macro avg"][:3] == (0.77, 0.76, 0.77)
    assert rep["weighted avg"][:3] == (0.82, 0.83, 0.82)


def test_confusion_matrix_keeps_zero_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (2, 1)], "y_true int, pred int")
    cells = {(r["y_true"], r["pred"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[(0, 0)] == 2 and cells[(2, 1)] == 1 and cells[(1, 1)] == 0


def _brute_auc(ys, ps, c):
    pos = [p[c] for y, p in zip(ys, ps) if y == c]
    neg = [p[c] for y, p in zip(ys, ps) if y != c]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def test_roc_auc_ovr_vs_brute_force(spark):
    rng = random.Random(5)
    ys = [rng.randrange(3) for _ in range(300)]
    ps = [[rng.randrange(5) / 4 for _ in range(3)] for _ in ys]   # many ties
    df = spark.createDataFrame([(y, *p) for y, p in zip(ys, ps)], "y_true int, p0 double, p1 double, p2 double")
    got = {r["cls"]: r["auc"] for r in M.roc_auc_ovr(df).collect()}
    for c in range(3):
        assert abs(got[c] - _brute_auc(ys, ps, c)) < 1e-12


def test_wilcoxon_vs_brute_force(spark):
    rng = random.Random(9)
    a = [rng.randrange(-5, 6) for _ in range(200)]
    b = [rng.randrange(-5, 6) for _ in range(200)]
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    r = M.wilcoxon_signed_rank(df, "a", "b").first()
    d = [x - y for x, y in zip(a, b) if x != y]
    order = sorted(abs(v) for v in d)
    rank = {}
    for v in set(order):
        idx = [i + 1 for i, w in enumerate(order) if w == v]
        rank[v] = sum(idx) / len(idx)
    assert r["w_plus"] == sum(rank[abs(v)] for v in d if v > 0)
    assert r["w_minus"] == sum(rank[abs(v)] for v in d if v < 0)
    assert r["n"] == len(d)


def test_paired_and_verdict(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (0, 0), (1, 0)], "a int, b int")
    r = M.paired_diff_test(df, "a", "b").first()
    assert r["n"] == 4 and r["mean_diff"] == 0.5
    mt = spark.createDataFrame([("a", "accuracy", 0.80), ("b", "accuracy", 0.85), ("a", "f1", 0.5), ("b", "f1", 0.51)],
                               "model string, metric string, value double")
    v = {x["metric"]: x["practical"] for x in M.metric_verdict(mt).collect()}
    assert v == {"accuracy": True, "f1": False}
    assert abs(spark.range(1).select(M.normal_p_two_sided(F.lit(1.959963984540054))).first()[0] - 0.05) < 1e-9


def test_select_best_stops_after_patience(spark):
    from chatspark.operators import models as MD

    def run(scores, **kw):
        df = spark.createDataFrame(list(enumerate(scores)), "step int, accuracy double")
        got = sorted((r["step"], r["best"]) for r in MD.select_best(df, **kw).collect())
        return [s for s, _ in got], [s for s, b in got if b]

    assert run([.8, .7, .6, .9, .5]) == ([0, 1, 2], [0])
    assert run([.5, .5, .5, .5]) == ([0, 1, 2], [0])
    assert run([.1, .2, .3]) == ([0, 1, 2], [2])
    assert run([.1, .3, .2, .4, .1, .1, .9]) == ([0, 1, 2, 3, 4, 5], [3])
    assert run([.9, .8, .85, .1], larger_is_better=False) == ([0, 1, 2, 3], [3])


def test_statistics_of_empty_and_constant_inputs(spark):
    none = spark.createDataFrame([], "y_true int, pred int")
    assert M.weighted_f1(none).first()["weighted_f1"] == 0
    assert {r["support"] for r in M.class_report(none).collect()} == {0}
    same = spark.createDataFrame([(1, 1)] * 4, "a int, b int")
    assert M.paired_diff_test(same, "a", "b").first()["t_stat"] is None
    assert M.normality_check(same, "a").first()["skewness"] is None
    assert [r["n"] for r in M.histogram_bins(same, "a", 3).orderBy("bin").collect()] == [4, 0, 0]
    loss = spark.createDataFrame([("log_loss", "a", .43), ("log_loss", "b", .50)], "metric string, model string, value double")
    assert M.metric_verdict(loss).first()["practical"] is False


def test_malformed_rows_whatever_is_selected(spark, tmp_path):
    from chatspark.sources import readers as R
    (tmp_path / "x.csv").write_text("id,n\n1,2\nfew\n3,x\n4,5\n")
    good = R.read_skip_bad(spark, str(tmp_path / "x.csv"), "id int, n int")
    assert good.count() == 2 and len(good.collect()) == 2
    assert sorted(r["id"] for r in good.select("id").collect()) == [1, 4]
    assert {r["record"] for r in R.read_rejects(spark, str(tmp_path / "x.csv"), "id int, n int").collect()} == {"few", "3,x"}


def test_header_of_every_file(spark, tmp_path):
    from chatspark.sources import readers as R
    (tmp_path / "a.csv").write_text("uid|content\nu|c\n")
    (tmp_path / "b.csv").write_text("uid|content|more\nu|c|d\n")
    got = sorted(tuple(r) for r in R.check_header(spark, str(tmp_path), ["uid", "content"]).collect())
    assert got == [("uid|content", True), ("uid|content|more", False)]


def test_statistics_beyond_a_long(spark):
    many = spark.range(3_000_000).select(F.lit(1).alias("a"), F.lit(0).alias("b"))
    assert M.wilcoxon_signed_rank(many, "a", "b").first()["z"] > 1000
    wide = spark.range(1_000_000).select(F.when(F.col("id") % 2 == 0, 3000).otherwise(-3000).alias("d"))
    r = M.normality_check(wide, "d").first()
    assert abs(r["skewness"]) < 1e-6 and abs(r["kurtosis"] + 2) < 1e-6


def test_replay_keeps_rows_without_a_key(spark, tmp_path):
    from chatspark.streaming import streams as ST
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "msg_id long")
    assert spark.read.parquet(ST.replay_files(df, str(tmp_path / "r"), "msg_id", 2)).count() == 5


def test_p_values_per_metric_and_sentences(spark):
    rng = random.Random(12)
    rows = [(i, rng.random(), rng.random() + 0.05, float(i), float(i), None) for i in range(400)] + [(9, None, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double")
    got = {r["metric"]: r for r in M.paired_p_values(df, {"x": ("a", "b"), "same": ("c", "d"), "none": ("a", "e")}).collect()}
    d = [r[1] - r[2] for r in rows if r[1] is not None]
    mean = sum(d) / len(d)
    t = mean / math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1) / len(d))
    assert got["x"]["n"] == 400 and abs(got["x"]["t_stat"] - t) < 1e-9
    assert abs(got["x"]["p_value"] - math.erfc(abs(t) / math.sqrt(2))) < 0.005
    assert got["same"]["p_value"] is None and got["none"]["p_value"] is None and got["none"]["n"] == 0
    table = spark.createDataFrame([("a", m, 0.5) for m in ("x", "y", "z")] + [("b", "x", 0.9), ("b", "y", 0.51), ("b", "z", 0.9)],
                                  "model string, metric string, value double")
    p = spark.createDataFrame([("x", 0.01), ("y", 0.02), ("z", 0.5)], "metric string, p_value double")
    verdict = M.metric_verdict(table, p_values=p)
    lines = [r["line"] for r in M.verdict_sentences(verdict).orderBy("place").collect()]
    assert lines == ["Statistically significant difference on x, y.", "Practically significant improvement on x."]
    none = [r["line"] for r in M.verdict_sentences(verdict.filter("metric = 'z'")).orderBy("place").collect()]
    assert none == ["Statistically significant difference on no metric.", "Practically significant improvement on no metric."]


def test_small_signed_rank_is_exact(spark):
    df = spark.createDataFrame([(0, d) for d in (1, -2, 3, 4, 5)], "z int, d int")
    r = M.wilcoxon_signed_rank(df, "d", "z").first()
    assert (r["w_plus"], r["w_minus"]) == (13.0, 2.0) and abs(r["p_value"] - 0.1875) < 1e-12


def test_qq_points_by_rank(spark):
    import statistics
    rng = random.Random(3)
    for n in (1, 7, 99, 500):
        values = [rng.randint(-5, 5) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
        got = {r["i"]: (r["theoretical"], r["sample"]) for r in M.qq_points(df, "v", 20).collect()}
        ordered = sorted(values)
        assert sorted(got) == list(range(1, 21))
        for i, (q, v) in got.items():
            assert v == ordered[-(-(2 * i - 1) * n // 40) - 1]
            assert abs(q - statistics.NormalDist().inv_cdf((i - 0.5) / 20)) < 1e-7
    assert M.qq_points(df.filter("v is null"), "v").count() == 0


def test_two_models_compared_on_their_rows(spark):
    rows_a = [(1, 0, .8, .1, .1, 0), (2, 1, .2, .7, .1, 1), (3, 2, .6, .3, .1, 0), (4, 2, .1, .2, .7, 2)]
    rows_b = [(1, 0, .9, .05, .05, 0), (2, 1, .1, .8, .1, 1), (3, 2, .1, .1, .8, 2), (4, 2, .4, .3, .3, 0), (5, 0, .9, .1, 0., 0)]
    schema = "msg_id long, y_true int, p0 double, p1 double, p2 double, pred int"
    a, b = spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema)
    got = {r["metric"]: r for r in M.compared(a, b).collect()}
    assert set(got) == {"accuracy", "log_loss", "roc_auc", "f1 macro avg", "f1 weighted avg"}
    assert got["accuracy"]["baseline"] == 0.75 and got["accuracy"]["candidate"] == 0.8
    assert got["accuracy"]["p_value"] == pytest.approx(1.0) and got["roc_auc"]["p_value"] is None
    cells = {(r["model"], r["y_true"], r["pred"]): r["n"] for r in M.compared_cells({"a": a, "b": b}).collect()}
    assert len(cells) == 18 and sum(cells.values()) == 9 and cells["a", 2, 0] == 1 and cells["b", 0, 0] == 2
