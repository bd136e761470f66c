"""Count, metric and statistics queries (A19-A36, M12) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import EMOTIONS
from ..operators import labels as L
from ..operators import metrics as M
from ..sources.fixtures import Fixtures, duck_with
from .registry import query
from .text_q import DUCK_TOPIC_WORDS


def scored(spark, sf_dir, model: str = "a") -> DataFrame:
    """Per message: truth, class probabilities and prediction of a model
    whose logits are the integer scores / 100."""
    p = Fixtures(spark, sf_dir).preds
    probs = L.softmax(F.array(*[F.col(f"{model}{i}") / F.lit(100.0) for i in range(3)]))
    return p.select("msg_id", "y_true", *[probs[i].alias(f"p{i}") for i in range(3)],
                    L.argmax(probs).alias("pred"))


def _duck_scored(model: str) -> str:
    return (f"""sm_{model} AS (SELECT msg_id, y_true, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2
  FROM (SELECT msg_id, y_true, exp(x0 - greatest(x0, x1, x2)) AS e0, exp(x1 - greatest(x0, x1, x2)) AS e1, exp(x2 - greatest(x0, x1, x2)) AS e2
    FROM (SELECT msg_id, y_true, {model}0 / 100.0 AS x0, {model}1 / 100.0 AS x1, {model}2 / 100.0 AS x2 FROM preds))),
sc_{model} AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM sm_{model})""")


_DS = duck_with("preds").rstrip() + ",\n" + _duck_scored("a") + ",\n" + _duck_scored("b") + "\n"


@query("label_counts", "A19", duck_with("msgs") + "SELECT sentiment, count(*) AS n FROM msgs GROUP BY sentiment")
def label_counts(spark, sf_dir):
    return M.label_counts(Fixtures(spark, sf_dir).msgs)


@query("emotion_counts", "A20", duck_with("emotions_wide") + "SELECT emotion, n FROM (SELECT " +
       ", ".join(f"CAST(sum({e}) AS BIGINT) AS {e}" for e in EMOTIONS) + " FROM emotions_wide) UNPIVOT (n FOR emotion IN (" +
       ", ".join(EMOTIONS) + "))")
def emotion_counts(spark, sf_dir):
    return M.column_sums(Fixtures(spark, sf_dir).emotions_wide, EMOTIONS)


@query("user_mode_sentiment", "A21", duck_with("msgs") + """
, c AS (SELECT uid, sentiment, count(*) AS n, min(msg_id) AS f FROM msgs WHERE sentiment IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f, sentiment) AS rk FROM c)
SELECT uid, sentiment AS label, n FROM r WHERE rk = 1""")
def user_mode_sentiment(spark, sf_dir):
    return M.user_mode_label(Fixtures(spark, sf_dir).msgs)


@query("word_frequencies", "A22", duck_with("msgs") +
       f"SELECT word, count(*) AS n FROM ({DUCK_TOPIC_WORDS.replace('{{', '{').replace('}}', '}')}) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def word_frequencies(spark, sf_dir):
    from ..operators.topics import word_frequencies as wf
    return wf(Fixtures(spark, sf_dir).msgs, 50)


@query("user_topic_weights", "A24", duck_with("topic_weights") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY w DESC, topic) AS rk FROM topic_weights)
SELECT uid, topic, CAST(sum(w) AS BIGINT) AS weight FROM r WHERE rk <= 3 GROUP BY uid, topic""")
def user_topic_weights(spark, sf_dir):
    from ..operators.topics import user_topic_weights as utw
    return utw(Fixtures(spark, sf_dir).topic_weights, 3)


@query("confusion_matrix", "A25", _DS + """
SELECT g.t AS y_true, g.p AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT t, p FROM (SELECT unnest(range(3)) AS t) CROSS JOIN (SELECT unnest(range(3)) AS p)) g
LEFT JOIN (SELECT y_true, pred, count(*) AS n FROM sc_a GROUP BY ALL) c ON c.y_true = g.t AND c.pred = g.p""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(scored(spark, sf_dir, "a")).select(
        F.col("y_true").cast("bigint"), F.col("pred").cast("bigint"), "n")


def _report_ctes(m: str) -> str:
    """Per-class precision/recall/F1 and averages of model ``m`` (CTE rep_m)."""
    return f""", cm_{m} AS (SELECT y_true, pred, count(*) AS n FROM sc_{m} GROUP BY ALL),
k_{m} AS (SELECT unnest(range(3)) AS c),
pc_{m} AS (SELECT k.c,
  coalesce((SELECT sum(n) FROM cm_{m} WHERE y_true = k.c AND pred = k.c), 0) AS tp,
  coalesce((SELECT sum(n) FROM cm_{m} WHERE pred = k.c), 0) AS pp,
  coalesce((SELECT sum(n) FROM cm_{m} WHERE y_true = k.c), 0) AS ts FROM k_{m} k),
mm_{m} AS (SELECT c, ts, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS pr, CASE WHEN ts = 0 THEN 0.0 ELSE tp / ts END AS rc FROM pc_{m}),
f_{m} AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM mm_{m}),
rep_{m} AS (
  SELECT list_extract(['neg', 'neu', 'pos'], c + 1) AS class, pr AS precision, rc AS recall, f1, CAST(ts AS BIGINT) AS support FROM f_{m}
  UNION ALL SELECT 'macro avg', avg(pr), avg(rc), avg(f1), CAST(sum(ts) AS BIGINT) FROM f_{m}
  UNION ALL SELECT 'weighted avg', sum(pr * ts) / sum(ts), sum(rc * ts) / sum(ts), sum(f1 * ts) / sum(ts), CAST(sum(ts) AS BIGINT) FROM f_{m})
"""


_REPORT = _DS + _report_ctes("a").replace("rep_a AS", "rep AS")


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("class_report", "A26", _REPORT + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, "
       "round(f1, 6) AS f1, support FROM rep")
def class_report(spark, sf_dir):
    return _r6(M.class_report(scored(spark, sf_dir, "a")), ["precision", "recall", "f1"])


@query("accuracy", "A27", _DS + "SELECT count(*) FILTER (WHERE y_true = pred) AS correct, count(*) AS n, "
       "round(count(*) FILTER (WHERE y_true = pred) / count(*), 6) AS accuracy FROM sc_a")
def accuracy(spark, sf_dir):
    return _r6(M.accuracy(scored(spark, sf_dir, "a")), ["accuracy"])


@query("weighted_f1", "A28", _REPORT + "SELECT round(f1, 6) AS weighted_f1 FROM rep WHERE class = 'weighted avg'")
def weighted_f1(spark, sf_dir):
    return _r6(M.weighted_f1(scored(spark, sf_dir, "a")), ["weighted_f1"])


@query("roc_auc_ovr", "A29", _DS + """
, l AS (SELECT y_true, unnest([0, 1, 2]) AS cls, unnest([p0, p1, p2]) AS s FROM sc_a),
g AS (SELECT cls, s, count(*) FILTER (WHERE y_true = cls) AS np, count(*) FILTER (WHERE y_true <> cls) AS nn FROM l GROUP BY cls, s),
c AS (SELECT *, coalesce(sum(nn) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT CAST(cls AS INTEGER) AS cls, round(sum(np * (below + nn * 0.5)) / (sum(np) * sum(nn)), 6) AS auc FROM c GROUP BY cls""")
def roc_auc_ovr(spark, sf_dir):
    return M.roc_auc_ovr(scored(spark, sf_dir, "a")).select(F.col("cls").cast("int"), F.round("auc", 6).alias("auc"))


@query("log_loss", "A30", _DS + f"""
SELECT round(-avg(ln(least(greatest(list_extract([p0, p1, p2], y_true + 1), {M.EPS}), 1 - {M.EPS}))), 6) AS log_loss FROM sc_a""")
def log_loss(spark, sf_dir):
    return _r6(M.log_loss(scored(spark, sf_dir, "a")), ["log_loss"])


def paired(spark, sf_dir) -> DataFrame:
    """Per message: correctness of both models (0/1) and the integer score
    of the true class for both."""
    a, b = scored(spark, sf_dir, "a"), scored(spark, sf_dir, "b")
    p = Fixtures(spark, sf_dir).preds
    ta = F.element_at(F.array("a0", "a1", "a2"), F.col("y_true") + 1)
    tb = F.element_at(F.array("b0", "b1", "b2"), F.col("y_true") + 1)
    return (a.select("msg_id", (F.col("pred") == F.col("y_true")).cast("int").alias("ca"))
            .join(b.select("msg_id", (F.col("pred") == F.col("y_true")).cast("int").alias("cb")), "msg_id")
            .join(p.select("msg_id", ta.alias("sa"), tb.alias("sb")), "msg_id"))


_PAIRED = _DS + """
, pr AS (SELECT a.msg_id, CAST(a.pred = a.y_true AS INTEGER) AS ca, CAST(b.pred = b.y_true AS INTEGER) AS cb,
  list_extract([p.a0, p.a1, p.a2], p.y_true + 1) AS sa, list_extract([p.b0, p.b1, p.b2], p.y_true + 1) AS sb
  FROM sc_a a JOIN sc_b b ON a.msg_id = b.msg_id JOIN preds p ON p.msg_id = a.msg_id)
"""


def _normal_p(z: str) -> str:
    """Two-sided p of the standard normal by Simpson's rule on 0 to |z|."""
    return (f"(SELECT 1 - 2 * abs({z}) / 6000 / sqrt(2 * pi()) * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END "
            f"* exp(-pow({z} * k / 2000, 2) / 2)) FROM range(2001) g(k))")


def _student_p(t: str, df: str) -> str:
    """Two-sided p of Student's t by Simpson's rule on 0 to |t|."""
    return (f"(SELECT 1 - 2 * abs({t}) / 6000 * exp(lgamma(({df} + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) * "
            f"sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow({t} * k / 2000, 2) / ({df}), "
            f"-(({df}) + 1) / 2.0)) FROM range(2001) g(k))")


@query("paired_diff_test", "A31", _PAIRED + """
, s AS (SELECT count(*) AS n, CAST(sum(ca) AS BIGINT) AS sa, CAST(sum(ca * ca) AS BIGINT) AS saa, CAST(sum(cb) AS BIGINT) AS sb,
  CAST(sum(cb * cb) AS BIGINT) AS sbb, CAST(sum(ca - cb) AS BIGINT) AS sd, CAST(sum((ca - cb) * (ca - cb)) AS BIGINT) AS sdd FROM pr),
m AS (SELECT n, sa / n AS ma, sb / n AS mb, sd / n AS md, sqrt(greatest(saa / n - (sa / n) * (sa / n), 0.0)) AS sda,
  sqrt(greatest(sbb / n - (sb / n) * (sb / n), 0.0)) AS sdb, (sdd - sd * sd / n) / (n - 1) AS vd FROM s)
SELECT n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(md, 6) AS mean_diff, round(sda, 6) AS sd_a, round(sdb, 6) AS sd_b,
  round(sda / sqrt(n), 6) AS se_a, round(sdb / sqrt(n), 6) AS se_b, abs(ma - mb) > 2 * (sda / sqrt(n) + sdb / sqrt(n)) AS beyond_2se,
  round(md / sqrt(vd / n), 6) AS t_stat, round(""" + _student_p("md / sqrt(vd / n)", "n - 1") + """, 6) AS p_value FROM m""")
def paired_diff_test(spark, sf_dir):
    r = M.paired_diff_test(paired(spark, sf_dir), "ca", "cb")
    return _r6(r, ["mean_a", "mean_b", "mean_diff", "sd_a", "sd_b", "se_a", "se_b", "t_stat", "p_value"])


@query("wilcoxon_signed_rank", "A32", _PAIRED + """
, g AS (SELECT abs(sa - sb) AS ad, count(*) AS c, count(*) FILTER (WHERE sa - sb > 0) AS cp FROM pr WHERE sa <> sb GROUP BY 1),
r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY ad ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS rk FROM g),
s AS (SELECT sum(cp * rk) AS w_plus, sum((c - cp) * rk) AS w_minus, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * c * c - c) AS BIGINT) AS ties FROM r)
SELECT w_plus, w_minus, n, ties, round(z, 6) AS z, round(""" + _normal_p("z") + """, 6) AS p_value FROM (
  SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM s)""")
def wilcoxon_signed_rank(spark, sf_dir):
    return _r6(M.wilcoxon_signed_rank(paired(spark, sf_dir), "sa", "sb"), ["z", "p_value"])


@query("normality_check", "A33", _PAIRED + """
, s AS (SELECT count(*) AS n, CAST(sum(d) AS BIGINT) AS s1, CAST(sum(d * d) AS BIGINT) AS s2, CAST(sum(d * d * d) AS BIGINT) AS s3,
  CAST(sum(d * d * d * d) AS BIGINT) AS s4 FROM (SELECT CAST(sa - sb AS BIGINT) AS d FROM pr)),
m AS (SELECT n, s1 / n AS mu, s2 / n - (s1 / n) * (s1 / n) AS m2,
  s3 / n - 3 * (s1 / n) * s2 / n + 2 * (s1 / n) * (s1 / n) * (s1 / n) AS m3,
  s4 / n - 4 * (s1 / n) * s3 / n + 6 * (s1 / n) * (s1 / n) * s2 / n - 3 * (s1 / n) * (s1 / n) * (s1 / n) * (s1 / n) AS m4 FROM s),
k AS (SELECT n, m3 / pow(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM m)
SELECT n, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, round(n / 6 * (sk * sk + ku * ku / 4), 6) AS jarque_bera FROM k""")
def normality_check(spark, sf_dir):
    d = paired(spark, sf_dir).select((F.col("sa") - F.col("sb")).alias("d"))
    return _r6(M.normality_check(d, "d"), ["skewness", "kurtosis", "jarque_bera"])


def metric_table(spark, sf_dir) -> DataFrame:
    return M.metric_table({m: scored(spark, sf_dir, m) for m in ("a", "b")})


def _duck_metric_table() -> str:
    def one(m):
        return f"""SELECT '{m}' AS model, 'accuracy' AS metric, count(*) FILTER (WHERE y_true = pred) / count(*) AS value FROM sc_{m}
  UNION ALL SELECT '{m}', 'log_loss', -avg(ln(least(greatest(list_extract([p0, p1, p2], y_true + 1), {M.EPS}), 1 - {M.EPS}))) FROM sc_{m}
  UNION ALL SELECT '{m}', 'f1 ' || class, f1 FROM rep_{m} WHERE class IN ('macro avg', 'weighted avg')
  UNION ALL SELECT '{m}', 'roc_auc', avg(auc) FROM auc_{m}"""

    def auc(m):
        return f""", l_{m} AS (SELECT y_true, unnest([0, 1, 2]) AS cls, unnest([p0, p1, p2]) AS s FROM sc_{m}),
g_{m} AS (SELECT cls, s, count(*) FILTER (WHERE y_true = cls) AS np, count(*) FILTER (WHERE y_true <> cls) AS nn FROM l_{m} GROUP BY cls, s),
c_{m} AS (SELECT *, coalesce(sum(nn) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g_{m}),
auc_{m} AS (SELECT cls, sum(np * (below + nn * 0.5)) / (sum(np) * sum(nn)) AS auc FROM c_{m} GROUP BY cls)
"""
    return (_DS + _report_ctes("a") + _report_ctes("b") + auc("a") + auc("b")
            + ", mt AS (" + one("a") + "\n  UNION ALL " + one("b") + ")\n")


_MT = _duck_metric_table()


@query("metric_table", "A26-A30", _MT + "SELECT model, metric, round(value, 6) AS value FROM mt")
def metric_table_q(spark, sf_dir):
    return metric_table(spark, sf_dir).select("model", "metric", F.round("value", 6).alias("value"))


@query("metric_deltas", "A35", _MT + "SELECT metric, round(max(value) FILTER (WHERE model = 'a') - "
       "max(value) FILTER (WHERE model = 'b'), 6) AS delta FROM mt GROUP BY metric")
def metric_deltas(spark, sf_dir):
    return M.metric_deltas(metric_table(spark, sf_dir)).select("metric", F.round("delta", 6).alias("delta"))


def verdict(spark, sf_dir) -> DataFrame:
    v = M.compared(scored(spark, sf_dir, "a"), scored(spark, sf_dir, "b"))
    return v.select("metric", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate")], "practical",
                    F.round("p_value", 6).alias("p_value"), "significant")


#: the verdict on each metric, also of the written report
_VERDICT_CTES = _MT + f"""
, pv AS (SELECT CAST(a.pred = a.y_true AS INTEGER) - CAST(b.pred = b.y_true AS INTEGER) AS dc,
  ln(least(greatest(list_extract([b.p0, b.p1, b.p2], b.y_true + 1), {M.EPS}), 1 - {M.EPS}))
  - ln(least(greatest(list_extract([a.p0, a.p1, a.p2], a.y_true + 1), {M.EPS}), 1 - {M.EPS})) AS dl
  FROM sc_a a JOIN sc_b b ON a.msg_id = b.msg_id),
tt AS (SELECT 'accuracy' AS metric, count(*) AS n, avg(dc) / sqrt(var_samp(dc) / count(*)) AS t FROM pv
  UNION ALL SELECT 'log_loss', count(*), avg(dl) / sqrt(var_samp(dl) / count(*)) FROM pv),
tp AS (SELECT metric, """ + _student_p("t", "n - 1") + """ AS p FROM tt),
w AS (SELECT metric, max(value) FILTER (WHERE model = 'a') AS baseline, max(value) FILTER (WHERE model = 'b') AS candidate FROM mt GROUP BY metric),
v AS (SELECT w.metric, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, CASE WHEN w.metric = 'log_loss' THEN baseline > candidate * 1.05 ELSE candidate > baseline * 1.05 END AS practical,
  round(p, 6) AS p_value, p < 0.05 AS significant FROM w LEFT JOIN tp ON tp.metric = w.metric)
"""
VERDICT_SQL = _VERDICT_CTES + "SELECT * FROM v"


@query("metric_verdict", "A34", VERDICT_SQL)
def metric_verdict(spark, sf_dir):
    return verdict(spark, sf_dir)


@query("compared_cells", "M21", _DS + """
, g AS (SELECT unnest([0, 1, 2]) AS c)
SELECT m.model, CAST(t.c AS INTEGER) AS y_true, CAST(p.c AS INTEGER) AS pred, count(s.msg_id) AS n
FROM (SELECT unnest(['a', 'b']) AS model) m CROSS JOIN g t CROSS JOIN g p
LEFT JOIN (SELECT 'a' AS model, * FROM sc_a UNION ALL SELECT 'b', * FROM sc_b) s ON s.model = m.model AND s.y_true = t.c AND s.pred = p.c
GROUP BY ALL""")
def compared_cells(spark, sf_dir):
    cells = M.compared_cells({m: scored(spark, sf_dir, m) for m in ("a", "b")})
    return cells.select("model", F.col("y_true").cast("int").alias("y_true"),
                                        F.col("pred").cast("int").alias("pred"), "n")


@query("verdict_sentences", "S14", _VERDICT_CTES + """SELECT 1 AS place, 'Statistically significant difference on '
  || coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (WHERE significant), 'no metric') || '.' AS line FROM v
UNION ALL SELECT 2, 'Practically significant improvement on '
  || coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (WHERE significant AND practical), 'no metric') || '.' FROM v""")
def verdict_sentences(spark, sf_dir):
    return M.verdict_sentences(verdict(spark, sf_dir))


_QQ = 99


def _theoretical() -> str:
    from statistics import NormalDist
    return ", ".join(f"({i}, {NormalDist().inv_cdf((i - 0.5) / _QQ)!r})" for i in range(1, _QQ + 1))


@query("qq_points", "A36", _PAIRED + f"""
, r AS (SELECT CAST(sa - sb AS DOUBLE) AS d, row_number() OVER (ORDER BY sa - sb) AS k, count(*) OVER () AS n FROM pr),
q(i, theoretical) AS (VALUES {_theoretical()})
SELECT CAST(q.i AS INTEGER) AS i, round(CAST(q.theoretical AS DOUBLE), 6) AS theoretical, r.d AS sample
FROM q JOIN r ON r.k = ((2 * q.i - 1) * r.n + {2 * _QQ - 1}) // {2 * _QQ}""")
def qq_points(spark, sf_dir):
    d = paired(spark, sf_dir).select((F.col("sa") - F.col("sb")).alias("d"))
    return M.qq_points(d, "d", _QQ).select("i", F.round("theoretical", 6).alias("theoretical"), "sample")


@query("histogram_bins", "A36", _PAIRED + """
, d AS (SELECT CAST(sa - sb AS DOUBLE) AS x FROM pr), r AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
b AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin FROM d, r),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(g.bin AS INTEGER) AS bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN c ON c.bin = g.bin""")
def histogram_bins(spark, sf_dir):
    d = paired(spark, sf_dir).select((F.col("sa") - F.col("sb")).alias("d"))
    return M.histogram_bins(d, "d", 10)


@query("balanced_weights", "M12", duck_with("preds") + """
, c AS (SELECT y_true, count(*) AS nc FROM preds GROUP BY y_true), t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT p.msg_id, p.y_true, round(t.n / (t.k * c.nc), 6) AS weight FROM preds p JOIN c ON c.y_true = p.y_true, t""")
def balanced_weights(spark, sf_dir):
    p = Fixtures(spark, sf_dir).preds.select("msg_id", "y_true")
    return M.balanced_weights(p, "y_true").select("msg_id", "y_true", F.round("weight", 6).alias("weight"))
