"""Counts, classification metrics and paired statistics.

Every metric starts from exact integer counts (one aggregate, partial
aggregation before the shuffle); ratios are taken once at the end. Rank
statistics (ROC AUC, Wilcoxon) group equal values first and use
distributed prefix sums, never one global sort in a single task.
p-values are Columns over the one-row results (functions/distributions.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_p_two_sided, normal_quantile, signed_rank_p_two_sided, student_p_two_sided
from ..functions.lexicons import ID_LABELS
from .ordered import prefix_sums

EPS = 2.220446049250313e-16  # float64 machine epsilon (log-loss clipping)
Z_05 = 1.959963984540054     # two-sided 5 % normal critical value


def _grid(k: int) -> DataFrame:
    """The k x k (true, pred) class grid as a tiny literal table."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t in range(k) for p in range(k)]))
    return spark.range(1).select(cells.alias("c")).select("c.t", "c.p")


def label_counts(df: DataFrame, col: str = "sentiment") -> DataFrame:
    """Rows per label."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def column_sums(df: DataFrame, cols: list[str], name: str = "emotion") -> DataFrame:
    """Number of 1s per flag column (one aggregate row, then unpivot)."""
    one = df.agg(*[F.sum(c).cast("long").alias(c) for c in cols])
    return one.unpivot([], cols, name, "n")


def user_mode_label(df: DataFrame, uid: str = "uid", label: str = "sentiment", order: str = "msg_id") -> DataFrame:
    """Most common label per user and its count; ties -> first seen.
    Counts per (user, label) first, then a min(struct) aggregate."""
    c = (df.filter(F.col(label).isNotNull()).groupBy(uid, label)
         .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")))
    best = c.groupBy(uid).agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("_first").alias("b"),
                                             F.col(label).alias("l"), F.col("n").alias("n"))).alias("w"))
    return best.select(uid, F.col("w.l").alias("label"), F.col("w.n").alias("n"))


def confusion_matrix(df: DataFrame, y: str = "y_true", p: str = "pred", k: int = 3) -> DataFrame:
    """(y_true, pred, n) for all k*k cells, zero cells kept."""
    counts = df.groupBy(F.col(y).alias("t"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return (_grid(k).join(counts, ["t", "p"], "left")
            .select(F.col("t").alias(y), F.col("p").alias(p), F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def class_report(df: DataFrame, y: str = "y_true", p: str = "pred", k: int = 3,
                 names: list[str] = ID_LABELS) -> DataFrame:
    """Per-class precision, recall, F1, support; macro and weighted
    averages (zero division -> 0). Computed from the k*k count grid."""
    cm = confusion_matrix(df, y, p, k)

    def count(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n")).otherwise(0)), F.lit(0))

    per = cm.groupBy().agg(
        *[count((F.col(y) == c) & (F.col(p) == c)).alias(f"tp{c}") for c in range(k)],
        *[count(F.col(p) == c).alias(f"pp{c}") for c in range(k)],
        *[count(F.col(y) == c).alias(f"ts{c}") for c in range(k)],
    )
    rows = []
    for c in range(k):
        prec = _safe_div(F.col(f"tp{c}"), F.col(f"pp{c}"))
        rec = _safe_div(F.col(f"tp{c}"), F.col(f"ts{c}"))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(names[c]).alias("class"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), F.col(f"ts{c}").cast("long").alias("support")))
    per_class = per.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    agg = per_class.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
        F.sum("support").cast("long").alias("n"))
    avgs = agg.select(F.explode(F.array(
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")))).alias("r")).select("r.*")
    return per_class.unionByName(avgs)


def accuracy(df: DataFrame, y: str = "y_true", p: str = "pred") -> DataFrame:
    """Share correct; 0 when empty."""
    return df.agg(F.count_if(F.col(y) == F.col(p)).alias("correct"), F.count(F.lit(1)).alias("n")).select(
        "correct", "n", _safe_div(F.col("correct"), F.col("n")).alias("accuracy"))


def weighted_f1(df: DataFrame, y: str = "y_true", p: str = "pred", k: int = 3) -> DataFrame:
    """Support-weighted F1."""
    rep = class_report(df, y, p, k)
    return rep.filter(F.col("class") == "weighted avg").select(F.col("f1").alias("weighted_f1"))


def roc_auc_ovr(df: DataFrame, y: str = "y_true", prob_cols: list[str] = ("p0", "p1", "p2")) -> DataFrame:
    """One-vs-rest ROC AUC per class (ties count half) and the macro
    mean. Scores are grouped to distinct values, then the negatives below
    each value come from distributed prefix sums."""
    k = len(prob_cols)
    long = df.select(F.col(y).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.col(prob_cols[c]).cast("double").alias("s")) for c in range(k)])).alias("r"))
    g = (long.select("r.cls", "r.s", (F.col("_y") == F.col("r.cls")).alias("pos"))
         .groupBy("cls", "s").agg(F.count_if("pos").alias("np"), F.count_if(~F.col("pos")).alias("nn")))
    ps = prefix_sums(g, ["cls", "s"], ["nn"])
    # the prefix runs over (cls, s); subtract the negatives of earlier classes
    first = ps.groupBy("cls").agg(F.min("nn_before").alias("_base"))
    per = (ps.join(F.broadcast(first), "cls")
           .groupBy("cls").agg(
               F.sum(F.col("np") * (F.col("nn_before") - F.col("_base") + F.col("nn") * 0.5)).alias("_u"),
               F.sum("np").alias("_p"), F.sum("nn").alias("_n")))
    auc = per.select("cls", F.try_divide("_u", F.col("_p").cast("double") * F.col("_n")).alias("auc"))
    return auc


def macro_auc(auc: DataFrame) -> DataFrame:
    return auc.agg(F.avg("auc").alias("roc_auc"))


def log_loss(df: DataFrame, y: str = "y_true", prob_cols: list[str] = ("p0", "p1", "p2"), eps: float = EPS) -> DataFrame:
    """-mean ln p(true class), clipped to [eps, 1-eps]."""
    probs = F.array(*[F.col(c).cast("double") for c in prob_cols])
    pt = F.element_at(probs, F.col(y).cast("int") + 1)
    clipped = F.least(F.greatest(pt, F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.ln(clipped))).alias("log_loss"))


def _moments(df: DataFrame, d: Column) -> DataFrame:
    d = d.cast("decimal(19,0)")  # the powers of long values outgrow a long
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"),
                  F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4"))


def paired_diff_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Means, population SDs, standard errors, the 2*(se_a+se_b) flag
    and the paired t statistic of d = a - b with its two-sided p. Inputs should be integers
    (e.g. 0/1 correctness) so the power sums are exact."""
    A, B = F.col(a).cast("long"), F.col(b).cast("long")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(A).alias("sa"), F.sum(A * A).alias("saa"),
               F.sum(B).alias("sb"), F.sum(B * B).alias("sbb"),
               F.sum(A - B).alias("sd"), F.sum((A - B) * (A - B)).alias("sdd"))
    n = F.col("n").cast("double")
    mean_a, mean_b, mean_d = F.col("sa") / n, F.col("sb") / n, F.col("sd") / n
    sd_a = F.sqrt(F.greatest(F.col("saa") / n - mean_a * mean_a, F.lit(0.0)))
    sd_b = F.sqrt(F.greatest(F.col("sbb") / n - mean_b * mean_b, F.lit(0.0)))
    se_a, se_b = sd_a / F.sqrt(n), sd_b / F.sqrt(n)
    var_d = (F.col("sdd") - F.col("sd") * F.col("sd") / n) / (n - 1)
    t = F.try_divide(mean_d, F.sqrt(var_d / n))  # null for identical inputs
    return s.select(F.col("n"), mean_a.alias("mean_a"), mean_b.alias("mean_b"), mean_d.alias("mean_diff"),
                    sd_a.alias("sd_a"), sd_b.alias("sd_b"), se_a.alias("se_a"), se_b.alias("se_b"),
                    (F.abs(mean_a - mean_b) > 2 * (se_a + se_b)).alias("beyond_2se"), t.alias("t_stat")) \
        .withColumn("p_value", student_p_two_sided(F.col("t_stat"), F.col("n") - 1))


def wilcoxon_signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank statistic of d = a - b: zero differences dropped,
    average ranks of |d| for ties, W+ and W-, normal approximation z with
    tie correction. Distinct |d| values are ranked by prefix sums. The
    two-sided p is exact up to 50 differences without ties, else normal."""
    d = (F.col(a) - F.col(b))
    g = (df.select(d.alias("d")).filter(F.col("d") != 0)
         .groupBy(F.abs("d").alias("ad")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("cp")))
    ps = prefix_sums(g, ["ad"], ["c"])
    rank = F.col("c_before") + (F.col("c") + 1) / 2.0
    c = F.col("c").cast("decimal(12,0)")  # its cube outgrows a long
    s = ps.agg(F.sum(F.col("cp") * rank).alias("w_plus"), F.sum((F.col("c") - F.col("cp")) * rank).alias("w_minus"),
               F.sum("c").cast("long").alias("n"), F.sum(c * c * c - c).alias("ties"))
    n = F.col("n").cast("double")
    mu = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties").cast("double") / 48.0
    ties = F.col("ties").try_cast("long").alias("ties")  # null where a long cannot hold it
    tested = s.select("w_plus", "w_minus", "n", ties, F.try_divide(F.col("w_plus") - mu, F.sqrt(var)).alias("z"))
    exact = (F.col("n") <= 50) & (F.col("ties") == 0)
    return tested.withColumn("p_value", F.when(exact, signed_rank_p_two_sided(F.col("w_plus"), F.when(exact, F.col("n"))))
                             .otherwise(normal_p_two_sided(F.col("z"))))


def normality_check(df: DataFrame, col: str) -> DataFrame:
    """A33 (re-aimed Shapiro-Wilk gate): skewness, excess kurtosis and the
    Jarque-Bera statistic from exact integer power sums."""
    x = F.col(col).cast("long")
    m = _moments(df, x)
    n = F.col("n").cast("double")
    mu = F.col("s1") / n
    m2 = F.col("s2") / n - mu * mu
    m3 = F.col("s3") / n - 3 * mu * F.col("s2") / n + 2 * mu * mu * mu
    m4 = F.col("s4") / n - 4 * mu * F.col("s3") / n + 6 * mu * mu * F.col("s2") / n - 3 * mu * mu * mu * mu
    skew = F.try_divide(m3, F.pow(m2, 1.5))  # null for a constant column
    kurt = F.try_divide(m4, m2 * m2) - 3
    return m.select("n", skew.alias("skewness"), kurt.alias("kurtosis"),
                    (n / 6 * (skew * skew + kurt * kurt / 4)).alias("jarque_bera"))


def paired_p_values(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(metric, n, t_stat, p_value): for each metric that is the mean of a
    value per row, the paired t test of its two columns. One pass, one
    aggregate; rows with a null are left out, equal columns and fewer than two
    rows give nulls."""
    diffs = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(a) - F.col(b)).cast("double").alias("d"))
                      for m, (a, b) in pairs.items()])
    per = df.select(F.explode(diffs).alias("r")).groupBy("r.metric").agg(
        F.count("r.d").alias("n"), F.avg("r.d").alias("mean"), F.var_samp("r.d").alias("var"))
    t = F.try_divide(F.col("mean"), F.sqrt(F.col("var") / F.col("n")))
    return per.select("metric", "n", t.alias("t_stat")).withColumn(
        "p_value", student_p_two_sided(F.col("t_stat"), F.col("n") - 1))


def metric_verdict(metrics: DataFrame, baseline: str = "a", candidate: str = "b", margin: float = 1.05,
                   z: DataFrame | None = None, lower_is_better: tuple[str, ...] = ("log_loss",),
                   p_values: DataFrame | None = None, level: float = 0.05) -> DataFrame:
    """Per metric, practical improvement if candidate > margin x
    baseline, or baseline > margin x candidate where lower is better. With
    ``p_values`` (metric, p_value) each metric has its own p, significant
    below ``level`` (null without a p); with ``z`` instead, significant if
    |z| of one paired test exceeds the 5 % value."""
    w = metrics.groupBy("metric").pivot("model", [baseline, candidate]).agg(F.first("value"))
    out = w.select("metric", F.col(baseline).alias("baseline"), F.col(candidate).alias("candidate"),
                   F.when(F.col("metric").isin(*lower_is_better), F.col(baseline) > F.col(candidate) * margin)
                   .otherwise(F.col(candidate) > F.col(baseline) * margin).alias("practical"))
    if p_values is not None:
        # one row a metric on either side
        out = out.join(p_values.select("metric", "p_value"), "metric", "left").withColumn("significant", F.col("p_value") < level)
    elif z is not None:
        sig = z.select((F.abs(F.col("z")) > Z_05).alias("significant"))
        out = _attach_one_row(out, sig)
    return out


def metric_table(scored: dict[str, DataFrame]) -> DataFrame:
    """Long table (model, metric, value) of tables with y_true, pred and p0 to
    p2: accuracy, F1 averages, log loss and macro one-vs-rest ROC AUC."""
    parts = []
    for model, s in scored.items():
        acc = accuracy(s).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
        rep = class_report(s).filter(F.col("class").isin("macro avg", "weighted avg")).select(
            F.concat(F.lit("f1 "), F.col("class")).alias("metric"), F.col("f1").alias("value"))
        ll = log_loss(s).select(F.lit("log_loss").alias("metric"), F.col("log_loss").alias("value"))
        auc = macro_auc(roc_auc_ovr(s)).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
        parts.append(acc.unionByName(rep).unionByName(ll).unionByName(auc).withColumn("model", F.lit(model)))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def paired_rows(a: DataFrame, b: DataFrame, key: str = "msg_id") -> DataFrame:
    """Per key of both scored tables the models' correctness (ca, cb) and
    loss (la, lb)."""
    def one(s: DataFrame, model: str) -> DataFrame:
        true = F.element_at(F.array("p0", "p1", "p2"), F.col("y_true").cast("int") + 1)
        return s.select(key, (F.col("pred") == F.col("y_true")).cast("int").alias(f"c{model}"),
                        (-F.ln(F.least(F.greatest(true, F.lit(EPS)), F.lit(1 - EPS)))).alias(f"l{model}"))

    return one(a, "a").join(one(b, "b"), key)


def compared(a: DataFrame, b: DataFrame, key: str = "msg_id") -> DataFrame:
    """The verdict on each metric of two scored tables. Accuracy and log
    loss are means over rows and have the p of a paired test of their own."""
    p = paired_p_values(paired_rows(a, b, key), {"accuracy": ("ca", "cb"), "log_loss": ("la", "lb")})
    return metric_verdict(metric_table({"a": a, "b": b}), p_values=p)


def compared_cells(scored: dict[str, DataFrame]) -> DataFrame:
    """The confusion matrices of several models, one row a cell."""
    parts = [confusion_matrix(s).withColumn("model", F.lit(m)) for m, s in scored.items()]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def verdict_sentences(verdict: DataFrame) -> DataFrame:
    """(place, line): two sentences on a verdict with p values, naming the
    metrics that differ significantly and those of them that improve by the
    margin, or none."""
    def named(where: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(where, F.col("metric")))), ", ")

    lists = verdict.agg(named(F.col("significant")).alias("a"), named(F.col("significant") & F.col("practical")).alias("b"))

    def line(place: int, start: str, names: str) -> Column:
        return F.struct(F.lit(place).alias("place"), F.concat(F.lit(start), F.when(F.col(names) == "", "no metric")
                                                              .otherwise(F.col(names)), F.lit(".")).alias("line"))

    return lists.select(F.explode(F.array(line(1, "Statistically significant difference on ", "a"),
                                          line(2, "Practically significant improvement on ", "b"))).alias("r")).select("r.*")


def qq_points(df: DataFrame, col: str, points: int = 99) -> DataFrame:
    """(i, theoretical, sample) for i in 1..points: the normal quantile
    and the sample's own at (i - 1/2) / points. Values are counted first, and
    ranks come from distributed prefix sums, so only distinct values are
    ordered. Nulls are left out."""
    counts = df.select(F.col(col).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranked = _attach_one_row(prefix_sums(counts, ["v"], ["c"]), counts.agg(F.sum("c").alias("n")))
    # the points whose rank ceil((i - 1/2) / points * n) falls among a value's ranks
    scaled = F.lit(2 * points) * F.col("c_before")
    first = F.floor((scaled + F.col("n")) / (2 * F.col("n"))) + 1
    last = F.floor((scaled + 2 * points * F.col("c") + F.col("n")) / (2 * F.col("n")))
    rows = ranked.withColumns({"first": F.greatest(first, F.lit(1)), "last": F.least(last, F.lit(points))}) \
        .filter(F.col("first") <= F.col("last")).select("v", F.explode(F.sequence("first", "last")).alias("i"))
    return rows.select(F.col("i").cast("int").alias("i"), normal_quantile((F.col("i") - 0.5) / points).alias("theoretical"),
                       F.col("v").cast("double").alias("sample"))


def _attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (as typed literals)."""
    from .scalars import attach_one_row
    return attach_one_row(df, one)


def metric_deltas(metrics: DataFrame, baseline: str = "a", candidate: str = "b") -> DataFrame:
    """Baseline minus candidate per scalar metric."""
    w = metrics.groupBy("metric").pivot("model", [baseline, candidate]).agg(F.first("value"))
    return w.select("metric", (F.col(baseline) - F.col(candidate)).alias("delta"))


def histogram_bins(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), all
    bins kept."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    xc = F.col("x")
    # a constant column has all its rows in the first bin
    b = F.least(F.floor(F.try_divide(xc - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    b = F.when(F.col("hi") > F.col("lo"), b)
    counts = _attach_one_row(df.select(x.alias("x")), rng).select(
        F.coalesce(b, F.lit(0)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Class weight n / (k * n_c) per row. Class counts are a tiny
    aggregate (one row per class) broadcast back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_classes"))
    w = _attach_one_row(counts, tot).select(label, (F.col("_n") / (F.col("_classes") * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(w), label, "left")
