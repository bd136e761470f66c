"""Spark ML operators (M08-M22): scaling, projection, classifiers with and
without the user vector, model selection and explanation.

Training data stays distributed. Spark ML estimators keep fitted parameters on
the driver (feature count x classes); the text models over all terms are those of
:mod:`~chatspark.operators.logreg`, whose coefficients are a table.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, CountVectorizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .logreg import TermBlocks, TextLogreg, fit_logreg, fit_steps
from .scalars import attach_one_row
from .topics import ALL_TERMS, terms
from .trees import SparseDecisionTree, SparseRandomForest


def text_features(df: DataFrame, text: str = "content", out: str = "text_vec") -> DataFrame:
    """Token column for the vectorizer stages (no tokens for a null text)."""
    return df.withColumn("_terms", F.coalesce(terms(text), F.array().cast("array<string>")))


def tfidf_stages(vocab_size: int | None = None, out: str = "text_vec"):
    """CountVectorizer + IDF stages (Spark's idf is ln((n+1)/(df+1))) over all
    terms, or the ``vocab_size`` most frequent ones."""
    return [CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocab_size or ALL_TERMS, minDF=1.0),
            IDF(inputCol="_tf", outputCol=out)]


def maxabs_tfidf_stages(vocab_size: int | None = None, out: str = "text_vec"):
    """The same, each term's weight divided by its largest in the fitted rows."""
    from pyspark.ml.feature import MaxAbsScaler
    return [*tfidf_stages(vocab_size, out="_unscaled"), MaxAbsScaler(inputCol="_unscaled", outputCol=out)]


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean, unit population variance, per column (SQL aggregates,
    one pass; the statistics row is broadcast)."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = attach_one_row(df, stats)
    return j.select(*[c for c in df.columns if c not in cols],
                    *[F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c)
                      for c in cols])


def maxabs_scale(train: DataFrame, apply_to: DataFrame, cols: list[str]) -> DataFrame:
    """Divide by the max |x| per column, fitted on ``train`` only."""
    m = train.agg(*[F.max(F.abs(c)).alias(f"_a_{c}") for c in cols])
    j = attach_one_row(apply_to, m)
    return j.select(*[c for c in apply_to.columns if c not in cols],
                    *[F.coalesce(F.col(c) / F.nullif(F.col(f"_a_{c}"), F.lit(0.0)), F.col(c)).alias(c) for c in cols])


def pca_scores(df: DataFrame, cols: list[str], k: int = 2, out: str = "pca") -> DataFrame:
    """PCA fitted once over all rows (k <= number of columns);
    scores as an array column."""
    k = min(k, len(cols))
    v = assemble(df, cols, "_v")
    scaled = StandardScaler(inputCol="_v", outputCol="_vs", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=k, inputCol="_vs", outputCol="_p").fit(scaled)
    return model.transform(scaled).withColumn(out, vector_to_array("_p")).drop("_v", "_vs", "_p")


def train_classifier(train: DataFrame, kind: str = "logreg", label: str = "label", features: str = "features",
                     weight: str | None = None, seed: int = 69, **params):
    """One classifier on an assembled feature column (M15: svm.py)."""
    if kind == "tree":
        est = SparseDecisionTree(labelCol=label, featuresCol=features, impurity="gini",
                                 maxDepth=min(params.get("maxDepth", 10), 30), seed=seed)
    elif kind == "forest":
        est = SparseRandomForest(labelCol=label, featuresCol=features, numTrees=params.get("numTrees", 150),
                                 maxDepth=min(params.get("maxDepth", 30), 30), seed=seed)
    else:
        est = LogisticRegression(labelCol=label, featuresCol=features, maxIter=params.get("maxIter", 50),
                                 regParam=params.get("regParam", 0.01), family="multinomial")
    if weight and hasattr(est, "setWeightCol"):
        est.setWeightCol(weight)
    return est.fit(train)


def text_pipeline(vocab_size: int | None = None, extra_cols: list[str] | None = None, max_iter: int = 50,
                  reg: float = 0.01) -> Pipeline:
    """M17 (no extra columns) / M18 (``extra_cols`` = scaled user vector):
    TF-IDF text vector, optionally concatenated with the user vector, then
    multinomial logistic regression."""
    stages = tfidf_stages(vocab_size)
    inputs = ["text_vec"]
    if extra_cols:
        stages.append(VectorAssembler(inputCols=extra_cols, outputCol="_user_raw"))
        stages.append(StandardScaler(inputCol="_user_raw", outputCol="_user_vec", withMean=True, withStd=True))
        inputs.append("_user_vec")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    stages.append(LogisticRegression(labelCol="label", featuresCol="features", maxIter=max_iter, regParam=reg,
                                     family="multinomial"))
    return Pipeline(stages=stages)


def batch_predict(model: PipelineModel | TextLogreg, df: DataFrame, key: str = "msg_id") -> DataFrame:
    """Label id, label and class probabilities for each row."""
    from .labels import id_to_label
    out = model.transform(df)
    probs = F.col("probs") if isinstance(model, TextLogreg) else vector_to_array("probability")
    return out.select(key, F.col("prediction").cast("int").alias("pred"),
                      id_to_label(F.col("prediction").cast("int")).alias("label"),
                      probs.alias("probs"))


def _coefficients(model: PipelineModel | TextLogreg, spark) -> tuple[DataFrame, int]:
    """(term, idf, c0, c1, ...) and the number of classes."""
    if isinstance(model, TextLogreg):
        return model.weights.drop("df"), len(model.intercepts)
    cv = next(s for s in model.stages if hasattr(s, "vocabulary"))
    idf = next(s for s in model.stages if hasattr(s, "idf")).idf.toArray()
    coef = model.stages[-1].coefficientMatrix.toArray()
    k = coef.shape[0]
    rows = [(t, float(idf[j]), *[float(coef[c, j]) for c in range(k)]) for j, t in enumerate(cv.vocabulary)]
    return spark.createDataFrame(rows, "term string, idf double, " + ", ".join(f"c{c} double" for c in range(k))), k


def token_contributions(model: PipelineModel | TextLogreg, df: DataFrame, key: str = "msg_id", top_k: int = 10) -> DataFrame:
    """Exact linear explanation. For class c and vocabulary term j the
    contribution to a document is coef[c, j] * (x_j - mean_j); reported is
    the mean |contribution| over documents, top-k terms per class.

    A term's weights are its idf times its counts, so the documents are first
    added up by (term, count); the coefficient table meets these, not the
    document vectors."""
    from .ordered import top_k_per_group
    from .topics import doc_terms
    table, k = _coefficients(model, df.sparkSession)
    n = float(df.count())
    seen = cut_lineage(doc_terms(df, key, "content").groupBy("term", "tf").agg(F.count(F.lit(1)).alias("_d"))
                       .join(table.select("term", "idf"), "term").withColumn("x", F.col("tf") * F.col("idf")))
    means = seen.groupBy("term").agg((F.sum(F.col("x") * F.col("_d")) / n).alias("_mu"), F.sum("_d").alias("_df"))
    present = seen.join(means, "term").groupBy("term").agg(F.sum(F.col("_d") * F.abs(F.col("x") - F.col("_mu"))).alias("_s"))
    spread = present.join(means, "term").select("term", ((F.col("_s") + (n - F.col("_df")) * F.abs("_mu")) / n).alias("_spread"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"c{c}").alias("coef")) for c in range(k)])).alias("_c")
    mean_abs = (spread.join(table.select("term", cells), "term").filter("_c.coef != 0")
                .select("_c.cls", "term", (F.abs("_c.coef") * F.col("_spread")).alias("mean_abs")))
    return top_k_per_group(mean_abs, ["cls"], [F.desc("mean_abs"), F.asc("term")], top_k, rank_col="rank", salt_buckets=8)


def grid_search(train: DataFrame, label: str = "label", seed: int = 69, reg_params=(0.0, 0.01, 0.1), max_iters=(10, 50)):
    """A real grid (every run differs) chosen on a held-out fifth of the rows
    (``_terms``, ``label``). Returns (the best setting's model fitted to all rows,
    [(reg, max_iter, accuracy)]). The vectors are made once; a fit of more steps
    passes those of fewer."""
    d = cut_lineage(train.select(label, "_terms", F.rand(seed).alias("_u")))
    data = TermBlocks(d.filter("_u < 0.8"), label, [])
    try:
        stops = sorted(max_iters)
        grid = [(r, i) for r in reg_params for i in stops]
        found = [f for r in reg_params for f in fit_steps(data, r, stops)]
        rows = [(r, i, v) for (r, i), v in zip(grid, data.accuracies(found, d.filter("_u >= 0.8"), label))]
    finally:
        data.blocks.unpersist()
    best = max(rows, key=lambda r: r[2])
    return fit_logreg(d, reg=best[0], max_iter=best[1], label=label), rows


def accuracy_by_steps(train: DataFrame, held_out: DataFrame, steps: list[int], reg: float = 0.01,
                      label: str = "label") -> list[float]:
    """Accuracy on ``held_out`` of fits with each of ``steps`` (rising) iterations."""
    data = TermBlocks(train, label, [])
    try:
        return data.accuracies(fit_steps(data, reg, steps), held_out, label)
    finally:
        data.blocks.unpersist()


def select_best(metrics: DataFrame, by: str = "accuracy", patience: int = 2, larger_is_better: bool = True) -> DataFrame:
    """Per run (epoch-like ``step``), keep the best by ``by``; stop at the
    first step that is ``patience`` steps past the last strict gain -> rows up
    to that stop, best flag. The metric table has one row per run."""
    from pyspark.sql import Window
    w = Window.orderBy("step")
    score = F.col(by) if larger_is_better else -F.col(by)
    before = F.max("_score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = metrics.withColumn("_score", score).withColumn("_nr", F.row_number().over(w)).withColumn("_before", before)
    m = m.withColumn("_gain", F.when(F.col("_before").isNull() | (F.col("_score") > F.col("_before")), F.col("_nr")))
    m = m.withColumn("_last", F.max("_gain").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_stops", F.sum(F.when(F.col("_nr") - F.col("_last") >= patience, 1).otherwise(0))
                     .over(w.rowsBetween(Window.unboundedPreceding, -1)))
    kept = m.filter(F.coalesce("_stops", F.lit(0)) == 0)
    whole = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return kept.withColumn("_best", F.max("_last").over(whole)).select("step", by, (F.col("_nr") == F.col("_best")).alias("best"))


def scale_user_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """StandardScaler (sample SD) of the user columns -> ``user_scaled``."""
    v = assemble(df, cols, "_u")
    return StandardScaler(inputCol="_u", outputCol="user_scaled", withMean=True, withStd=True).fit(v).transform(v).drop("_u")

