"""Writers (S11-S16): pipe CSV, partitioned splits, the user feature
store, JSON reports, fitted models and the over-length side output.
Outputs are directories (one file per task), written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

WRITE_CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}


def write_pipe(df: DataFrame, path: str, sep: str = "|", mode: str = "overwrite") -> None:
    """Pipe CSV with header. Like a pandas CSV round trip, an empty
    field reads back as NULL (NULL is written empty, '' as a quoted empty
    field, and both read as NULL); blanks and newlines survive."""
    df.write.mode(mode).options(**WRITE_CSV).option("sep", sep).csv(path)


def write_splits(df: DataFrame, path: str, col: str = "split", fmt: str = "parquet") -> None:
    """One sub-directory per split value."""
    df.write.mode("overwrite").partitionBy(col).format(fmt).save(path)


def write_feature_store(users: DataFrame, path: str) -> None:
    """The user vectors as one parquet table keyed by uid."""
    users.write.mode("overwrite").parquet(path)


def read_feature_store(spark: SparkSession, path: str, uid: str | None = None) -> DataFrame:
    """The whole store, or one user (filter pushed to the scan)."""
    d = spark.read.parquet(path)
    return d if uid is None else d.filter(F.col("uid") == uid)


def write_report(df: DataFrame, path: str) -> None:
    """Verdict rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline or text model."""
    from ..operators.logreg import TextLogreg
    if isinstance(model, TextLogreg):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    from ..operators.logreg import TextLogreg
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/weights")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return TextLogreg.load(spark, path)
    return PipelineModel.load(path)


def overlength_side_output(df: DataFrame, side_path: str, max_len: int = 512, col: str = "content") -> DataFrame:
    """Rows with more than ``max_len`` tokens are written to a side table
    (a run that is repeated overwrites it) and still flow on, truncated to
    ``max_len`` tokens."""
    toks = T.tokens_ws(col)
    tagged = df.withColumn("_n", F.size(toks))
    tagged.filter(F.col("_n") > max_len).drop("_n").write.mode("overwrite").parquet(side_path)
    return (tagged.withColumn("truncated", F.col("_n") > max_len)
            .withColumn(col, F.concat_ws(" ", F.slice(toks, 1, max_len))).drop("_n"))
