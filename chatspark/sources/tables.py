"""Driver tables (one parquet file each under an sf directory)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition when a scan yields fewer partitions than the
    cluster has cores (e.g. one file with a single row group), so per-row
    text work runs on every core. A large input already scans in many
    partitions and is left alone (no extra shuffle)."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_small_scans: bool = True) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if spread_small_scans else df
