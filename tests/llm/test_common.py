"""What the shared helpers leave on disk."""

import os

from pyspark.sql import functions as F


def _shuffle_files(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for top in root for _, _, names in os.walk(str(top)) for name in names if name.startswith("shuffle_")}


def test_materialize_leaves_no_shuffle_files(spark):
    from chatspark.llm.common import materialize
    before = _shuffle_files(spark)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "common-test")
    assert not _shuffle_files(spark) - before
    assert sorted(r["count"] for r in out.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_likely_keeps_all_that_match_and_few_others(spark, monkeypatch):
    from chatspark.llm import common
    rows = spark.range(20_000).select(F.when(F.col("id") > 5, F.col("id")).alias("k"), F.lit("t").alias("text"))
    rows = rows.unionByName(rows.filter("k % 100 = 0"))
    keys = spark.range(0, 30_000, 50).select(F.col("id").alias("k")).unionByName(spark.sql("select cast(null as long) k"))
    for bits in (common.FILTER_BITS, 1 << 6):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = common.likely(rows, keys, "k")
        assert got.columns == ["k", "text"] and not got.filter("k is null").count()
        assert got.join(keys, "k").count() == rows.join(keys, "k").count() == 598
        assert got.count() < 700 or bits == 1 << 6
    assert common.likely(rows, keys.limit(0), "k").count() == 0
