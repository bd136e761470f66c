"""Row numbers stay when the scan is split in another way."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("many") / "documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(40).write.parquet(path)
    return path


@pytest.fixture
def splits(spark):
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n, None) for n in names}

    def set_(parallelism, cost):
        spark.conf.set(names[0], parallelism)
        spark.conf.set(names[1], cost)
        spark.conf.set(names[2], cost * 4)

    yield set_
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_numbers_of_a_scan(spark, many_files, splits):
    from chatspark.llm.common import numbered
    docs = spark.read.parquet(many_files).withColumn("row_key", F.lit("x")).filter("doc_id >= 0")
    seen = numbered(docs, id=F.col("doc_id"), other=F.col("row_key"))
    splits(4, 1 << 22)
    first = {r["row_key"]: r["id"] for r in seen.collect()}
    splits(16, 1 << 12)
    again = {r["row_key"]: r["id"] for r in seen.select("row_key", "id").collect()}
    assert first == again and len(first) == docs.count()


def test_numbers_of_other_inputs(spark):
    from chatspark.llm.common import numbered
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert numbered(docs, id=F.col("doc_id")).select("row_key").distinct().count() == docs.count()
    made = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, row_key string")
    assert sorted(r["id"] for r in numbered(made, id=F.col("doc_id")).collect()) == [1, 1]
    assert numbered(made.limit(0), id=F.col("doc_id")).count() == 0


@pytest.mark.parametrize("operator", ["near_duplicates", "radix_dedup", "stupid_backoff", "find_secrets", "quality stage"])
def test_results_stay(spark, many_files, splits, monkeypatch, operator):
    """The split changes after every table that an operator writes."""
    import corpus_pipeline
    from chatspark.llm import common, exact_dedup, lm_score, near_dup, secrets
    docs = spark.read.parquet(many_files)

    def run():
        if operator == "quality stage":
            return corpus_pipeline.quality(spark, docs, SF).select("doc_id", "text")
        if operator == "find_secrets":
            return secrets.find_secrets(docs, secrets.BASE_RULES).select("doc_id", "spans")
        if operator == "stupid_backoff":
            return lm_score.stupid_backoff(docs).select("doc_id", "n_words", F.round("log10_sum", 6))
        if operator == "radix_dedup":
            return exact_dedup.radix_dedup(docs).drop("row_key")
        return near_dup.near_duplicates(docs).groupBy("class_id").agg(F.sort_array(F.collect_list("doc_id"))).drop("class_id")

    want = sorted(map(str, run().collect()))
    turn = [0]
    plain = common.materialize

    def changing(df, name):
        out = plain(df, name)
        turn[0] += 1
        splits(*((16, 1 << 12) if turn[0] % 2 else (4, 1 << 22)))
        return out

    for module in (near_dup, exact_dedup, lm_score, secrets, corpus_pipeline):
        monkeypatch.setattr(module, "materialize", changing)
    splits(4, 1 << 22)
    assert sorted(map(str, run().collect())) == want and turn[0]


def test_stages_drop_their_tables(spark, many_files):
    import os

    import corpus_pipeline
    docs = spark.read.parquet(many_files)
    corpus_pipeline.exact_dedup(spark, docs, SF).count()
    paths = [p.removeprefix("file:") for p in corpus_pipeline._TABLES]
    assert paths and all(os.path.exists(p) for p in paths)
    corpus_pipeline.quality(spark, docs, SF).count()
    assert not any(os.path.exists(p) for p in paths)
