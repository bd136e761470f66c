"""Joins with hot keys apart, labelers that raise, small guards."""

import uuid

import pytest
from pyspark.sql import functions as F

from chatspark.operators import clean as C
from chatspark.operators import joins as J
from chatspark.operators import labels as L
from chatspark.operators import sets as S
from chatspark.session import shared_path


def test_split_join_equals_join_and_keeps_hot_rows_in_place(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_SHARE", 10)
    rows = spark.createDataFrame([(i, "the" if i % 2 else f"w{i % 40}" if i % 7 else None) for i in range(2000)], "i int, term string")
    facts = rows.filter("term is not null and term != 'w6'").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for how in ("inner", "left"):
        got = sorted(map(str, J.split_join(rows, facts, "term", "df", how).select("i", "term", "df").collect()))
        assert got == sorted(map(str, rows.join(facts, "term", how).select("i", "term", "df").collect()))
    plan = J.split_join(rows, facts, "term", "df")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Cartesian" not in text
    assert J.split_join(rows, facts.limit(0), "term", "df").count() == 0
    with pytest.raises(ValueError):
        J.split_join(rows, facts, "term", "df", "outer")


def test_one_raising_row_gives_one_reject(spark):
    chunks = spark.range(10_000).select(F.col("id").alias("msg_id"), F.lit(0).alias("chunk_id"), F.col("id").cast("string").alias("chunk"))

    def label(pdf):
        if (pdf["chunk"] == "7777").any():
            raise RuntimeError("no such luck")
        return ["pos"] * len(pdf)

    path = shared_path(spark, "tests", f"labels-{uuid.uuid4().hex[:8]}")
    for _ in range(2):  # a repeated run overwrites
        counts = L.write_with_rejects(L.isolated_labeler(label)(chunks), f"{path}/labels", f"{path}/rejects")
        assert counts == {"rows": 10_000, "rejects": 1}
    assert [tuple(r) for r in spark.read.parquet(f"{path}/rejects").collect()] == [(7777, 0, "RuntimeError: no such luck")]
    labels = {r["label"]: r["count"] for r in spark.read.parquet(f"{path}/labels").groupBy("label").count().collect()}
    assert labels == {"pos": 9999, "Err": 1}
    votes = L.run_labelers(chunks, [L.isolated_labeler(label)])
    assert votes.filter("label = 'Err'").count() == 1


def test_wrong_number_of_labels_and_empty_input(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "msg_id long, chunk_id int, chunk string").coalesce(1)
    out = L.isolated_labeler(lambda pdf: ["x"])(chunks).collect()  # right for single rows only
    assert [(r["label"], r["error"]) for r in out] == [("x", None)] * 2
    assert L.isolated_labeler(lambda pdf: [])(chunks.limit(0)).count() == 0
    assert {r["error"] for r in L.isolated_labeler(lambda pdf: [])(chunks).collect()} == {"ValueError: 0 labels for 1 rows"}


def test_rename_needs_all_names(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert C.rename_positional(df, ["p", "q"]).columns == ["p", "q"]
    for names in (["p"], ["p", "q", "r"]):
        with pytest.raises(ValueError):
            C.rename_positional(df, names)


@pytest.mark.parametrize("n,test_size,want", [(10, 0.15, 2), (100, 0.15, 15), (101, 0.15, 16), (1, 0.5, 1), (7, 0.0, 0)])
def test_split_takes_the_ceiling(spark, n, test_size, want):
    df = spark.range(n).withColumnRenamed("id", "msg_id")
    assert S.split_test_size(df, test_size).filter("split = 'test'").count() == want
