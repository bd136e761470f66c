"""Buffers of a channel: a stream's batches give the same vectors as one pass."""

import random

import pytest
from pyspark.sql import functions as F

from chatspark.operators import features as FT
from chatspark.sources.fixtures import Fixtures
from chatspark.streaming.blocks import BlockVectors, places

SF = "/root/testdata/sf0.01"
N = 60


@pytest.fixture(scope="module")
def msgs(spark):
    m = Fixtures(spark, SF).msgs.withColumn("channel", F.split("uid", "-")[0])
    return m.withColumn("channel", F.when(F.col("msg_id") % 40 != 0, F.col("channel"))).cache()


def _expected(spark, msgs, n):
    """The features of each full buffer, found in Python, from one batch."""
    seen, where = {}, []
    for r in sorted(msgs.filter("length(content) >= 25").select("msg_id", "channel").collect(), key=lambda r: r["msg_id"]):
        i = seen.get(r["channel"], 0)
        seen[r["channel"]] = i + 1
        where.append((r["msg_id"], f"{r['channel']}@{i // (n + 1)}"))
    named = msgs.drop("uid").join(spark.createDataFrame(where, "msg_id long, uid string"), "msg_id")
    users = FT.user_features(named, min_msgs=n + 1, pos_lexicon=Fixtures(spark, SF).pos_lexicon, drop_incomplete=False)
    return {r["uid"]: r.asDict() for r in users.collect()}


def _found(blocks, spark):
    out = blocks.full(pos_lexicon=Fixtures(spark, SF).pos_lexicon, drop_incomplete=False)
    return {f"{r['channel']}@{r['block']}": r.asDict() for r in out.collect()}


def test_batches_equal_one_pass(spark, msgs, tmp_path):
    want = _expected(spark, msgs, N)
    assert len(want) > 5 and any(k.startswith("None") for k in want) is False
    blocks = BlockVectors(spark, str(tmp_path / "b"), N)
    cuts = [-1, 137, 400, 401, 10**9]
    parts = [msgs.filter((F.col("msg_id") > a) & (F.col("msg_id") <= b)) for a, b in zip(cuts, cuts[1:])]
    for i, part in enumerate(parts):
        blocks.write_batch(part, i)
        blocks.write_batch(part, i)          # a repeated batch counts once
        if i == 1:
            blocks.store.compact()
    got = _found(blocks, spark)
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k]["n_msgs"] == N + 1
        for f in FT.VECTOR_FEATURES:
            assert got[k][f] == pytest.approx(w[f], abs=1e-9), (k, f)


def test_places_number_each_channel(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, ""])) for i in rng.sample(range(10**6), 500)]
    placed, counts = places(spark.createDataFrame(rows, "msg_id long, channel string"), "channel")
    want = {}
    for c in {c for _, c in rows}:
        for k, i in enumerate(sorted(i for i, d in rows if d == c)):
            want[i] = (c, k)
    assert {r["msg_id"]: (r["channel"], r["place"]) for r in placed.collect()} == want
    assert {r["channel"]: r["rows"] for r in counts.collect()} == {c: sum(d == c for _, d in rows) for _, c in rows}


def test_short_null_and_no_messages(spark, tmp_path):
    blocks = BlockVectors(spark, str(tmp_path / "b"), 1)
    empty = spark.createDataFrame([], "msg_id long, content string, sentiment string, uid string, channel string")
    blocks.write_batch(empty, 0)
    long = "a message that is long enough to count"
    rows = [(1, long, "pos", "u", "c"), (2, "short", "pos", "u", "c"), (3, None, "pos", "u", "c"), (4, long, "neg", "u", "c"),
            (5, long, "neg", "u", "c")]
    blocks.write_batch(spark.createDataFrame(rows, empty.schema), 1)
    lexicon = Fixtures(spark, SF).pos_lexicon
    assert [(r["channel"], r["block"], r["n_msgs"]) for r in blocks.full(lexicon).collect()] == [("c", 0, 2)]
