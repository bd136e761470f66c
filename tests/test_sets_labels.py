"""Splits, ordering helpers and labelling operators."""

from pyspark.sql import functions as F

from chatspark.operators import labels as L
from chatspark.operators import sets as S
from chatspark.operators.ordered import global_index, prefix_sums, top_k_per_group


def test_exact_split_golden(spark):
    assert S.split_sizes(33026, 0.75, 0.1) == (24769, 5504, 2753)
    df = spark.range(33026).withColumnRenamed("id", "msg_id")
    counts = {r["split"]: r["count"] for r in S.split_exact(df).groupBy("split").count().collect()}
    assert counts == {"train": 24769, "val": 5504, "test": 2753}


def test_hash_split_disjoint_complete(spark):
    df = spark.range(5000).withColumnRenamed("id", "msg_id")
    s = S.split_hash(df)
    assert s.count() == 5000 and s.select("msg_id").distinct().count() == 5000
    shares = {r["split"]: r["count"] / 5000 for r in s.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.75) < 0.03


def test_global_index_and_prefix_sums(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(1000)], "k long, v long")
    idx = sorted((r["k"], r["idx"]) for r in global_index(df, ["k"], partitions=5).collect())
    assert [i for _, i in idx] == list(range(1000))
    ps = {r["k"]: r["v_before"] for r in prefix_sums(df, ["k"], ["v"], partitions=5).collect()}
    run = 0
    for k in range(1000):
        assert ps[k] == run
        run += k % 7


def test_top_k_salted_equals_plain(spark):
    df = spark.createDataFrame([(g, i, (i * 37) % 101) for g in range(3) for i in range(500)], "g int, i int, w int")
    order = [F.desc("w"), F.asc("i")]
    a = sorted(tuple(r) for r in top_k_per_group(df, ["g"], order, 5, salt_buckets=8).collect())
    b = sorted(tuple(r) for r in top_k_per_group(df, ["g"], order, 5).collect())
    assert a == b and len(a) == 15


def test_ensemble_vote_ties_and_literal(spark):
    votes = spark.createDataFrame([
        (1, 0, 0, "positive"), (1, 0, 1, "neg"), (1, 0, 2, "pos"), (1, 0, 3, "negative"), (1, 0, 4, "neutral"),
    ], "msg_id long, chunk_id int, labeler int, label string")
    assert L.ensemble_vote(votes).first()["label"] == "pos"           # 2-2 tie: earliest vote wins
    assert L.ensemble_vote(votes, normalize=False).first()["label"] == "neu"  # pos/neg spellings -> neu


def test_label_maps_and_softmax(spark):
    df = spark.createDataFrame([("joy", 0.0, 1.0, 2.0), ("Err", 3.0, 3.0, 1.0)], "e string, a double, b double, c double")
    r = df.select(L.emotion_to_sentiment("e").alias("s"), L.softmax(F.array("a", "b", "c")).alias("p")).collect()
    assert [x["s"] for x in r] == ["pos", "neu"]
    for x in r:
        assert abs(sum(x["p"]) - 1) < 1e-12
    assert df.select(L.argmax(F.array("a", "b", "c"))).collect()[1][0] == 0   # first max wins


def test_collapse_multihot(spark):
    from chatspark.functions.lexicons import EMOTIONS
    row = {e: 0 for e in EMOTIONS}
    row.update(joy=1, love=1, anger=1)
    df = spark.createDataFrame([("t", 1, 0, *[row[e] for e in EMOTIONS])],
                               "text string, id long, example_very_unclear int, " + ", ".join(f"{e} int" for e in EMOTIONS))
    out = L.collapse_multihot(df)
    assert out.columns == ["text", "id", "sentiment"] and out.first()["sentiment"] == "pos"


def test_lexicon_score_of_any_text_and_both_joins(spark, monkeypatch):
    from chatspark.operators import labels
    rows = [(1, "Good good bad"), (2, "nothing here"), (3, None), (4, ""), (5, "!!!"), (6, "bad " * 2000)]
    msgs = spark.createDataFrame(rows, "msg_id long, content string")
    lexicon = spark.createDataFrame([("good", 2), ("bad", -1)], "word string, weight int")
    want = {1: 3, 2: 0, 3: 0, 4: 0, 5: 0, 6: -2000}
    for small in (True, False):
        monkeypatch.setattr(labels, "small_side", lambda df: (df, small))
        got = labels.lexicon_score(msgs, lexicon).collect()
        assert len(got) == 6 and {r["msg_id"]: r["score"] for r in got} == want
    assert labels.lexicon_score(msgs.limit(0), lexicon).count() == 0


def test_shared_column_profile_and_one_user_rule(spark):
    from chatspark.operators import clean, sets
    a = spark.createDataFrame([(1, "x", None), (2, None, "y")], "msg_id long, uid string, t string")
    b = spark.createDataFrame([("x", 1, 2.0)], "uid string, msg_id long, other double")
    got = [tuple(r) for r in sets.shared_column_profile(a, b, minus=("msg_id",)).collect()]
    assert got == [("uid", 1, 1)]
    assert sets.shared_column_profile(a, b, minus=("msg_id", "uid")).count() == 0
    assert sets.shared_column_profile(a.limit(0), b).count() == 2
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, "c"), (4, None)]
    found = clean.one_user_violations(spark.createDataFrame(rows, "g int, uid string"), "g").collect()
    assert sorted(tuple(r) for r in found) == [(2, 2, 0), (3, 1, 1)]
