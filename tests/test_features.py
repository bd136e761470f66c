"""User features: the carry method equals the joined-string definition."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chatspark.operators import features as FT

PY_SENT = re.compile(r"\w[^.!?]*[.!?]")
PY_WORD = re.compile(r"\w+")


def _messages(seed=3, users=6, per_user=40):
    rng = random.Random(seed)
    pieces = ["hello", "world", ".", "!", "?", " ", " ", "wie", "geht's", "...", "x", "\n"]
    rows, mid = [], 0
    for u in range(users):
        for _ in range(rng.randint(1, per_user)):
            mid += rng.randint(1, 3)
            rows.append((mid, f"u{u}", "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))))
    return rows


def test_sentence_len_carry_equals_joined_string(spark):
    rows = _messages()
    df = spark.createDataFrame(rows, "msg_id long, uid string, content string")
    parts = FT.sentence_parts(df)
    base = parts.groupBy("uid").agg(F.sum("k").alias("k"), F.sum("words").alias("w"))
    # a tiny block size makes the carry cross many block boundaries
    extra = FT.carried_state(parts, block=4).groupBy("uid").agg(F.count_if("carry").alias("x"))
    res = base.join(extra, "uid", "left").select("uid", "k", "w", F.coalesce("x", F.lit(0)).alias("x")).collect()
    got = {r["uid"]: (r["w"] / (r["k"] + r["x"]) if r["k"] + r["x"] else 0) for r in res}
    # definition: join the user's messages by a space in msg_id order
    by_user = {}
    for mid, u, c in sorted(rows):
        by_user.setdefault(u, []).append(c)
    expect = {}
    for u, msgs in by_user.items():
        s = " ".join(msgs)
        n_s, n_w = len(PY_SENT.findall(s)), len(PY_WORD.findall(s))
        expect[u] = n_w / n_s if n_s else 0
    assert got == expect


def test_user_features_filters_and_rounding(spark):
    rows = [(i, "a", "word " * (i % 3 + 1) + "x" * 30, "pos" if i % 2 else None) for i in range(30)]
    rows += [(100 + i, "b", "short", "neg") for i in range(30)]          # fails P06
    rows += [(200 + i, "c", "long enough message here!!", "neu") for i in range(3)]  # fails P07
    df = spark.createDataFrame(rows, "msg_id long, uid string, content string, sentiment string")
    out = FT.user_features(df, ["mean_wordcount", "mean_punct", "mean_sentiment"], min_msgs=25).collect()
    assert [r["uid"] for r in out] == ["a"]
    r = out[0]
    assert r["n_msgs"] == 30
    assert r["mean_sentiment"] == 2.0     # only labelled rows count
    assert r["mean_wordcount"] == 3.0     # (2+3+4)/3 repeated


def test_round_ratio_half_even(spark):
    from chatspark.functions.rounding import round_ratio
    df = spark.createDataFrame([(1, 8), (3, 8), (23, 40), (2, 3)], "n long, d long")
    got = [r[0] for r in df.select(round_ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [0.12, 0.38, 0.58, 0.67]


def test_blocked_aggregate_independent_of_block_size(spark):
    rows = [(mid, u, c + " filler text to pass the length rule") for mid, u, c in _messages(seed=11, users=4, per_user=60)]
    df = spark.createDataFrame(rows, "msg_id long, uid string, content string")
    names = ["mean_wordcount", "mean_punct", "mean_sentence_len"]
    small = sorted(tuple(r) for r in FT.user_features(df, names, min_msgs=1, block=3).collect())
    large = sorted(tuple(r) for r in FT.user_features(df, names, min_msgs=1).collect())
    assert small == large
    by_user = {}
    for mid, u, c in sorted(rows):
        by_user.setdefault(u, []).append(c)
    for r in large:
        s = " ".join(by_user[r[0]])
        n_s, n_w = len(PY_SENT.findall(s)), len(PY_WORD.findall(s))
        assert r[4] == (n_w / n_s if n_s else 0)


def test_sentiment_compat_first_message_rule(spark):
    rows = [(1, "a", " " * 30, "pos"), (2, "a", "real words here for the length rule", "neg"),
            (3, "b", "real words here for the length rule", "pos"), (4, "b", " " * 30, "neg")]
    df = spark.createDataFrame(rows, "msg_id long, uid string, content string, sentiment string")
    for names in (["mean_sentiment_compat"], ["mean_sentiment_compat", "mean_sentence_len"]):
        out = {r["uid"]: r["mean_sentiment_compat"] for r in
               FT.user_features(df, names, min_msgs=1, block=2, drop_incomplete=False).collect()}
        assert out["a"] is None            # first complete message has no token
        assert out["b"] == 1.0             # (2 + 0) / 2


def test_vocab_richness_approx_close_to_exact(spark):
    rows = [(i, f"u{i % 3}", " ".join(f"w{(i * 7 + j) % 400}" for j in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "msg_id long, uid string, content string")
    out = FT.user_features(df, ["vocab_richness", "vocab_richness_approx"], min_msgs=1).collect()
    for r in out:
        assert abs(r["vocab_richness"] - r["vocab_richness_approx"]) <= 0.02


def _hot_user(n=4000):
    """One user with most rows, ids made from times (far apart, in bursts)."""
    rng = random.Random(9)
    at, rows = 1_700_000_000_000_000_000, []
    for i in range(n):
        at += rng.choice([1 << 22, 1 << 22, 1 << 22, 1 << 45])
        text = "".join(rng.choice(["hello ", "you", ". ", "! ", " and so", "...", "?"]) for _ in range(8))
        rows.append((at, "hot" if i % 8 else f"u{i % 40}", text))
    return rows


def test_order_blocks_cut_a_hot_user_evenly(spark, monkeypatch):
    rows = _hot_user()
    df = spark.createDataFrame(rows + [(None, "hot", "x"), (5, None, "y")], "msg_id long, uid string, content string").repartition(6)
    tagged = FT.with_order_blocks(df, df, block=100)
    sizes = {(r["uid"], r["_blk"]): r["count"] for r in tagged.groupBy("uid", "_blk").count().collect()}
    hot = [n for (u, _), n in sizes.items() if u == "hot"]
    assert sum(hot) == 3501 and max(hot) <= 3 * sum(hot) / FT.CUTS + 2 and len(hot) > FT.CUTS / 3
    assert all(b == 0 for u, b in sizes if u != "hot" and (u, 0) in sizes)
    ordered = tagged.filter("uid = 'hot' and msg_id is not null").orderBy("msg_id").collect()
    assert all(a["_blk"] <= b["_blk"] for a, b in zip(ordered, ordered[1:]))
    untouched = FT.with_order_blocks(df, df, block=10_000)
    assert {r["_blk"] for r in untouched.select("_blk").distinct().collect()} == {0}


def test_hot_user_in_blocks_equals_one_block(spark):
    df = spark.createDataFrame([(i, u, c + " " * 25, None) for i, u, c in _hot_user(1500)],
                               "msg_id long, uid string, content string, sentiment string")
    names = ["mean_sentence_len", "mean_wordcount", "mean_punct"]
    whole = sorted(tuple(r) for r in FT.user_features(df, names, min_msgs=1).collect())
    assert whole == sorted(tuple(r) for r in FT.user_features(df, names, min_msgs=1, block=20).collect())
    by_user = {}
    for i, u, c in sorted(_hot_user(1500)):
        by_user.setdefault(u, []).append(c + " " * 25)
    for u, _, length, *_ in whole:
        s = " ".join(by_user[u])
        assert abs(length - len(PY_WORD.findall(s)) / len(PY_SENT.findall(s))) < 1e-9


def test_no_stage_holds_a_hot_user(spark):
    """The rows of a hot user are windowed by block, not by user alone."""
    df = spark.createDataFrame([(i, u, c, None) for i, u, c in _hot_user(600)],
                               "msg_id long, uid string, content string, sentiment string")
    plan = FT.user_features(df, ["mean_sentence_len"], min_msgs=1, block=20)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [last(_state" in line]
    assert windows and all("_blk" in line.split("],")[1] for line in windows)


def test_response_time_equals_a_walk_over_each_user(spark):
    import random
    from datetime import datetime, timedelta
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), start + timedelta(seconds=rng.choice([0, 1, 59, 1800, 3599, 3600, 7000]) * rng.randrange(40)))
            for i in range(300)]
    rows += [(300, "alone", start), (301, "a", None)]
    got = {r["uid"]: r["mean_response_time"] for r in FT.response_time_table(
        spark.createDataFrame(rows, "event_id long, uid string, ts timestamp")).collect()}
    assert set(got) == {"a", "b", "alone", None}
    for uid, value in got.items():
        times = [t for t, _ in sorted((t, i) for i, u, t in rows if u == uid and t is not None)]
        gaps = [(y - x).total_seconds() for x, y in zip(times, times[1:]) if (y - x).total_seconds() < 3600]
        assert value == pytest.approx(sum(gaps) / len(gaps) if gaps else 0.0, abs=0.0051)
