"""A lexicon too large to broadcast: frequent words stay where they are."""

from pyspark.sql import functions as F

from chatspark.functions import text as T
from chatspark.operators import labels as L


def test_same_scores_with_few_words_shuffled(spark, monkeypatch):
    rows = [(i, " ".join(["the"] * 50 + [f"w{i}", f"w{i % 7}"])) for i in range(200)] \
        + [(3, "the w3 again"), (None, "The only"), (None, None), (300, None), (301, ""), (302, "rarest of"), (303, "w5 w5 twice")]
    m = spark.createDataFrame(rows, "msg_id long, content string")
    lexicon = spark.createDataFrame([("the", 2), ("again", -7), ("twice", 1), ("twice", 4)]
                                    + [(f"w{i}", i % 5 - 2) for i in range(150)], "word string, weight int")
    want = sorted(map(tuple, L.lexicon_score(m, lexicon).collect()), key=str)
    monkeypatch.setattr(L, "small_side", lambda df: (df, False))
    shuffled, real = [], L._score_by_large_lexicon
    monkeypatch.setattr(L, "cut_lineage", lambda df: shuffled.append(df) or df)
    for hot in (3, 300_000):
        monkeypatch.setattr(L, "HOT_WORDS", hot)
        assert sorted(map(tuple, L.lexicon_score(m, lexicon).collect()), key=str) == want
    # "the" is looked up in place: it is never a word that is shuffled
    assert real is L._score_by_large_lexicon
    rare = [d for d in shuffled if "_rare" in d.columns]
    assert len(rare) == 2 and all(d.filter("_rare = 'the'").isEmpty() for d in rare)
    assert not rare[0].filter("_rare = 'again'").isEmpty()


def test_token_count_needs_no_tokens(spark):
    rows = [(s,) for s in ("a b", "", " ", " a\x1cb\x85", "x" * 9, None, "​ \n", "\U0001F600 b ")]
    got = spark.createDataFrame(rows, "t string").select(
        "t", T.count_tokens_ws("t").alias("n"), T.has_token("t").alias("h"),
        F.coalesce(F.size(T.tokens_ws("t")), F.lit(0)).alias("w")).collect()
    assert all(r["n"] == r["w"] for r in got)
    assert all(r["h"] == (r["w"] > 0) for r in got if r["t"] is not None)
    plan = spark.createDataFrame(rows, "t string").select(T.count_tokens_ws("t"))._jdf.queryExecution().toString()
    assert "split(" not in plan
