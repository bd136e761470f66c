"""Replayed chunks may be many files; a micro-batch is still one chunk."""

from pyspark.sql import functions as F

from chatspark.operators import labels as L
from chatspark.plans import streams_q as Q
from chatspark.streaming import streams as ST


def test_a_chunk_of_many_files_is_a_batch(spark, monkeypatch):
    monkeypatch.setattr(ST, "ROWS_A_FILE", 50)
    d = spark.range(1000).select(F.col("id").alias("msg_id"), F.concat(F.lit("u"), F.col("id") % 3).alias("uid"))
    monkeypatch.setattr(Q, "Fixtures", lambda *_: type("Fx", (), {"msgs": d}))
    _, sdf = Q._msgs_stream(spark, None, "replay-test")
    seen = []
    ST.run_available_now(sdf, None, ST.scratch(spark, "replay-ck"), foreach_batch=lambda b, _: seen.append(
        (b.agg(F.min("msg_id"), F.max("msg_id"), F.count("*")).first(), b.select(F.input_file_name()).distinct().count())))
    assert len(seen) == 4 and all(files == 5 for _, files in seen)
    assert [r[0] for r, _ in seen] == [0] + [r[1] + 1 for r, _ in seen][:3] and sum(r[2] for r, _ in seen) == 1000


def test_labelers_share_scores(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, 0, "good day"), (1, 1, "bad"), (2, 0, "so")], "msg_id long, chunk_id int, chunk string")
    lexicon = spark.createDataFrame([("good", 3), ("bad", -3)], "word string, weight int")
    runs, real = [], L.lexicon_score
    monkeypatch.setattr(L, "lexicon_score", lambda *a, **k: runs.append(1) or real(*a, **k))
    scores = L.chunk_scores(lexicon)
    votes = L.run_labelers(chunks, [L.lexicon_chunk_labeler(lexicon, m, scores) for m in ("sign", "band")]).collect()
    assert len(runs) == 1 and len(votes) == 6
    assert {(r["msg_id"], r["chunk_id"]): r["label"] for r in votes} == {(1, 0): "positive", (1, 1): "negative", (2, 0): "neutral"}
