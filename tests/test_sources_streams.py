"""Readers, sinks and the streaming store against small literal inputs."""

import uuid

from pyspark.sql import functions as F

from chatspark.operators import encode as E
from chatspark.session import shared_path
from chatspark.sources import readers as R
from chatspark.sources import sinks as K


def _path(spark, name):
    return shared_path(spark, "tests", f"{name}-{uuid.uuid4().hex[:8]}")


def test_pipe_csv_round_trip_keeps_quotes_newlines_blanks(spark):
    rows = [("u1", 'say "hi" | bye', "pos"), ("u2", "two\nlines", None), ("u3", "   ", "neu")]
    df = spark.createDataFrame(rows, "uid string, content string, sentiment string")
    p = _path(spark, "csv")
    K.write_pipe(df, p)
    back = sorted(tuple(r) for r in R.read_pipe(spark, p).collect())
    assert back == sorted(rows)


def test_named_fields_cut_extra_and_header_check(spark):
    df = spark.createDataFrame([("a", "b", "c", "extra")], "x string, y string, z string, w string")
    p = _path(spark, "named")
    K.write_pipe(df, p)
    got = R.read_named_fields(spark, p, ["uid", "content", "sentiment"]).first()
    assert tuple(got) == ("a", "b", "c")
    assert R.check_header(spark, p, ["x", "y", "z", "w"]).first()["ok"] is True
    assert R.check_header(spark, p, ["uid", "content", "sentiment", "w"]).first()["ok"] is False


def test_chat_log_forms_and_bots(spark):
    lines = spark.createDataFrame([
        ("2024-01-01 10:00:00.123456:: guild/chan/alice#1: hello: there",),
        ("2024-01-01 10:00:01 :: bob#2: hi",),
        ("2024-01-01 10:00:02 :: Bot#0: beep",),
        ("garbage",),
    ], "line string")
    out = [tuple(r) for r in R.parse_chat_log(lines, bots=["Bot#0"]).collect()]
    assert out == [("alice#1", "2024-01-01 10:00:00.123456", "hello: there"), ("bob#2", "2024-01-01 10:00:01", "hi")]


def test_dat_log_cut_and_comma_split(spark):
    lines = spark.createDataFrame([("t1 :: u: a: b",), ("broken",)], "line string")
    got = [tuple(r) for r in R.parse_dat_log(lines).collect()]
    assert got == [("u", "t1", "a"), (None, "broken", None)]
    c = spark.createDataFrame([("u,t,x, y, z",)], "line string")
    assert tuple(R.split_first_commas(c).first()) == ("u", "t", "x, y, z")


def test_overlength_side_output(spark):
    df = spark.createDataFrame([(1, "a " * 600), (2, "b c")], "msg_id long, content string")
    side = _path(spark, "side")
    out = {r["msg_id"]: r for r in K.overlength_side_output(df, side, 512).collect()}
    assert out[1]["truncated"] and len(out[1]["content"].split()) == 512 and not out[2]["truncated"]
    assert spark.read.parquet(side).count() == 1


def test_encode_pad_batch_max(spark):
    df = spark.createDataFrame([(0, "aa bb aa"), (1, "bb"), (40, "cc")], "msg_id long, content string")
    vocab = {r["token"]: r["id"] for r in E.build_vocabulary(df).collect()}
    assert vocab == {"aa": 1, "bb": 2, "cc": 3}   # count desc, then token
    out = {r["msg_id"]: (r["input_ids"], r["attention_mask"]) for r in E.encode_pad(df, E.build_vocabulary(df)).collect()}
    assert out[0] == ([1, 2, 1], [1, 1, 1])
    assert out[1] == ([2, 0, 0], [1, 0, 0])       # padded to the batch maximum
    assert out[40] == ([3], [1])                   # another batch


def test_encode_pad_hot_and_rare_tokens_alike(spark):
    rows = [(0, "bb zz aa cc aa bb"), (1, "cc"), (1, "dd cc"), (None, "aa"), (3, None), (40, "dd zz dd cc aa")]
    df = spark.createDataFrame(rows, "msg_id long, content string")
    vocab = spark.createDataFrame([("aa", 1), ("bb", 2), ("cc", 3), ("dd", 4)], "token string, id long")   # zz has no id

    def encoded(hot, rows):
        out = E.encode_pad(df, vocab, max_len=3, hot_tokens=hot, broadcast_rows=rows).collect()
        return [(r["msg_id"], r["input_ids"], r["attention_mask"]) for r in out]

    want = [(0, [2, 1, 3], [1, 1, 1]), (1, [3, 4, 3], [1, 1, 1]), (1, [3, 4, 3], [1, 1, 1]), (3, [0, 0, 0], [0, 0, 0]),
            (40, [4, 4, 3], [1, 1, 1]), (None, [], [])]
    for hot, rows in ((0, 1), (2, 1), (100, 1), (2, 100)):
        assert sorted(encoded(hot, rows), key=str) == sorted(want, key=str)


def test_versioned_store_merge_equals_batch(spark):
    from chatspark.streaming import streams as ST
    rows = [(i, f"u{i % 3}", "word " * (i % 4 + 1) + "tail text long enough here!") for i in range(60)]
    df = spark.createDataFrame(rows, "msg_id long, uid string, content string")
    store = ST.BatchStore(spark, _path(spark, "store"))
    merge = ST.merge_into_store(store)
    for b in range(3):
        merge(df.filter((F.col("msg_id") >= b * 20) & (F.col("msg_id") < (b + 1) * 20)), b)
    # a repeated batch, also one that broke off between its two tables, changes nothing
    again = df.filter((F.col("msg_id") >= 20) & (F.col("msg_id") < 40))
    merge(again, 1)
    store.write("users", ST.message_partials(again)[0], 1)
    streamed = sorted(tuple(r) for r in ST.store_vectors(store).collect())
    whole = ST.BatchStore(spark, _path(spark, "store-batch"))
    ST.merge_into_store(whole)(df, 0)
    assert streamed == sorted(tuple(r) for r in ST.store_vectors(whole).collect())


def test_sketch_store_close_to_exact(spark):
    from chatspark.streaming import streams as ST
    rows = [(i, f"u{i % 3}", " ".join(f"w{(i * 5 + j) % 300}" for j in range(30)) + " and a long tail") for i in range(90)]
    df = spark.createDataFrame(rows, "msg_id long, uid string, content string")
    exact, sk = ST.BatchStore(spark, _path(spark, "ex")), ST.BatchStore(spark, _path(spark, "sk"))
    for b in range(3):
        part = df.filter((F.col("msg_id") >= b * 30) & (F.col("msg_id") < (b + 1) * 30))
        ST.merge_into_store(exact)(part, b)
        ST.merge_sketches_into_store(sk)(part, b)
    e = {r["uid"]: r for r in ST.store_vectors(exact).collect()}
    a = {r["uid"]: r for r in ST.store_vectors_sketched(sk).collect()}
    for u in e:
        assert e[u]["mean_wordcount"] == a[u]["mean_wordcount"]
        assert abs(e[u]["vocab_richness"] - a[u]["vocab_richness"]) <= 0.02
