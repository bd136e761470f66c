"""Structured Streaming operators (T01-T06) and their batch twins.

Streams read files (a replay of driver-table data written in time-ordered
chunks to the shared checkpoint folder), run with ``availableNow`` and a
checkpoint location, and write to parquet sinks in the same folder. No
socket, no server. Stateful logic:
- T02 keeps a bounded per-key buffer in ``applyInPandasWithState``;
- T03 is a watermarked event-time window aggregation;
- T04 writes additive partial sums per micro-batch and merges them on reading.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import text as T
from ..functions.rounding import round_ratio
from ..session import shared_path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return shared_path(spark, "streams", f"{name}-{uuid.uuid4().hex[:10]}")


#: rows of a replayed file, about
ROWS_A_FILE = 50_000


def files_a_chunk(df: DataFrame, chunks: int = 4) -> int:
    """Files to replay each chunk of ``df`` as, which is how many a micro-batch takes."""
    return max(1, -(-df.count() // (chunks * ROWS_A_FILE)))


def replay_files(df: DataFrame, path: str, order_col: str, chunks: int = 4, files: int = 1) -> str:
    """Write ``df`` as ``chunks`` times ``files`` parquet files in ``order_col``
    ranges, one write per chunk so file times follow the order (file stream
    sources take files oldest first; ``maxFilesPerTrigger`` of ``files`` makes
    a chunk a micro-batch). Rows with a null key go into the first."""
    dtype = dict(df.dtypes)[order_col]
    key = (F.unix_micros(F.col(order_col).cast("timestamp")) if dtype.startswith("timestamp")
           else F.col(order_col)).cast("double")
    bounds = df.select(F.percentile_approx(key, [i / chunks for i in range(1, chunks)], 10000).alias("q")).first()["q"]
    edges = [None] + list(bounds) + [None]
    for i in range(chunks):
        cond = F.lit(True)
        if edges[i] is not None:
            cond = cond & (key > F.lit(edges[i]))
        if edges[i + 1] is not None:
            cond = cond & (key <= F.lit(edges[i + 1]))
        if i == 0:
            cond = cond | key.isNull()
        chunk = df.filter(cond)
        # dealt out by number: every file has rows, so a chunk has ``files`` of them
        (chunk.coalesce(1) if files == 1 else chunk.repartition(files)).write.mode("append").parquet(path)
    return path


def run_available_now(sdf: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      foreach_batch=None, state_partitions: int | None = None) -> None:
    """Run a streaming query over everything available, then stop.

    ``state_partitions`` sizes the stateful shuffle of a new query (it is
    fixed in the checkpoint at the first batch); the session value is
    restored once the query has started with its own copy of the conf."""
    spark = sdf.sparkSession
    w = sdf.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = w.foreachBatch(foreach_batch).start() if foreach_batch else w.format("parquet").option("path", sink).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


# ------------------------------------------------------------------ T01
def drop_self(sdf: DataFrame, bot: str, col: str = "uid") -> DataFrame:
    """Ignore the bot's own messages."""
    return sdf.filter(F.col(col).isNull() | (F.col(col) != bot))


# ------------------------------------------------------------------ T02
BLOCK_SCHEMA = "uid long, block long, n long, first_event_id long, last_event_id long, value_sum double"
_STATE_SCHEMA = "ids array<long>, ts array<timestamp>, vals array<double>, blocks long"


def _buffer_blocks(n: int):
    """Per-key state machine: append rows, emit a block each time the buffer
    exceeds ``n`` rows (block = n + 1 rows), keep the rest. The buffer
    never holds more than ``n`` rows between batches."""

    def fn(key, pdfs, state):
        if state.exists:
            ids, ts, vals, blocks = state.get
            buf = pd.DataFrame({"event_id": list(ids), "ts": list(ts), "value": list(vals)})
        else:
            buf, blocks = pd.DataFrame({"event_id": [], "ts": [], "value": []}), 0
        new = pd.concat([p[["event_id", "ts", "value"]] for p in pdfs], ignore_index=True)
        new = new.sort_values(["ts", "event_id"], kind="mergesort")
        buf = pd.concat([buf, new], ignore_index=True) if len(buf) else new.reset_index(drop=True)
        out = []
        while len(buf) > n:
            blk, buf = buf.iloc[: n + 1], buf.iloc[n + 1:].reset_index(drop=True)
            out.append((int(key[0]), int(blocks), int(len(blk)), int(blk["event_id"].iloc[0]),
                        int(blk["event_id"].iloc[-1]), float(round(blk["value"].astype("float64").sum(), 6))))
            blocks += 1
        state.update((buf["event_id"].astype("int64").tolist(), list(pd.to_datetime(buf["ts"])),
                      buf["value"].astype("float64").tolist(), int(blocks)))
        yield pd.DataFrame(out, columns=["uid", "block", "n", "first_event_id", "last_event_id", "value_sum"])

    return fn


def count_buffer(sdf: DataFrame, n: int = 250) -> DataFrame:
    """Blocks of n + 1 consecutive messages per user (ts, event_id
    order); an unfinished tail is never flushed. The state per user is at
    most n rows; the rows one call sees are that user's rows of one
    micro-batch, so size micro-batches (maxFilesPerTrigger /
    maxBytesPerTrigger) for the hottest user."""
    return sdf.groupBy("uid").applyInPandasWithState(
        _buffer_blocks(n), BLOCK_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def count_buffer_twin(events: DataFrame, n: int = 250) -> DataFrame:
    """Batch twin of T02. Row numbers per user come from per-(user, hour)
    counts and a prefix over the user's hours, so no task ranks a whole
    user (``_day`` holds the hour block)."""
    e = events.select("uid", "event_id", "ts", "value", F.date_trunc("hour", F.col("ts")).alias("_day"))
    days = e.groupBy("uid", "_day").agg(F.count(F.lit(1)).alias("_c"))
    w_days = Window.partitionBy("uid").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offs = days.select("uid", "_day", F.coalesce(F.sum("_c").over(w_days), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy("uid", "_day").orderBy("ts", "event_id")
    rn = (e.withColumn("_r", F.row_number().over(w_in)).join(offs, ["uid", "_day"])
          .withColumn("rn", F.col("_off") + F.col("_r")))
    blocks = rn.withColumn("block", ((F.col("rn") - 1) / F.lit(n + 1)).cast("long"))
    agg = blocks.groupBy("uid", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("event_id", "rn").alias("first_event_id"),
        F.max_by("event_id", "rn").alias("last_event_id"), F.sum("value").alias("value_sum"))
    return agg.filter(F.col("n") == n + 1).withColumn("value_sum", F.round("value_sum", 6))


# ------------------------------------------------------------------ T03
def weekly_features(sdf: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per user and 7-day event-time window: messages and value sum. Run
    it in update mode: only weeks that changed are written, and a week's state
    is dropped once the watermark passes it. ``ts`` must be TIMESTAMP (not timestamp_ntz) for the watermark."""
    return (sdf.withWatermark("ts", delay)
            .groupBy(F.window("ts", "7 days").alias("w"), "uid")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))
            .select("uid", F.col("w.start").alias("week_start"), "n", "value_sum"))


def weekly_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each (uid, week) of an update-mode stream that wrote
    the changed rows of every micro-batch to ``batch=N``."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    newest = F.max_by(F.struct("n", "value_sum"), "batch").alias("_r")
    return rows.groupBy("uid", "week_start").agg(newest).select("uid", "week_start", "_r.n", "_r.value_sum")


# ------------------------------------------------------------------ T04
def message_partials(msgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Additive per-user partials of one batch of messages (P06 + X01) and
    the exact (uid, token) counts used for vocabulary richness."""
    m = msgs.filter(F.length("content") >= 25).withColumn("content", T.strip_custom_emoji("content"))
    parts = m.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum(T.count_tokens_ws("content")).alias("s_words"),
                                 F.sum(T.count_punct("content")).alias("s_punct"))
    toks = (m.select("uid", F.explode(T.tokens_ws("content")).alias("token"))
            .groupBy("uid", "token").agg(F.count(F.lit(1)).alias("c")))
    return parts, toks


class BatchStore:
    """Per-user partials, one folder ``batch=N`` for each micro-batch. A batch
    that is repeated overwrites its own folder and no other, so nothing counts
    twice; readers add the batches up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("batch")

    def write(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")


def _users(store: BatchStore) -> DataFrame:
    return store.read("users").groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("n", "s_words", "s_punct")])


def message_sketches(msgs: DataFrame) -> DataFrame:
    """Per-user HyperLogLog sketch of the batch's tokens (mergeable across
    batches, bounded size per user)."""
    m = msgs.filter(F.length("content") >= 25).withColumn("content", T.strip_custom_emoji("content"))
    return (m.select("uid", F.explode(T.tokens_ws("content")).alias("token"))
            .groupBy("uid").agg(F.hll_sketch_agg("token").alias("sketch")))


def merge_sketches_into_store(store: BatchStore):
    """T04 scale variant: the non-additive distinct-token count is kept as
    one HLL sketch per user and batch, merged by ``hll_union_agg`` on reading;
    the additive partials merge as sums."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        store.write("users", message_partials(batch)[0], batch_id)
        store.write("sketches", message_sketches(batch), batch_id)
    return fn


def store_vectors_sketched(store: BatchStore) -> DataFrame:
    u = _users(store)
    s = store.read("sketches").groupBy("uid").agg(F.hll_union_agg("sketch").alias("sketch"))
    j = u.join(s, "uid", "left")
    return j.select(
        "uid", F.col("n").alias("n_msgs"), round_ratio(F.col("s_words"), F.col("n")).alias("mean_wordcount"),
        round_ratio(F.col("s_punct"), F.col("n")).alias("mean_punct"),
        F.coalesce(round_ratio(F.hll_sketch_estimate("sketch"), F.col("s_words")), F.lit(0.0)).alias("vocab_richness"))


def merge_into_store(store: BatchStore):
    def fn(batch: DataFrame, batch_id: int) -> None:
        parts, toks = message_partials(batch)
        store.write("users", parts, batch_id)
        store.write("tokens", toks, batch_id)
    return fn


def store_vectors(store: BatchStore) -> DataFrame:
    """Recompute the ratios from the merged partials."""
    u = _users(store)
    t = store.read("tokens").groupBy("uid", "token").agg(F.sum("c").alias("c"))
    v = t.groupBy("uid").agg(F.count(F.lit(1)).alias("_d"), F.sum("c").alias("_t"))
    return u.join(v, "uid", "left").select(
        "uid", F.col("n").alias("n_msgs"), round_ratio(F.col("s_words"), F.col("n")).alias("mean_wordcount"),
        round_ratio(F.col("s_punct"), F.col("n")).alias("mean_punct"),
        F.coalesce(round_ratio(F.col("_d"), F.col("_t")), F.lit(0.0)).alias("vocab_richness"))
