"""The 12 features of every full buffer of messages.

A buffer takes a channel's messages in order and is worked off once it holds
more than ``n``. What a stream must remember for that is how many messages of each
channel came before, not the messages: a message's place among its channel's says
which buffer it belongs to. Each micro-batch adds its messages to mergeable
states by (channel, buffer) in a :class:`~chatspark.streaming.vector_store.VectorStore`;
a buffer of n + 1 messages is full. No Python in tasks and no task that holds a
channel: places come from a distributed index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators.joins import split_join
from ..operators.ordered import global_index
from .vector_store import VectorStore


def places(msgs: DataFrame, channel: str, order: str = "msg_id") -> tuple[DataFrame, DataFrame]:
    """(msgs with ``place``, counts): each row's number from 0 within its
    channel in the order of ``order`` (unique; nulls first), and (channel, rows).
    A null channel is a channel like others."""
    key = F.coalesce(F.concat(F.lit("="), F.col(channel).cast("string")), F.lit(""))
    at = global_index(msgs.withColumn("_channel", key), ["_channel", order], "_at")
    spans = at.groupBy("_channel").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"),
                                       F.first(channel).alias(channel))
    placed = split_join(at, spans.select("_channel", "_first", "_rows"), "_channel", "_rows")
    return (placed.withColumn("place", F.col("_at") - F.col("_first")).drop("_channel", "_at", "_first", "_rows"),
            spans.select(channel, F.col("_rows").alias("rows")))


class BlockVectors:
    """Buffers of more than ``n`` messages by ``channel``, kept in ``path``.

    Messages under ``min_chars`` characters (a null text too) enter no buffer. Batches come in
    the order of their messages; a repeated batch counts once."""

    def __init__(self, spark: SparkSession, path: str, n: int = 250, channel: str = "channel", min_chars: int = 25):
        self.spark, self.path, self.n, self.channel, self.min_chars = spark, path, n, channel, min_chars
        self.store = VectorStore(spark, f"{path}/store", min_chars=min_chars)

    def _before(self, batch_id: int) -> DataFrame | None:
        """(channel, before): messages of earlier batches."""
        names = [c for c in self.store._children(f"{self.path}/counts") if c.startswith("batch=") and int(c[6:]) < batch_id]
        if not names:
            return None
        old = self.spark.read.parquet(*[f"{self.path}/counts/{c}" for c in names])
        return old.groupBy(F.col(self.channel).alias("_known")).agg(F.sum("rows").alias("before"))

    def write_batch(self, msgs: DataFrame, batch_id: int) -> None:
        """Add the messages of a micro-batch (use with ``foreachBatch``)."""
        long_enough = msgs.filter(F.length("content") >= self.min_chars)
        placed, counts = places(long_enough, self.channel)
        before = self._before(batch_id)
        if before is None:
            placed = placed.withColumn("before", F.lit(0))
        else:
            # each channel with its messages here, so that a hot one is not shuffled
            known = counts.join(before, F.col(self.channel).eqNullSafe(F.col("_known")), "left").select(
                F.coalesce(F.concat(F.lit("="), F.col(self.channel).cast("string")), F.lit("")).alias("_channel"),
                F.coalesce("before", F.lit(0)).alias("before"), "rows")
            key = F.coalesce(F.concat(F.lit("="), F.col(self.channel).cast("string")), F.lit(""))
            placed = split_join(placed.withColumn("_channel", key), known, "_channel", "rows").drop("_channel", "rows")
        block = F.floor((F.col("place") + F.col("before")) / (self.n + 1))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch_id}")
        keyed = placed.withColumn("uid", F.struct(F.col(self.channel).alias("channel"), block.alias("block")))
        self.store.write_batch(keyed.select(*[c for c in msgs.columns if c != "uid"], "uid"), batch_id)

    def full(self, pos_lexicon: DataFrame | None = None, drop_incomplete: bool = True) -> DataFrame:
        """channel, block, n_msgs and the features of every full buffer."""
        found = self.store.vectors(min_msgs=self.n + 1, pos_lexicon=pos_lexicon, drop_incomplete=drop_incomplete)
        return found.select("uid.channel", "uid.block", "n_msgs", *FT.VECTOR_FEATURES)
