"""Token ids and padding.

The vocabulary is ranked by corpus frequency with the distributed
:func:`~chatspark.operators.ordered.global_index` (no single-task sort).
It joins to the token stream broadcast only after a size check; of a larger
one the first tokens, a bounded number, are broadcast, so that only the
others, rare ones in a ranked vocabulary, are shuffled by token.
Sequences are re-assembled per message (bounded by the message length) and
cut before the window over fixed msg_id batches (bounded groups) that gives
the batch maximum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import BROADCAST_MAX_ROWS
from .ordered import global_index
from .topics import terms

#: of a large vocabulary so many tokens of the smallest ids are broadcast
HOT_TOKENS = 100_000


def build_vocabulary(docs: DataFrame, text: str = "content") -> DataFrame:
    """(token, id): ids 1.. by count desc, token asc (0 is padding)."""
    counts = docs.select(F.explode(terms(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_c"))
    ranked = global_index(counts.withColumn("_neg", -F.col("_c")), ["_neg", "token"], "_i")
    return ranked.select("token", (F.col("_i") + 1).alias("id"))


def _with_ids(toks: DataFrame, vocab: DataFrame, hot_tokens: int, broadcast_rows: int) -> DataFrame:
    """Inner join by token. With more than ``broadcast_rows`` rows in ``vocab``, the
    tokens beyond the first ``hot_tokens`` are shuffled."""
    vocab = cut_lineage(vocab)
    if vocab.count() <= broadcast_rows:
        return toks.join(F.broadcast(vocab), "token")
    hot = F.broadcast(vocab.orderBy("id", "token").limit(hot_tokens).select("token").distinct())
    known = toks.join(F.broadcast(vocab.join(hot, "token", "left_semi")), "token")
    return known.unionByName(toks.join(hot, "token", "left_anti").join(vocab.join(hot, "token", "left_anti"), "token"))


def encode_pad(docs: DataFrame, vocab: DataFrame, key: str = "msg_id", text: str = "content",
               max_len: int = 512, batch_size: int | None = 32, hot_tokens: int = HOT_TOKENS,
               broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """(key, input_ids, attention_mask): ids in token order, truncated to
    L and right-padded with 0; L = ``max_len`` or, with ``batch_size``, the
    longest sequence of the batch (capped at ``max_len``)."""
    toks = docs.select(key, F.posexplode(terms(text)).alias("pos", "token"))
    ids = _with_ids(toks, vocab, hot_tokens, broadcast_rows)
    seq = (ids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_s"))
           .select(key, F.transform(F.slice("_s", 1, max_len), lambda s: s["id"]).alias("_ids")))
    seq = docs.select(key).join(seq, key, "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<long>")))
    n = F.size("_ids")
    if batch_size:
        w = Window.partitionBy(F.floor(F.col(key) / batch_size))
        seq = seq.withColumn("_L", F.max(n).over(w))
    else:
        seq = seq.withColumn("_L", F.lit(max_len))
    kept = F.col("_ids")
    pad = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.col("_L") - F.size(kept), F.lit(0)).cast("int"))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(kept)),
                    F.array_repeat(F.lit(0), F.greatest(F.col("_L") - F.size(kept), F.lit(0)).cast("int")))
    return seq.select(key, F.concat(kept, pad).alias("input_ids"), mask.alias("attention_mask"))
