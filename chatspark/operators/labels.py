"""Labelling operators.

Label maps are literal ``map`` expressions (28 entries at most), so a
lookup is a JVM expression inside codegen and never a join. The lexicon
score joins words to a lexicon table that is broadcast only after a size
check; words are pre-aggregated per message before that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import (BASIC_EMOTIONS, EMOTION_TO_SENTIMENT, EMOTIONS, ID_LABELS,
                                  NEGATIVE_FLAGS, NEUTRAL_FLAG, POSITIVE_FLAGS, SENTIMENT_IDS)
from ..session import cut_lineage
from .joins import small_side

#: with a lexicon too large to broadcast, so many of the most frequent words are looked up in place
HOT_WORDS = 300_000


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def emotion_to_sentiment(col: Column | str) -> Column:
    """28 emotion names -> pos/neg/neu; anything else (``Err``) -> neu."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_map(EMOTION_TO_SENTIMENT)[c], F.lit("neu"))


def sentiment_to_id(col: Column | str, default: int | None = None) -> Column:
    """Neg 0, neu 1, pos 2; ``default`` for anything else."""
    c = F.col(col) if isinstance(col, str) else col
    v = _map(SENTIMENT_IDS)[c]
    return v if default is None else F.coalesce(v, F.lit(default))


def id_to_label(col: Column | str) -> Column:
    """0/1/2 -> neg/neu/pos (NULL outside)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_element_at(F.array(*[F.lit(x) for x in ID_LABELS]), c.cast("int") + 1)


def collapse_multihot(df: DataFrame) -> DataFrame:
    """Strict winner among pos/neg/neutral flag counts, else neu; the
    28 flag columns and ``example_very_unclear`` are dropped."""
    pos = sum((F.col(c) for c in POSITIVE_FLAGS), F.lit(0))
    neg = sum((F.col(c) for c in NEGATIVE_FLAGS), F.lit(0))
    neu = F.col(NEUTRAL_FLAG)
    label = (F.when((pos > neg) & (pos > neu), "pos")
             .when((neg > pos) & (neg > neu), "neg").otherwise("neu"))
    return df.withColumn("sentiment", label).drop(*EMOTIONS, "example_very_unclear")


def multihot_argmax(cols: list[str]) -> Column:
    """Index of the first maximum; all-zero rows give 0."""
    arr = F.array(*[F.col(c) for c in cols])
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def basic_emotion(cols: list[str] = BASIC_EMOTIONS) -> Column:
    """Name of the argmax among the kept columns (one order for both)."""
    names = F.array(*[F.lit(c) for c in cols])
    return F.element_at(names, multihot_argmax(cols) + 1)


def label_sign(score: Column) -> Column:
    """> 0 pos, < 0 neg, else neu."""
    return F.when(score > 0, "pos").when(score < 0, "neg").otherwise("neu")


def label_band(compound: Column, band: float = 0.05) -> Column:
    """> band pos, < -band neg, else neu."""
    return F.when(compound > band, "pos").when(compound < -band, "neg").otherwise("neu")


def normalized_compound(score: Column, alpha: float = 15.0) -> Column:
    """Published VADER normalisation s / sqrt(s^2 + alpha)."""
    s = score.cast("double")
    return s / F.sqrt(s * s + F.lit(alpha))


def lexicon_score(msgs: DataFrame, lexicon: DataFrame, key: str = "msg_id", text: str = "content") -> DataFrame:
    """Per value of ``key``, the sum of lexicon weights of the
    (lower-cased Unicode) words; 0 when no word is in the lexicon or the text
    is null. The texts are read once."""
    words = (msgs.select(key, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(T.WORD_RUN), 0)).alias("w"))
             .select(key, F.lower("w").alias("word")))
    lexicon = cut_lineage(lexicon.select("word", "weight"))  # counted, and joined up to twice
    lex, small = small_side(lexicon)
    if small:
        # broadcast lookup: no shuffle of the words, one aggregate per message
        per = words.join(lex, "word", "left").groupBy(key).agg(F.sum("weight").alias("score"))
    else:
        per = _score_by_large_lexicon(words, lexicon, key)
    return per.select(key, F.coalesce(F.col("score"), F.lit(0)).cast("long").alias("score"))


def _score_by_large_lexicon(words: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """(key, score) of (key, word) rows. The most frequent words, in the lexicon
    or not, are looked up where they stand and added up to one row a message;
    only the others are shuffled, those that no lexicon row can meet apart."""
    seen = words.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(seen.filter("word is not null").orderBy(F.desc("_n"), "word").limit(HOT_WORDS).select("word"))
    weights = hot.join(lexicon, "word", "left").groupBy("word").agg(F.sum("weight").alias("_w"))
    looked = words.join(F.broadcast(weights.withColumn("_hot", F.lit(True))), "word", "left")
    rare = F.when(F.col("_hot").isNull(), F.col("word")).alias("_rare")
    per = cut_lineage(looked.groupBy(key, rare).agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_c")))
    found = per.filter("_rare is not null").join(lexicon, F.col("_rare") == F.col("word")).select(
        key, (F.col("_c") * F.col("weight")).alias("_s"))
    # a message with rare words only has its row here too
    return per.select(key, "_s").unionByName(found).groupBy(key).agg(F.sum("_s").alias("score"))


def softmax(logits: Column) -> Column:
    """Numerically stable softmax of an array column."""
    mx = F.array_max(logits)
    ex = F.transform(logits, lambda v: F.exp(v - mx))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / total)


def argmax(arr: Column) -> Column:
    """First index of the maximum (0-based)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def label_low_confidence(probs: Column, threshold: float = 0.5) -> Column:
    """Argmax label, but neu when the top probability is below threshold."""
    return F.when(F.array_max(probs) < threshold, F.lit("neu")).otherwise(id_to_label(argmax(probs)))


def confidence_band(probs: Column, high: float = 0.95, low: float = 0.75) -> Column:
    """Ok above ``high``, log in (low, high], untrusted at or below low."""
    m = F.array_max(probs)
    return F.when(m > high, "ok").when(m > low, "log").otherwise("untrusted")


def safe_label(col: Column | str, allowed=("pos", "neg", "neu"), error: str = "Err") -> Column:
    """A failed/unknown label becomes ``Err`` and the run goes on."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*allowed), c).otherwise(F.lit(error))


def remap_clamp_ids(col: Column | str, k: int = 3) -> Column:
    """L14 (compat): clamp to 0..k-1, then (y+1) div 2."""
    c = F.col(col) if isinstance(col, str) else col
    y = F.least(F.greatest(c.cast("long"), F.lit(0)), F.lit(k - 1))
    return ((y + 1) / 2).cast("long").cast("int")


def vote_label(label: Column, normalize: bool = True) -> Column:
    """Map a labeler's output to pos/neg/neu. ``normalize=False`` keeps the
    literal map: only ``positive``/``negative`` count, all else is neu."""
    lab = F.lower(label)
    if normalize:
        return (F.when(lab.isin("pos", "positive"), "pos")
                .when(lab.isin("neg", "negative"), "neg").otherwise("neu"))
    return F.when(lab == "positive", "pos").when(lab == "negative", "neg").otherwise("neu")


def ensemble_vote(votes: DataFrame, normalize: bool = True, n_labelers: int = 5) -> DataFrame:
    """Most frequent label over all votes (every chunk, every labeler)
    of a message. Ties: earliest vote position (chunk, labeler), then label.

    Votes are counted per (msg, label) with map-side combine; the winner is
    a ``min(struct)`` aggregate, so no window and no collected list."""
    v = votes.select("msg_id", vote_label(F.col("label"), normalize).alias("label"),
                     (F.col("chunk_id") * n_labelers + F.col("labeler")).alias("_pos"))
    counts = v.groupBy("msg_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_first"))
    best = counts.groupBy("msg_id").agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("_first").alias("b"),
                                                       F.col("label").alias("c"), F.col("n").alias("d"))).alias("w"))
    return best.select("msg_id", F.col("w.c").alias("label"), F.col("w.d").alias("votes"))


# ---------------------------------------------------------------- F06
def chunk_scores(lexicon: DataFrame):
    """``fn(chunks) -> (_cid, score)`` that scores the same chunks only once,
    for labelers that share a lexicon."""
    held = []

    def run(chunks: DataFrame) -> DataFrame:
        for known, scores in held:
            if known is chunks:
                return scores
        c = chunks.withColumn("_cid", F.struct("msg_id", "chunk_id"))
        scores = cut_lineage(lexicon_score(c.select("_cid", F.col("chunk").alias("content")), lexicon, key="_cid"))
        held.append((chunks, scores))
        return scores

    return run


def lexicon_chunk_labeler(lexicon: DataFrame, mode: str = "sign", scores=None):
    """A labeler over chunks using the word lexicon: ``sign`` (L07) or
    ``band`` on the normalised compound (L08). Output spellings follow the
    long form (positive/negative/neutral). ``scores`` (:func:`chunk_scores`)
    is given to labelers that share theirs."""
    scores = scores or chunk_scores(lexicon)

    def run(chunks: DataFrame) -> DataFrame:
        s = scores(chunks)
        score = F.col("score")
        lab = label_sign(score) if mode == "sign" else label_band(normalized_compound(score))
        long = F.when(lab == "pos", "positive").when(lab == "neg", "negative").otherwise("neutral")
        return s.select(F.col("_cid.msg_id").alias("msg_id"), F.col("_cid.chunk_id").alias("chunk_id"), long.alias("label"))

    return run


def punctuation_labeler_pandas():
    """An outside-model style labeler run as an Arrow-batched
    ``mapInPandas`` (the plug-in path for per-row Python models): more '!'
    than '?' -> pos, fewer -> neg, else neu."""
    import pandas as pd

    def batches(it):
        for pdf in it:
            bang = pdf["chunk"].str.count("!")
            ques = pdf["chunk"].str.count(r"\?")
            lab = pd.Series("neu", index=pdf.index)
            lab[bang > ques] = "pos"
            lab[bang < ques] = "neg"
            yield pd.DataFrame({"msg_id": pdf["msg_id"], "chunk_id": pdf["chunk_id"], "label": lab})

    def run(chunks: DataFrame) -> DataFrame:
        return chunks.select("msg_id", "chunk_id", "chunk").mapInPandas(
            batches, "msg_id long, chunk_id int, label string")

    return run


def isolated_labeler(label_batch):
    """A labeler from ``label_batch(pdf) -> labels`` (one for each row of
    msg_id, chunk_id, chunk) that no row can stop.

    A batch that raises, or gives another number of labels, is cut in half
    until the failing rows are alone; these get a null label (``Err`` in
    :func:`run_labelers`) and the message in ``error``. So ``label_batch`` must
    be free to see rows again; it runs at most twice the depth of the halving
    over a row."""
    import pandas as pd

    def tried(pdf):
        try:
            labels = list(label_batch(pdf))
            if len(labels) != len(pdf):
                raise ValueError(f"{len(labels)} labels for {len(pdf)} rows")
            return labels, [None] * len(pdf)
        except Exception as e:
            if len(pdf) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
        half = len(pdf) // 2
        (a, b), (c, d) = tried(pdf.iloc[:half]), tried(pdf.iloc[half:])
        return a + c, b + d

    def batches(it):
        for pdf in it:
            labels, errors = tried(pdf) if len(pdf) else ([], [])
            yield pd.DataFrame({"msg_id": pdf["msg_id"], "chunk_id": pdf["chunk_id"], "label": pd.Series(labels, index=pdf.index, dtype=object),
                                "error": pd.Series(errors, index=pdf.index, dtype=object)})

    def run(chunks: DataFrame) -> DataFrame:
        return chunks.select("msg_id", "chunk_id", "chunk").mapInPandas(
            batches, "msg_id long, chunk_id int, label string, error string")

    return run


def write_with_rejects(labelled: DataFrame, labels_path: str, rejects_path: str) -> dict[str, int]:
    """Write what :func:`isolated_labeler` gives: the labels (``Err`` where a
    row failed) and a table of the rejected rows with their messages. Both are
    overwritten by a repeated run. Returns how many rows there are of either,
    counted in the written table: an ``Observation`` would leave the session
    unable to send a fitted binary model to tasks."""
    labelled.withColumn("label", F.coalesce("label", F.lit("Err"))).write.mode("overwrite").parquet(labels_path)
    written = labelled.sparkSession.read.parquet(labels_path)
    written.filter("error is not null").select("msg_id", "chunk_id", "error").write.mode("overwrite").parquet(rejects_path)
    return written.agg(F.count(F.lit(1)).alias("rows"), F.count("error").alias("rejects")).first().asDict()


def run_labelers(chunks: DataFrame, labelers: list) -> DataFrame:
    """apply each labeler ``fn(chunks) -> (msg_id, chunk_id, label)``;
    a failing labeler row gives ``Err`` (L13). Returns the vote table
    (msg_id, chunk_id, labeler, label) for :func:`ensemble_vote`."""
    votes = None
    for i, fn in enumerate(labelers):
        v = fn(chunks).select("msg_id", F.col("chunk_id").cast("int").alias("chunk_id"), F.lit(i).alias("labeler"),
                              F.coalesce(F.col("label"), F.lit("Err")).alias("label"))
        votes = v if votes is None else votes.unionByName(v)
    return votes
