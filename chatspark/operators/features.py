"""Per-user behaviour features (A01-A18, W01-W03, F05 registry).

Design for scale
- Every mean is an exact integer sum and count inside ONE ``groupBy(uid)``
  with map-side partial aggregation, so a user holding a third of all rows
  is combined per partition before the shuffle.
- The message-count filter (P07) is a HAVING on that aggregate: no window
  over a user, no join back to the messages.
- Cross-message features never build a per-user string or list:
  vocabulary and POS shares come from a ``(uid, token)`` count table;
  mean sentence length uses a segmented scan: a hot user's messages are cut
  into blocks of about as many rows each, wherever their ids lie.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import SENTIMENT_IDS
from ..functions.rounding import round_ratio
from ..session import cut_lineage
from .joins import sized_broadcast

DEFAULT_BLOCK = 1 << 16  # users with more rows may be cut for the ordered scan
CUTS = 1 << 9            # a cut user has so many blocks at most
HOT_SHARE = 1000         # only users with this part of all rows are cut, so at most so many


@dataclass
class Feature:
    """A user feature. ``kind='mean'``: ``partials`` are per-message columns,
    ``aggs`` aggregate them inside the shared ``groupBy(uid)``, ``final``
    reads the aggregate columns. ``kind='table'``: ``table(msgs)`` returns one
    row per uid with ``final`` already computed as column ``name``."""

    name: str
    required: tuple[str, ...]
    kind: str = "mean"
    partials: dict[str, Callable[[], Column]] = field(default_factory=dict)
    aggs: dict[str, Callable[[], Column]] = field(default_factory=dict)
    final: Callable[[], Column] | None = None
    table: Callable[..., DataFrame] | None = None
    default: float | None = None  # value when the table has no row for a user


REGISTRY: dict[str, Feature] = {}


def register_feature(feature: Feature) -> Feature:
    """add a feature; ``user_features`` reads only its required columns."""
    REGISTRY[feature.name] = feature
    return feature


def _mean_of(name: str, count_fn: Callable[[Column], Column], required=("content",)) -> Feature:
    part = f"_p_{name}"
    agg = f"_s_{name}"
    return register_feature(Feature(
        name=name,
        required=tuple(required),
        partials={part: lambda: count_fn(F.col("content"))},
        aggs={agg: lambda: F.sum(part)},
        final=lambda: round_ratio(F.col(agg), F.col("n_msgs")),
    ))


# ----- simple means (A02, A04-A06, A08, A09, A14, A15) --------------------
_mean_of("mean_wordcount", T.count_tokens_ws)
_mean_of("mean_emoji", T.count_emoji)
_mean_of("mean_emoticon", T.count_emoticon)
_mean_of("mean_punct", T.count_punct)
_mean_of("mean_links", T.count_links)
_mean_of("mean_abbrev", T.count_abbrev)
_mean_of("mean_code", T.count_code)
_mean_of("mean_hashtags", T.count_hashtags)


def _sentiment_partial() -> Column:
    valid = F.col("uid").isNotNull() & F.col("content").isNotNull() & F.col("sentiment").isNotNull()
    score = F.coalesce(F.create_map(*[F.lit(x) for kv in SENTIMENT_IDS.items() for x in kv])[F.col("sentiment")], F.lit(0))
    return F.when(valid, F.when(T.has_token("content"), score).otherwise(F.lit(0)))


# Rows with a NULL are left out; NULL when nothing is left
register_feature(Feature(
    name="mean_sentiment",
    required=("content", "sentiment"),
    partials={"_p_sent": _sentiment_partial},
    aggs={"_s_sent": lambda: F.sum("_p_sent"), "_n_sent": lambda: F.count("_p_sent")},
    final=lambda: round_ratio(F.col("_s_sent"), F.col("_n_sent")),
))


def _first_valid_tokens() -> Column:
    valid = F.col("uid").isNotNull() & F.col("content").isNotNull() & F.col("sentiment").isNotNull()
    return F.when(valid, F.struct(F.col("msg_id").alias("i"), T.count_tokens_ws("content").alias("t")))


# A07 compat: additionally NULL (user rejected) when the user's first
# complete message (msg_id order) has no token
register_feature(Feature(
    name="mean_sentiment_compat",
    required=("msg_id", "content", "sentiment"),
    partials={"_p_sent": _sentiment_partial, "_p_first": _first_valid_tokens},
    aggs={"_s_sent": lambda: F.sum("_p_sent"), "_n_sent": lambda: F.count("_p_sent"),
          "_first": (lambda: F.min("_p_first"), "min")},
    final=lambda: F.when(F.col("_first")["t"] >= 1, round_ratio(F.col("_s_sent"), F.col("_n_sent"))),
))


# ----- token table features (A03, A11-A13) ---------------------------------
def user_token_counts(msgs: DataFrame) -> DataFrame:
    """(uid, token, c): whitespace tokens counted per user. Pre-aggregating
    here keeps hot words to one row per user before any join."""
    return (msgs.select("uid", F.explode(T.tokens_ws("content")).alias("token"))
            .groupBy("uid", "token").agg(F.count(F.lit(1)).alias("c")))


def tag_key(token: Column) -> Column:
    """Lexicon key of a whitespace token: lower case, punctuation at the
    edges removed."""
    edge = f"^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$"
    return F.lower(F.regexp_replace(token, edge, ""))


def default_tag(key: Column) -> Column:
    """Tag for tokens missing from the lexicon (our own suffix rules)."""
    return (F.when(key == "", "SYM")
            .when(key.rlike(r"^\p{Nd}+$"), "CD")
            .when(key.endswith("ing"), "VBG")
            .when(key.endswith("ed"), "VBD")
            .when(key.endswith("ly"), "RB")
            .when(key.endswith("s"), "NNS")
            .otherwise("NN"))


def pos_tag_tokens(tokens: DataFrame, pos_lexicon: DataFrame | None, token_col: str = "token") -> DataFrame:
    """Tag each token by a word->tag lexicon (broadcast when its size
    is checked small, else a shuffle join), default tag by suffix rules."""
    t = tokens.withColumn("_key", tag_key(F.col(token_col)))
    if pos_lexicon is None:
        return t.withColumn("tag", default_tag(F.col("_key"))).drop("_key")
    lex = sized_broadcast(pos_lexicon.select(F.col("word").alias("_key"), F.col("tag").alias("_lex_tag")))
    return (t.join(lex, "_key", "left")
            .withColumn("tag", F.coalesce(F.col("_lex_tag"), default_tag(F.col("_key"))))
            .drop("_key", "_lex_tag"))


TOKEN_FEATURES = ("vocab_richness", "noun_freq", "verb_freq", "adj_freq")


def token_features_table(msgs: DataFrame, names=TOKEN_FEATURES, pos_lexicon: DataFrame | None = None,
                         **_) -> DataFrame:
    """A03 and A11-A13 from ONE (uid, token) count table."""
    return token_features(user_token_counts(msgs), names, pos_lexicon)


def token_features(counts: DataFrame, names=TOKEN_FEATURES, pos_lexicon: DataFrame | None = None) -> DataFrame:
    """A03 and A11-A13 of (uid, token, c): distinct/total tokens
    (case-sensitive, 2 places) and the shares of the exact tags NN, VB, JJ
    among all tagged tokens."""
    pos = [n for n in names if n in ("noun_freq", "verb_freq", "adj_freq")]
    if pos:
        counts = pos_tag_tokens(counts, pos_lexicon)
    aggs = [F.count(F.lit(1)).alias("_d"), F.sum("c").alias("_t")]
    tags = {"noun_freq": "NN", "verb_freq": "VB", "adj_freq": "JJ"}
    aggs += [F.sum(F.when(F.col("tag") == tags[n], F.col("c")).otherwise(0)).alias(f"_{n}") for n in pos]
    agg = counts.groupBy("uid").agg(*aggs)
    cols = []
    if "vocab_richness" in names:
        cols.append(round_ratio(F.col("_d"), F.col("_t")).alias("vocab_richness"))
    cols += [F.coalesce(F.col(f"_{n}") / F.nullif(F.col("_t"), F.lit(0)), F.lit(0.0)).alias(n) for n in pos]
    return agg.select("uid", *cols)


def vocab_richness_approx_table(msgs: DataFrame, rsd: float = 0.01, **_) -> DataFrame:
    """A03 scale variant: distinct tokens per user from a HyperLogLog++
    estimate (``approx_count_distinct``). The sketch is combined map-side,
    so the shuffle carries one small buffer per (user, partition) instead
    of one row per (user, token); relative error about ``rsd``."""
    t = msgs.select("uid", F.explode(T.tokens_ws("content")).alias("token"))
    agg = t.groupBy("uid").agg(F.approx_count_distinct("token", rsd).alias("_d"), F.count(F.lit(1)).alias("_t"))
    return agg.select("uid", round_ratio(F.col("_d"), F.col("_t")).alias("vocab_richness_approx"))


register_feature(Feature("vocab_richness_approx", ("content",), kind="table", table=vocab_richness_approx_table,
                         default=0.0))


# ----- A10: mean sentence length without a per-user string ----------------
def with_order_blocks(rows: DataFrame, scan: DataFrame, key: str = "uid", order: str = "msg_id",
                      block: int = DEFAULT_BLOCK, out: str = "_blk") -> DataFrame:
    """``rows`` with a block number that rises with ``order`` within ``key``.

    A key with more than ``block`` rows and at least one in HOT_SHARE of all
    is cut at CUTS quantiles of its ``order`` values, so its blocks hold about
    the same number of rows however the values are spread (ids made from
    times, say); other keys have one block. ``scan`` gives the keys and values
    to measure (two narrow passes, one if no key is hot). The cuts of at most
    HOT_SHARE keys are broadcast. Null values come first, rows of a null key
    are one block."""
    counts = scan.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.sum("_n").alias("all"), F.max(F.when(F.col(key).isNotNull(), F.col("_n"))).alias("most")).first()
    if (size["most"] or 0) <= block or size["most"] * HOT_SHARE < size["all"]:
        return rows.withColumn(out, F.lit(0))
    hot = counts.filter((F.col("_n") > block) & (F.col("_n") * HOT_SHARE >= size["all"])).select(key)
    cuts = scan.select(key, order).join(F.broadcast(hot), key, "left_semi").groupBy(key).agg(
        F.percentile_approx(order, [i / CUTS for i in range(1, CUTS)], 100 * CUTS).alias("_cuts"))
    # written once: a second evaluation may cut elsewhere
    tagged = rows.join(F.broadcast(cut_lineage(cuts)), key, "left")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(CUTS.bit_length() - 1))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(F.col("_cuts"), at + step - 1) < F.col(order), at + step).otherwise(at))
    return tagged.withColumn(out, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(place)).drop("_cuts")


def sentence_parts(msgs: DataFrame) -> DataFrame:
    """Per message: sentence matches k, words, and the carry inputs."""
    seg = T.sentence_segments(F.col("content"))
    has_term = F.size(seg) > 1
    first, last = F.element_at(seg, 1), F.element_at(seg, -1)
    return msgs.select(
        "uid", "msg_id",
        T.count_sentences(F.col("content")).alias("k"),
        T.count_words(F.col("content")).alias("words"),
        (has_term & ~first).alias("need"),
        F.when(has_term, last).when(first, F.lit(True)).alias("state"),
    )


def carried_state(parts: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """For each row with ``need``: ``carry`` = last non-null ``state`` among
    earlier messages of the same user (msg_id order).

    Two-level scan: inside blocks of a user's messages (bounded partitions
    even for a hot user, see :func:`with_order_blocks`), then across block
    summaries (one row per user and block)."""
    p = with_order_blocks(parts.filter(F.col("state").isNotNull()), parts.select("uid", "msg_id"), block=block, out="blk")
    w_in = Window.partitionBy("uid", "blk").orderBy("msg_id").rowsBetween(Window.unboundedPreceding, -1)
    local = p.withColumn("_local", F.last("state", ignorenulls=True).over(w_in))
    summary = p.groupBy("uid", "blk").agg(F.max_by("state", "msg_id").alias("_blk_state"))
    w_blk = Window.partitionBy("uid").orderBy("blk")
    incoming = summary.select("uid", "blk", F.lag("_blk_state").over(w_blk).alias("_in"))
    return (local.filter("need").join(incoming, ["uid", "blk"], "left")
            .select("uid", "msg_id", F.coalesce("_local", "_in", F.lit(False)).alias("carry")))


def sentence_carry_table(msgs: DataFrame, block: int = DEFAULT_BLOCK, **_) -> DataFrame:
    """(uid, _x): sentences that start in an earlier message of the user."""
    parts = msgs.select("uid", "msg_id", "content")
    return (carried_state(sentence_parts(parts).select("uid", "msg_id", "need", "state"), block)
            .groupBy("uid").agg(F.count_if("carry").alias("_x")))


def _sentence_final() -> Column:
    sentences = F.col("_s_k") + F.coalesce(F.col("_x"), F.lit(0))
    return F.when(sentences > 0, F.col("_s_w").cast("double") / sentences).otherwise(F.lit(0.0))


# A10: matches and words are plain sums in the shared aggregate; only the
# carried sentences need the ordered scan (joined in as an extra table).
register_feature(Feature(
    name="mean_sentence_len", required=("content",), kind="mean",
    partials={"_p_k": lambda: T.count_sentences(F.col("content")), "_p_w": lambda: T.count_words(F.col("content"))},
    aggs={"_s_k": lambda: F.sum("_p_k"), "_s_w": lambda: F.sum("_p_w")},
    final=_sentence_final, table=sentence_carry_table,
))
for _n in TOKEN_FEATURES:
    register_feature(Feature(_n, ("content",), kind="table", table=token_features_table, default=0.0))

# The 12 features of the user vector, in vector order.
VECTOR_FEATURES = [
    "mean_wordcount", "vocab_richness", "mean_emoji", "mean_emoticon", "mean_punct",
    "mean_sentiment", "mean_links", "mean_abbrev", "mean_sentence_len",
    "noun_freq", "verb_freq", "adj_freq",
]


def clean_for_features(msgs: DataFrame, min_chars: int = 25) -> DataFrame:
    """P06 then X01: messages of at least ``min_chars`` code points (NULL
    fails), custom emoji removed."""
    return (msgs.filter(F.length("content") >= min_chars)
            .withColumn("content", T.strip_custom_emoji("content")))


def user_features(msgs: DataFrame, features: list[str] | None = None, min_chars: int = 25,
                  min_msgs: int = 25, pos_lexicon: DataFrame | None = None,
                  block: int = DEFAULT_BLOCK, drop_incomplete: bool = True) -> DataFrame:
    """One row per user with ``n_msgs`` and the selected features.

    P06 runs before P07 (order matters). Plan: one per-message projection
    (all regex counts in one codegen stage) -> one ``groupBy(uid)`` with
    partial aggregation and the P07 HAVING; extra per-user tables (token
    counts, carried sentences) are one row per uid and join on uid.
    Users with a NULL feature (no labelled row for the sentiment mean) are
    left out when ``drop_incomplete``; :func:`feature_violations` reports
    them."""
    names = features or VECTOR_FEATURES
    feats = [REGISTRY[n] for n in names]
    needed = {"uid", "msg_id"} | {c for f in feats for c in f.required}
    m = clean_for_features(msgs.select(*[c for c in msgs.columns if c in needed]), min_chars)

    partials, aggs, reaggs = partial_columns(names)
    sentence = "mean_sentence_len" in names
    if sentence:
        blocked = with_order_blocks(m, msgs.select("uid", "msg_id"), block=block)
        out = _blocked_aggregate(blocked, partials, aggs, reaggs)
    else:
        per_msg = m.select("uid", *[e.alias(k) for k, e in partials.items()])
        out = per_msg.groupBy("uid").agg(F.count(F.lit(1)).alias("n_msgs"), *[e.alias(k) for k, e in aggs.items()])
    out = out.filter(F.col("n_msgs") >= min_msgs)

    done: set[int] = set()
    if sentence:
        done.add(id(sentence_carry_table))  # carried in-line by _blocked_aggregate
    for f in feats:
        if f.table is None or id(f.table) in done:
            continue
        done.add(id(f.table))
        t = f.table(m, names=[g.name for g in feats if g.table is f.table], pos_lexicon=pos_lexicon, block=block)
        out = out.join(t, "uid", "left")
    return finished_features(out, names, drop_incomplete)


def partial_columns(names: list[str]) -> tuple[dict, dict, dict]:
    """Of the features that are means: columns per message, their aggregates
    and how these combine ("sum", "min" or "max")."""
    means = [f for f in map(REGISTRY.get, names) if f.kind == "mean"]
    partials = {k: v() for f in means for k, v in f.partials.items()}
    aggs = {k: (v[0]() if isinstance(v, tuple) else v()) for f in means for k, v in f.aggs.items()}
    return partials, aggs, {k: (v[1] if isinstance(v, tuple) else "sum") for f in means for k, v in f.aggs.items()}


def finished_features(out: DataFrame, names: list[str], drop_incomplete: bool = True) -> DataFrame:
    """uid, n_msgs and the features from the combined aggregates."""
    cols = []
    for f in map(REGISTRY.get, names):
        if f.kind == "mean":
            cols.append(f.final().alias(f.name))
        elif f.default is not None:
            cols.append(F.coalesce(F.col(f.name), F.lit(f.default)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    out = out.select("uid", "n_msgs", *cols)
    if drop_incomplete:
        out = out.na.drop(subset=names)
    return out


COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def _blocked_aggregate(m: DataFrame, partials: dict, aggs: dict, reaggs: dict | None = None) -> DataFrame:
    """The shared aggregate when mean sentence length is requested: ONE text
    pass yields every per-message count plus the carry inputs; rows shuffle
    once by (uid, _blk) -- bounded groups even for a hot user --
    where the in-block carry (window) and the per-block sums are computed
    on the same partitioning; a window over one row per (user, block)
    brings in the state of earlier blocks; then the per-user sums. All
    registered aggregates must combine across blocks: sums and counts are
    summed, ``(fn, "min")`` / ``(fn, "max")`` specs are re-aggregated so."""
    reaggs = reaggs or {}
    seg = T.sentence_segments(F.col("content"))
    has_term = F.size(seg) > 1
    first, last = F.element_at(seg, 1), F.element_at(seg, -1)
    per_msg = m.select(
        "uid", "msg_id", "_blk",
        *[e.alias(k) for k, e in partials.items()],
        (has_term & ~first).alias("_need"),
        F.when(has_term, last).when(first, F.lit(True)).alias("_state"))
    w_in = Window.partitionBy("uid", "_blk").orderBy("msg_id").rowsBetween(Window.unboundedPreceding, -1)
    per_msg = per_msg.withColumn("_local", F.last("_state", ignorenulls=True).over(w_in))
    last_state = F.max(F.struct(F.when(F.col("_state").isNotNull(), F.col("msg_id")).alias("i"),
                                F.col("_state").alias("s")))["s"]
    blocks = per_msg.groupBy("uid", "_blk").agg(
        F.count(F.lit(1)).alias("_n"), *[e.alias(k) for k, e in aggs.items()],
        F.count_if(F.col("_need") & F.col("_local")).alias("_xl"),
        F.count_if(F.col("_need") & F.col("_local").isNull()).alias("_xo"),
        last_state.alias("_bs"))
    w_blk = Window.partitionBy("uid").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_in", F.last("_bs", ignorenulls=True).over(w_blk))
    carried = F.col("_xl") + F.when(F.col("_in"), F.col("_xo")).otherwise(F.lit(0))
    return blocks.groupBy("uid").agg(F.sum("_n").alias("n_msgs"),
                                     *[COMBINE[reaggs.get(k, "sum")](k).alias(k) for k in aggs],
                                     F.sum(carried).alias("_x"))


def as_vector(users: DataFrame, names: list[str] | None = None, col: str = "user_vec") -> DataFrame:
    """The features as one ``array<double>`` column (for models)."""
    names = names or VECTOR_FEATURES
    return users.withColumn(col, F.array(*[F.col(n).cast("double") for n in names]))


# ----- time features over events (W01-W03) ----------------------------------
def response_time_table(events: DataFrame, uid: str = "uid", ts: str = "ts", order: str = "event_id",
                        max_gap_s: int = 3600, block: str = "hour") -> DataFrame:
    """Gaps between consecutive messages of a user (ts, id order);
    gaps < ``max_gap_s`` kept; mean seconds, 2 places; 0 when none.

    Gaps inside a time block come from one window over (user, block), a
    bounded group, and are added up there; the gap into a block from its first
    time and the last of the user's previous block, on one row a block. One
    scan, one shuffle by (user, block) and one of the sums by user."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(F.col(uid).alias("uid"), us.alias("_us"), F.col(order).alias("_o"),
                      F.date_trunc(block, F.col(ts).cast("timestamp")).alias("_blk"))
    inside = F.col("_us") - F.lag("_us").over(Window.partitionBy("uid", "_blk").orderBy("_us", "_o"))
    short = F.col("_gap") < max_gap_s * 1_000_000
    blocks = e.withColumn("_gap", inside).groupBy("uid", "_blk").agg(
        F.sum(F.when(short, F.col("_gap"))).alias("_s"), F.count_if(short).alias("_n"),
        F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    into = F.col("_first") - F.lag("_last").over(Window.partitionBy("uid").orderBy("_blk"))
    sums = blocks.withColumn("_gap", into).groupBy("uid").agg(
        (F.coalesce(F.sum("_s"), F.lit(0)) + F.coalesce(F.sum(F.when(short, F.col("_gap"))), F.lit(0))).alias("_s"),
        (F.sum("_n") + F.count_if(short)).alias("_n"))
    return sums.select("uid", F.coalesce(round_ratio(F.col("_s"), F.col("_n") * F.lit(1_000_000)), F.lit(0.0))
                       .alias("mean_response_time"))


def msgs_per_day_table(events: DataFrame, uid: str = "uid", ts: str = "ts") -> DataFrame:
    """N / elapsed days between first and last date; 0 when n < 2 or
    the same day; 2 places."""
    d = F.to_date(F.col(ts))
    agg = events.groupBy(F.col(uid).alias("uid")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(d).alias("_d0"), F.max(d).alias("_d1"))
    days = F.datediff("_d1", "_d0")
    return agg.select("uid", F.when((F.col("_n") >= 2) & (days > 0), round_ratio(F.col("_n"), days))
                      .otherwise(F.lit(0.0)).alias("msgs_per_day"))


def active_hours(events: DataFrame, k: int = 3, uid: str = "uid", ts: str = "ts") -> DataFrame:
    """The user's top-k hours of day by message count (ties: earlier
    hour). Counts first, so each user ranks at most 24 rows."""
    from .ordered import top_k_per_group
    counts = events.groupBy(F.col(uid).alias("uid"), F.hour(F.col(ts)).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))
    return top_k_per_group(counts, ["uid"], [F.desc("n"), F.asc("hour")], k, rank_col="rank")


def feature_violations(msgs: DataFrame, users: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Counts of rule violations in one aggregate row."""
    names = names or VECTOR_FEATURES
    null_any = F.lit(False)
    for n in names:
        null_any = null_any | F.col(n).isNull()
    m = msgs.agg(F.count_if(F.col("uid").isNull()).alias("missing_uid"),
                 F.count_if(F.col("content").isNull()).alias("missing_content"))
    u = users.agg(F.count_if(null_any).alias("users_with_null_feature"))
    return _one_row_concat(m, u)


def _one_row_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two single-row aggregates side by side."""
    from .scalars import attach_one_row
    return attach_one_row(a, b)
