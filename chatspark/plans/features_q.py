"""User feature queries (A01-A18, W01-W03, J08, P15) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import duck_round_ratio as rr
from ..operators import features as FT
from ..sources.fixtures import Fixtures, RELATIONS, duck_with
from . import duck as D
from .registry import query

MIN_CHARS = 25
MIN_MSGS = 25

# ---------------------------------------------------------------- oracles
_BASE = f"""m AS (SELECT msg_id, uid, {D.strip('content', D.CUSTOM_EMOJI)} AS content, sentiment
  FROM msgs WHERE length(content) >= {MIN_CHARS}),
u AS (SELECT uid, count(*) AS n_msgs FROM m GROUP BY uid HAVING count(*) >= {{min_msgs}})"""

_MEAN_EXPR = {
    "mean_wordcount": D.n_tokens("content"),
    "mean_emoji": D.count("content", D.EMOJI_RUN),
    "mean_emoticon": D.n_emoticons("content"),
    "mean_punct": D.n_punct("content"),
    "mean_links": D.count("content", D.LINK),
    "mean_abbrev": D.n_abbrev("content"),
    "mean_code": D.count("content", D.CODE_BLOCK),
    "mean_hashtags": D.count("content", D.HASHTAG),
}

_SENT_SCORE = (f"CASE WHEN uid IS NOT NULL AND content IS NOT NULL AND sentiment IS NOT NULL THEN "
               f"CASE WHEN {D.n_tokens('content')} >= 1 THEN CASE sentiment WHEN 'neg' THEN 0 WHEN 'neu' THEN 1 "
               f"WHEN 'pos' THEN 2 ELSE 0 END ELSE 0 END END")

_TAG_KEY = f"lower(regexp_replace(token, {D.q('^[^' + D.W[1:-1] + ']+|[^' + D.W[1:-1] + ']+$')}, '', 'g'))"
_DEFAULT_TAG = (r"CASE WHEN k = '' THEN 'SYM' WHEN regexp_full_match(k, '\p{Nd}+') THEN 'CD' "
                r"WHEN suffix(k, 'ing') THEN 'VBG' WHEN suffix(k, 'ed') THEN 'VBD' WHEN suffix(k, 'ly') THEN 'RB' "
                r"WHEN suffix(k, 's') THEN 'NNS' ELSE 'NN' END")


def duck_user_features(names: list[str], min_msgs: int = MIN_MSGS, drop_incomplete: bool = True) -> str:
    ctes = [_BASE.replace("{min_msgs}", str(min_msgs))]
    sel = ["u.uid", "u.n_msgs"]
    joins = []
    means = [n for n in names if n in _MEAN_EXPR]
    if means or "mean_sentiment" in names:
        cols = [f"sum({_MEAN_EXPR[n]}) AS s_{n}" for n in means]
        if "mean_sentiment" in names:
            cols += [f"sum({_SENT_SCORE}) AS s_sent", f"count({_SENT_SCORE}) AS n_sent"]
        ctes.append(f"a AS (SELECT uid, count(*) AS n, {', '.join(cols)} FROM m GROUP BY uid)")
        joins.append("JOIN a ON a.uid = u.uid")
    tok_needed = any(n in names for n in ("vocab_richness", "noun_freq", "verb_freq", "adj_freq"))
    if tok_needed:
        ctes.append(f"tk AS (SELECT uid, unnest({D.tokens('content')}) AS token FROM m)")
    if "vocab_richness" in names:
        ctes.append("vr AS (SELECT uid, count(DISTINCT token) AS d, count(*) AS t FROM tk GROUP BY uid)")
        joins.append("LEFT JOIN vr ON vr.uid = u.uid")
    if any(n in names for n in ("noun_freq", "verb_freq", "adj_freq")):
        ctes.append(f"tg AS (SELECT tk.uid, coalesce(pl.tag, {_DEFAULT_TAG}) AS tag FROM "
                    f"(SELECT uid, {_TAG_KEY} AS k FROM tk) tk LEFT JOIN pos_lexicon pl ON pl.word = tk.k)")
        ctes.append("ps AS (SELECT uid, count(*) AS t, count(*) FILTER (WHERE tag = 'NN') AS nn, "
                    "count(*) FILTER (WHERE tag = 'VB') AS vb, count(*) FILTER (WHERE tag = 'JJ') AS jj FROM tg GROUP BY uid)")
        joins.append("LEFT JOIN ps ON ps.uid = u.uid")
    if "mean_sentence_len" in names:
        ctes.append("js AS (SELECT uid, string_agg(content, ' ' ORDER BY msg_id) AS s FROM m GROUP BY uid)")
        ctes.append(f"sl AS (SELECT uid, {D.count('s', D.SENTENCE)} AS ns, {D.count('s', D.WORD_RUN)} AS nw FROM js)")
        joins.append("LEFT JOIN sl ON sl.uid = u.uid")
    for n in names:
        if n in _MEAN_EXPR:
            sel.append(f"{rr(f's_{n}', 'a.n')} AS {n}")
        elif n == "mean_sentiment":
            sel.append(f"{rr('s_sent', 'n_sent')} AS mean_sentiment")
        elif n == "vocab_richness":
            sel.append(f"coalesce({rr('vr.d', 'vr.t')}, 0.0) AS vocab_richness")
        elif n in ("noun_freq", "verb_freq", "adj_freq"):
            c = {"noun_freq": "nn", "verb_freq": "vb", "adj_freq": "jj"}[n]
            sel.append(f"coalesce(CAST(ps.{c} AS DOUBLE) / NULLIF(ps.t, 0), 0.0) AS {n}")
        elif n == "mean_sentence_len":
            sel.append("CASE WHEN sl.ns > 0 THEN CAST(sl.nw AS DOUBLE) / sl.ns ELSE 0.0 END AS mean_sentence_len")
    deps = ["msgs"] + (["pos_lexicon"] if any(n in names for n in ("noun_freq", "verb_freq", "adj_freq")) else [])
    head = duck_with(*deps)
    body = f"SELECT {', '.join(sel)} FROM u {' '.join(joins)}"
    if drop_incomplete:
        body = f"SELECT * FROM ({body}) WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names)
    prefix = head.rstrip() + ",\n" if head else "WITH "
    return prefix + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------- queries
def _user_q(name: str, survey_id: str, names: list[str], lexicon: bool = False):
    def build(spark, sf_dir):
        fx = Fixtures(spark, sf_dir)
        return FT.user_features(fx.msgs, names, min_chars=MIN_CHARS, min_msgs=MIN_MSGS,
                                pos_lexicon=fx.pos_lexicon if lexicon else None)

    query(name, survey_id, duck_user_features(names))(build)


_user_q("feat_mean_wordcount", "A02", ["mean_wordcount"])
_user_q("feat_vocab_richness", "A03", ["vocab_richness"])
_user_q("feat_mean_emoji", "A04", ["mean_emoji"])
_user_q("feat_mean_emoticon", "A05", ["mean_emoticon"])
_user_q("feat_mean_punct", "A06", ["mean_punct"])
_user_q("feat_mean_sentiment", "A07", ["mean_sentiment"])
_user_q("feat_mean_links", "A08", ["mean_links"])
_user_q("feat_mean_abbrev", "A09", ["mean_abbrev"])
_user_q("feat_mean_sentence_len", "A10", ["mean_sentence_len"])
_user_q("feat_pos_freqs", "A11-A13", ["noun_freq", "verb_freq", "adj_freq"], lexicon=True)
_user_q("feat_mean_code", "A14", ["mean_code"])
_user_q("feat_mean_hashtags", "A15", ["mean_hashtags"])
_user_q("user_vector", "A18", FT.VECTOR_FEATURES, lexicon=True)


@query("group_by_user", "A01", duck_with("msgs") + "SELECT uid, count(*) AS n_msgs, "
       "count(sentiment) AS n_labelled FROM msgs GROUP BY uid")
def group_by_user(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs
    return m.groupBy("uid").agg(F.count(F.lit(1)).alias("n_msgs"), F.count("sentiment").alias("n_labelled"))


_EV_UID = "SELECT event_id, ts, user_id AS uid FROM events"


@query("feat_mean_response_time", "W01", f"""
WITH e AS ({_EV_UID}),
g AS (SELECT uid, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY uid ORDER BY ts, event_id) AS gap FROM e),
a AS (SELECT uid, sum(gap) FILTER (WHERE gap < 3600000000) AS s, count(gap) FILTER (WHERE gap < 3600000000) AS n FROM g GROUP BY uid)
SELECT uid, coalesce({rr('s', 'n * 1000000')}, 0.0) AS mean_response_time FROM a""")
def feat_mean_response_time(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).events.withColumnRenamed("user_id", "uid")
    return FT.response_time_table(ev)


@query("feat_msgs_per_day", "W02", f"""
WITH a AS (SELECT user_id AS uid, count(*) AS n, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS d
  FROM events GROUP BY user_id)
SELECT uid, CASE WHEN n >= 2 AND d > 0 THEN {rr('n', 'd')} ELSE 0.0 END AS msgs_per_day FROM a""")
def feat_msgs_per_day(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).events.withColumnRenamed("user_id", "uid")
    return FT.msgs_per_day_table(ev)


@query("feat_active_hours", "W03", """
WITH c AS (SELECT user_id AS uid, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, hour) AS rank FROM c)
SELECT uid, hour, n, rank FROM r WHERE rank <= 3""")
def feat_active_hours(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).events.withColumnRenamed("user_id", "uid")
    return FT.active_hours(ev, 3).select("uid", "hour", "n", F.col("rank").cast("bigint").alias("rank"))


@query("pos_tag_tokens", "J08", duck_with("msgs", "pos_lexicon") + f"""
, tk AS (SELECT unnest({D.tokens('content')}) AS token FROM msgs),
c AS (SELECT token, count(*) AS c FROM tk GROUP BY token),
k AS (SELECT token, c, {_TAG_KEY} AS k FROM c)
SELECT coalesce(pl.tag, {_DEFAULT_TAG}) AS tag, CAST(sum(c) AS BIGINT) AS n FROM k LEFT JOIN pos_lexicon pl ON pl.word = k.k GROUP BY 1""")
def pos_tag_tokens_q(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    toks = (fx.msgs.select(F.explode(FT.T.tokens_ws("content")).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("c")))
    tagged = FT.pos_tag_tokens(toks, fx.pos_lexicon)
    return tagged.groupBy("tag").agg(F.sum("c").alias("n"))


@query("tag_counts", "A23", duck_with("msgs", "pos_lexicon") + f"""
, tk AS (SELECT uid, unnest({D.tokens('content')}) AS token FROM msgs),
k AS (SELECT uid, {_TAG_KEY} AS k FROM tk)
SELECT uid, coalesce(pl.tag, {_DEFAULT_TAG}) AS tag, count(*) AS n FROM k LEFT JOIN pos_lexicon pl ON pl.word = k.k GROUP BY 1, 2""")
def tag_counts(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    tagged = FT.pos_tag_tokens(FT.user_token_counts(fx.msgs), fx.pos_lexicon)
    return tagged.groupBy("uid", "tag").agg(F.sum("c").alias("n"))


@query("quality_checks", "P15", duck_with("msgs_dirty") + """
SELECT count(*) FILTER (WHERE uid IS NULL) AS missing_uid, count(*) FILTER (WHERE content IS NULL) AS missing_content,
  count(*) FILTER (WHERE sentiment IS NULL) AS missing_sentiment,
  count(*) FILTER (WHERE sentiment NOT IN ('pos', 'neg', 'neu')) AS bad_label FROM msgs_dirty""")
def quality_checks(spark, sf_dir):
    from ..operators.clean import quality_checks as qc
    return qc(Fixtures(spark, sf_dir).msgs_dirty)


@query("one_user_violations", "P15", duck_with("msgs_dirty") + """
SELECT CAST(msg_id // 50 AS BIGINT) AS bundle, count(DISTINCT uid) AS n_users, count(*) FILTER (WHERE uid IS NULL) AS missing_uid
FROM msgs_dirty GROUP BY 1 HAVING n_users > 1 OR (missing_uid > 0 AND n_users > 0)""")
def one_user_violations(spark, sf_dir):
    """Bundles of 50 message numbers that are not one user's."""
    from ..operators.clean import one_user_violations as ouv
    d = Fixtures(spark, sf_dir).msgs_dirty.withColumn("bundle", F.expr("msg_id div 50"))
    return ouv(d, "bundle")


def _violations_sql() -> str:
    head, users = duck_user_features(FT.VECTOR_FEATURES, min_msgs=1, drop_incomplete=False).rsplit("\n", 1)
    null = " OR ".join(f"{n} IS NULL" for n in FT.VECTOR_FEATURES)
    return (head + "\n, uv AS (" + users + "), dirty AS (" + RELATIONS["msgs_dirty"][2].replace("{msgs}", "msgs") + ")\n"
            "SELECT d.*, u.* FROM (SELECT count(*) FILTER (WHERE uid IS NULL) AS missing_uid, "
            "count(*) FILTER (WHERE content IS NULL) AS missing_content FROM dirty) d, "
            f"(SELECT count(*) FILTER (WHERE {null}) AS users_with_null_feature FROM uv) u")


@query("feature_violations", "P15", _violations_sql())
def feature_violations(spark, sf_dir):
    """Raw rows without user or text, and users of the clean ones with a
    feature that is null (no labelled message for the mean sentiment)."""
    fx = Fixtures(spark, sf_dir)
    users = FT.user_features(fx.msgs, min_msgs=1, pos_lexicon=fx.pos_lexicon, drop_incomplete=False)
    return FT.feature_violations(fx.msgs_dirty, users)


# a feature registered by the caller joins the shared aggregate
FT.register_feature(FT.Feature(
    name="mean_exclamations", required=("content",),
    partials={"_p_excl": lambda: F.coalesce(F.length("content") - F.length(F.replace(F.col("content"), F.lit("!"), F.lit(""))), F.lit(0))},
    aggs={"_s_excl": lambda: F.sum("_p_excl")},
    final=lambda: FT.round_ratio(F.col("_s_excl"), F.col("n_msgs")),
))
_EXCL = "(length(content) - length(replace(content, '!', '')))"


@query("custom_feature", "F05/P18", duck_user_features(["mean_wordcount"]).replace(
    f"sum({_MEAN_EXPR['mean_wordcount']}) AS s_mean_wordcount", f"sum({_MEAN_EXPR['mean_wordcount']}) AS s_mean_wordcount, sum({_EXCL}) AS s_excl").replace(
    "AS mean_wordcount FROM u", f"AS mean_wordcount, {rr('s_excl', 'a.n')} AS mean_exclamations FROM u").replace(
    "WHERE mean_wordcount IS NOT NULL", "WHERE mean_wordcount IS NOT NULL AND mean_exclamations IS NOT NULL"))
def custom_feature(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return FT.user_features(fx.msgs, ["mean_wordcount", "mean_exclamations"], min_chars=MIN_CHARS, min_msgs=MIN_MSGS)


@query("feat_mean_attachments", "A16/A17", f"""
SELECT user_id AS uid, {rr('sum(coalesce(length(props), 0))', 'count(*)')} AS mean_attachments,
  {rr("sum(CASE WHEN props IS NULL OR props = '' THEN 0 ELSE len(string_split(props, ',')) END)", 'count(*)')} AS mean_quotes
FROM events GROUP BY user_id""")
def feat_mean_attachments(spark, sf_dir):
    """A16/A17 over a comma-list text column (``events.props``): mean
    string length and mean list size per user."""
    ev = Fixtures(spark, sf_dir).events
    a = ev.groupBy(F.col("user_id").alias("uid")).agg(
        F.sum(FT.T.attachment_length("props")).alias("_l"), F.sum(FT.T.attachment_list_size("props")).alias("_q"),
        F.count(F.lit(1)).alias("_n"))
    return a.select("uid", FT.round_ratio(F.col("_l"), F.col("_n")).alias("mean_attachments"),
                    FT.round_ratio(F.col("_q"), F.col("_n")).alias("mean_quotes"))


@query("feat_mean_sentiment_compat", "A07 compat", duck_with("msgs") + f"""
, m AS (SELECT msg_id, uid, {D.strip('content', D.CUSTOM_EMOJI)} AS content, sentiment FROM msgs WHERE length(content) >= {MIN_CHARS}),
a AS (SELECT uid, count(*) AS n, sum({_SENT_SCORE}) AS s, count({_SENT_SCORE}) AS c,
  arg_min({D.n_tokens('content')}, msg_id) FILTER (WHERE uid IS NOT NULL AND content IS NOT NULL AND sentiment IS NOT NULL) AS ft
  FROM m GROUP BY uid HAVING count(*) >= {MIN_MSGS})
SELECT uid, n AS n_msgs, v AS mean_sentiment_compat FROM (
  SELECT uid, n, CASE WHEN ft >= 1 THEN {rr('s', 'c')} END AS v FROM a) WHERE v IS NOT NULL""")
def feat_mean_sentiment_compat(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return FT.user_features(fx.msgs, ["mean_sentiment_compat"], min_chars=MIN_CHARS, min_msgs=MIN_MSGS)


@query("feat_vocab_richness_approx", "A03 (approx)")
def feat_vocab_richness_approx(spark, sf_dir):
    """HyperLogLog variant of A03 for very large inputs (rows-only check;
    pytest bounds its distance to the exact value)."""
    fx = Fixtures(spark, sf_dir)
    return FT.user_features(fx.msgs, ["vocab_richness_approx"], min_chars=MIN_CHARS, min_msgs=MIN_MSGS)
