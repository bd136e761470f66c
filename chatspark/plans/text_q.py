"""Text and filter queries (X01-X22, P05-P19, S10) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import DENY_EXACT, DENY_SUBSTRINGS, ENGLISH_STOP_WORDS
from ..operators import clean as C
from ..sources.fixtures import Fixtures, duck_with
from . import duck as D
from .registry import query


def _per_msg(name, sid, spark_fn, duck_expr, col="n", source="msgs"):
    def build(spark, sf_dir):
        df = Fixtures(spark, sf_dir).get(source)
        return df.select("msg_id", spark_fn(F.col("content")).alias(col))

    if col == "n":  # counts are INTEGER in Spark
        duck_expr = f"CAST({duck_expr} AS INTEGER)"
    query(name, sid, duck_with(source) + f"SELECT msg_id, {duck_expr} AS {col} FROM {source}")(build)


# Removals (whole texts out)
_per_msg("strip_custom_emoji", "X01", T.strip_custom_emoji, D.strip("content", D.CUSTOM_EMOJI), "content")
_per_msg("strip_urls", "X02", T.strip_urls, D.strip("content", D.LINK), "content")
_per_msg("strip_mentions", "X03", T.strip_mentions, D.strip("content", D.MENTION), "content")
_per_msg("strip_patterns", "X04", lambda c: T.strip_patterns(c, [T.LINK, T.MENTION]),
         D.strip(D.strip("content", D.LINK), D.MENTION), "content")
_per_msg("strip_code_blocks", "X22", T.strip_code_blocks, D.strip("content", D.CODE_BLOCK), "content")

# Per-message counts
_per_msg("count_emoji", "X06", T.count_emoji, D.count("content", D.EMOJI_RUN))
_per_msg("count_emoticon", "X07", T.count_emoticon, D.n_emoticons("content"))
_per_msg("count_punct", "X08", T.count_punct, D.n_punct("content"))
_per_msg("count_links", "X09", T.count_links, D.count("content", D.LINK))
_per_msg("count_code", "X10", T.count_code, D.count("content", D.CODE_BLOCK))
_per_msg("count_abbrev", "X11", T.count_abbrev, D.n_abbrev("content"))
_per_msg("count_hashtags", "X12", T.count_hashtags, D.count("content", D.HASHTAG))


@query("count_sentences", "X15", duck_with("msgs") +
       f"SELECT msg_id, CAST({D.count('content', D.SENTENCE)} AS INTEGER) AS n_sentences, "
       f"CAST({D.count('content', D.WORD_RUN)} AS INTEGER) AS n_words FROM msgs")
def count_sentences(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs
    return m.select("msg_id", T.count_sentences("content").alias("n_sentences"), T.count_words("content").alias("n_words"))


@query("chunk_text", "X05", duck_with("msgs") + f"""
SELECT msg_id, chunk_id, chunk FROM (
  SELECT msg_id, CAST(i AS INTEGER) AS chunk_id, {D.py_strip('substring(content, i * 510 + 1, 510)')} AS chunk
  FROM (SELECT msg_id, content, unnest(range(greatest(length(content) - 1, 0) // 510 + 1)) AS i FROM msgs))
WHERE chunk <> ''""")
def chunk_text(spark, sf_dir):
    return C.chunk_text(Fixtures(spark, sf_dir).msgs.select("msg_id", "content"))


@query("tokenize_ws", "X13", duck_with("msgs") +
       f"SELECT token, count(*) AS n FROM (SELECT unnest({D.tokens('content')}) AS token FROM msgs) GROUP BY token")
def tokenize_ws(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs
    return (m.select(F.explode(T.tokens_ws("content")).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


_STOP = ", ".join(D.q(w) for w in ENGLISH_STOP_WORDS + DENY_EXACT)
_DENY = " AND ".join(f"NOT contains(word, {D.q(s)})" for s in DENY_SUBSTRINGS)
DUCK_TOPIC_WORDS = (f"SELECT msg_id, uid, word FROM (SELECT msg_id, uid, lower(w) AS word FROM "
                    f"(SELECT msg_id, uid, unnest(regexp_extract_all(content, {D.q(D.WORD_RUN)})) AS w FROM msgs) "
                    f"WHERE NOT regexp_full_match(w, '\\p{{Nd}}+')) WHERE word NOT IN ({_STOP}) AND {_DENY}")


@query("tokenize_topic_words", "X14", duck_with("msgs") +
       f"SELECT word, count(*) AS n FROM ({DUCK_TOPIC_WORDS.replace('{{', '{').replace('}}', '}')}) GROUP BY word")
def tokenize_topic_words(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs
    return m.select(F.explode(T.topic_terms("content")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("attachment_counts", "X16", "SELECT event_id, CAST(length(props) AS INTEGER) AS attachment_len, "
       "CAST(CASE WHEN props IS NULL OR props = '' THEN 0 ELSE len(string_split(props, ',')) END AS INTEGER) AS attachment_items FROM events")
def attachment_counts(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).events
    return ev.select("event_id", T.attachment_length("props").alias("attachment_len"),
                     T.attachment_list_size("props").alias("attachment_items"))


@query("parse_iso_ts", "X17", "SELECT event_id, epoch_us(CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS TIMESTAMP)) AS ts_us, "
       "CAST(ts AS DATE) AS day FROM events")
def parse_iso_ts(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).events
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parsed = T.parse_iso_ts(iso)
    return ev.select("event_id", F.unix_micros(parsed).alias("ts_us"), F.to_date(parsed).alias("day"))


@query("split_uid", "X18", "SELECT DISTINCT u AS uid, split_part(u, '#', 1) AS name FROM "
       "(SELECT CASE WHEN user_id = 0 THEN 'HelperBot#0000' ELSE 'user' || CAST(user_id AS VARCHAR) || '#0001' END AS u FROM events)")
def split_uid(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).events
    u = F.when(F.col("user_id") == 0, "HelperBot#0000").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("#0001")))
    return ev.select(u.alias("uid")).distinct().select("uid", T.split_uid("uid").alias("name"))


@query("append_columns", "X21", duck_with("msgs") + "SELECT msg_id, 'chat' AS source, coalesce(sentiment, 'neu') AS label FROM msgs")
def append_columns(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs
    return m.select("msg_id", F.lit("chat").alias("source"), F.coalesce("sentiment", F.lit("neu")).alias("label"))


@query("split_text_lines", "S10", """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, arr[i] AS line FROM (
  SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i FROM (
    SELECT doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS arr FROM documents))""")
def split_text_lines(spark, sf_dir):
    d = Fixtures(spark, sf_dir).documents
    return d.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n")).alias("pos", "line"))


# ----------------------------------------------------------- filters (P*)
def _ids(name, sid, spark_fn, duck_where, source="msgs_dirty", cols=("msg_id",)):
    def build(spark, sf_dir):
        return spark_fn(Fixtures(spark, sf_dir).get(source)).select(*cols)

    query(name, sid, duck_with(source) + f"SELECT {', '.join(cols)} FROM {source} WHERE {duck_where}")(build)


_ids("filter_label_in", "P05", C.filter_label_in, "sentiment IN ('pos', 'neg', 'neu')", cols=("msg_id", "sentiment"))
_ids("filter_min_len", "P06", C.filter_min_len, "length(content) >= 25")
_ids("filter_blank", "P09", C.filter_blank, f"{D.py_strip('content')} <> ''")
_ids("filter_printable", "P10", C.filter_printable,
     f"regexp_matches({D.py_strip('content')}, '[ -~\\t\\n\\x0B\\f\\r]')")
_ids("filter_uid_not_contains", "P11", lambda d: C.filter_uid_not_contains(d, ["src1"]), "NOT contains(uid, 'src1')")
_ids("filter_user", "P12", lambda d: C.filter_user(d, "en-src0"), "uid = 'en-src0'", source="msgs",
     cols=("msg_id", "content"))
_ids("empty_to_null_drop", "P14", C.empty_to_null_drop, "content IS NOT NULL AND content <> ''")
_ids("drop_first_row", "P16", C.drop_first_row, "msg_id > (SELECT min(msg_id) FROM msgs_dirty)")


@query("filter_min_group", "P07", duck_with("msgs") + """
, m AS (SELECT msg_id, uid FROM msgs WHERE length(content) >= 25)
SELECT msg_id, uid FROM m WHERE uid IN (SELECT uid FROM m GROUP BY uid HAVING count(*) >= 25)""")
def filter_min_group(spark, sf_dir):
    m = C.filter_min_len(Fixtures(spark, sf_dir).msgs)
    return C.filter_min_group(m, 25).select("msg_id", "uid")


@query("drop_nulls", "P08", duck_with("msgs_dirty") + """
SELECT count(*) FILTER (WHERE uid IS NOT NULL AND content IS NOT NULL AND sentiment IS NOT NULL) AS n_any,
  count(*) FILTER (WHERE content IS NOT NULL AND sentiment IS NOT NULL) AS n_subset,
  count(*) FILTER (WHERE uid IS NOT NULL OR content IS NOT NULL OR sentiment IS NOT NULL) AS n_all FROM msgs_dirty""")
def drop_nulls(spark, sf_dir):
    d = Fixtures(spark, sf_dir).msgs_dirty.select("uid", "content", "sentiment")
    a = C.drop_nulls(d, "any").agg(F.count(F.lit(1)).alias("n_any"))
    s = C.drop_nulls(d, "any", ["content", "sentiment"]).agg(F.count(F.lit(1)).alias("n_subset"))
    al = C.drop_nulls(d, "all").agg(F.count(F.lit(1)).alias("n_all"))
    from ..operators.features import _one_row_concat
    return _one_row_concat(_one_row_concat(a, s), al)


@query("null_to_nan_text", "P13", duck_with("msgs_dirty") +
       "SELECT msg_id, coalesce(content, 'nan') AS content FROM msgs_dirty WHERE content IS NULL OR content = 'nan'")
def null_to_nan_text(spark, sf_dir):
    d = C.null_to_nan_text(Fixtures(spark, sf_dir).msgs_dirty)
    return d.filter(F.col("content") == "nan").select("msg_id", "content")


@query("truncate_words", "P17", duck_with("msgs") +
       f"SELECT msg_id, array_to_string({D.tokens('content')}[1:20], ' ') AS content FROM msgs")
def truncate_words(spark, sf_dir):
    return C.truncate_words(Fixtures(spark, sf_dir).msgs, 20).select("msg_id", "content")


@query("dropped_rows_report", "P19", duck_with("msgs_dirty") +
       "SELECT count(*) FILTER (WHERE content IS NULL OR sentiment IS NULL) AS dropped, "
       "count(*) FILTER (WHERE content IS NOT NULL AND sentiment IS NOT NULL) AS kept FROM msgs_dirty")
def dropped_rows_report(spark, sf_dir):
    return C.dropped_rows_report(Fixtures(spark, sf_dir).msgs_dirty)


@query("clean_messages", "X04+P14", duck_with("msgs_dirty") + f"""
SELECT msg_id, content FROM (SELECT msg_id, {D.strip(D.strip(D.strip('content', D.CUSTOM_EMOJI), D.LINK), D.MENTION)} AS content
  FROM msgs_dirty) WHERE content IS NOT NULL AND content <> ''""")
def clean_messages(spark, sf_dir):
    return C.clean_messages(Fixtures(spark, sf_dir).msgs_dirty).select("msg_id", "content")


@query("encode_pad", "X20", duck_with("msgs") + """
, t AS (SELECT msg_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}')) AS token,
    unnest(range(len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}')))) AS pos FROM msgs),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM t GROUP BY token),
s AS (SELECT m.msg_id, coalesce(list(v.id ORDER BY t.pos) FILTER (WHERE v.id IS NOT NULL), []) AS ids
  FROM msgs m LEFT JOIN t ON t.msg_id = m.msg_id LEFT JOIN v ON v.token = t.token GROUP BY m.msg_id),
b AS (SELECT *, max(least(len(ids), 512)) OVER (PARTITION BY floor(msg_id / 32)) AS L FROM s)
SELECT msg_id, list_concat(ids[1:512], list_resize([]::BIGINT[], greatest(L - least(len(ids), 512), 0), 0)) AS input_ids,
  list_concat(list_resize([]::INTEGER[], least(len(ids), 512), 1), list_resize([]::INTEGER[], greatest(L - least(len(ids), 512), 0), 0)) AS attention_mask
FROM b""")
def encode_pad(spark, sf_dir):
    from ..operators.encode import build_vocabulary
    from ..operators.encode import encode_pad as ep
    m = Fixtures(spark, sf_dir).msgs.select("msg_id", "content")
    return ep(m, build_vocabulary(m), batch_size=32)


@query("drop_unnamed", "P01", duck_with("msgs") + "SELECT msg_id, uid, content, sentiment FROM msgs")
def drop_unnamed(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs.withColumn("Unnamed: 0", F.col("msg_id") - 1)
    return C.drop_prefixed(m, "Unnamed")


@query("rename_positional", "P02", duck_with("msgs") +
       "SELECT msg_id AS id, uid AS user_id, content AS text, sentiment AS label FROM msgs")
def rename_positional(spark, sf_dir):
    return C.rename_positional(Fixtures(spark, sf_dir).msgs, ["id", "user_id", "text", "label"])


@query("rename_drop_if_present", "P03", duck_with("msgs") + "SELECT msg_id, uid, content, sentiment FROM msgs")
def rename_drop_if_present(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs.withColumnRenamed("sentiment", "neu").withColumn("nan", F.lit(None).cast("string"))
    return C.rename_drop_if_present(m)


@query("reject_column", "P04", duck_with("msgs") + """
SELECT 'clean' AS "case", false AS raised, CAST(NULL AS VARCHAR) AS message, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_values FROM msgs
UNION ALL SELECT 'with_nan_column', true, 'nan column found (first non-null at msg_id='
  || CAST(min(msg_id) FILTER (WHERE msg_id % 7 = 3) AS VARCHAR) || ')', count(*), count(*) FILTER (WHERE msg_id % 7 = 3) FROM msgs""")
def reject_column(spark, sf_dir):
    """The guard on the messages and on the messages with a ``nan`` column:
    its message, the rows it saw and the values that stand in the column."""
    m = Fixtures(spark, sf_dir).msgs
    cases = {"clean": m, "with_nan_column": m.withColumn("nan", F.when(F.col("msg_id") % 7 == 3, F.lit("x")))}
    parts = []
    for name, df in cases.items():
        message = None
        try:
            C.reject_column(df)
        except ValueError as e:
            message = str(e)
        values = F.count("nan") if "nan" in df.columns else F.lit(0).cast("long")
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), values.alias("n_values")).select(
            F.lit(name).alias("case"), F.lit(message is not None).alias("raised"),
            F.lit(message).cast("string").alias("message"), "n_rows", "n_values"))
    return parts[0].unionByName(parts[1])
