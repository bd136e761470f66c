"""Source and sink queries (S01-S16): data written by Spark to the shared
checkpoint folder and read back, raw-log parsers, feature store, reports
and models. DuckDB oracles for every SQL-expressible round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import sets as S
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.fixtures import Fixtures, duck_with
from ..streaming.streams import scratch
from . import duck as D
from .features_q import duck_user_features
from .registry import query


@query("scan_pipe_csv", "S01", duck_with("msgs") + "SELECT msg_id, uid, content, sentiment FROM msgs")
def scan_pipe_csv(spark, sf_dir):
    path = scratch(spark, "s01")
    K.write_pipe(Fixtures(spark, sf_dir).msgs, path)
    return R.read_pipe(spark, path, "msg_id long, uid string, content string, sentiment string")


@query("sink_pipe_csv", "S11", duck_with("msgs_dirty") +
       "SELECT msg_id, NULLIF(uid, '') AS uid, NULLIF(content, '') AS content, NULLIF(sentiment, '') AS sentiment FROM msgs_dirty")
def sink_pipe_csv(spark, sf_dir):
    path = scratch(spark, "s11")
    K.write_pipe(Fixtures(spark, sf_dir).msgs_dirty, path)
    return R.read_pipe(spark, path, "msg_id long, uid string, content string, sentiment string")


@query("scan_emotion_csv", "S02", duck_with("emotions_wide") + "SELECT * FROM emotions_wide")
def scan_emotion_csv(spark, sf_dir):
    path = scratch(spark, "s02")
    K.write_pipe(Fixtures(spark, sf_dir).emotions_wide, path, sep=",")
    return R.read_emotion_csv(spark, path)


@query("scan_named_fields", "S03", duck_with("msgs") + "SELECT CAST(msg_id AS VARCHAR) AS msg_id, uid, content, sentiment FROM msgs")
def scan_named_fields(spark, sf_dir):
    path = scratch(spark, "s03")
    m = Fixtures(spark, sf_dir).msgs
    wide = m.select(F.col("msg_id").alias("a"), F.col("uid").alias("b"), F.col("content").alias("c"),
                    F.col("sentiment").alias("d"), F.lit("extra field").alias("e"))
    K.write_pipe(wide, path)
    return R.read_named_fields(spark, path, ["msg_id", "uid", "content", "sentiment"])


@query("check_header", "S04")
def check_header(spark, sf_dir):
    path = scratch(spark, "s04")
    K.write_pipe(Fixtures(spark, sf_dir).msgs.select("uid", "content", "sentiment"), path)
    good = R.check_header(spark, path, ["uid", "content", "sentiment"]).withColumn("expected", F.lit("uid|content|sentiment"))
    bad = R.check_header(spark, path, ["uid", "timestamp", "content"]).withColumn("expected", F.lit("uid|timestamp|content"))
    return good.unionByName(bad)


@query("scan_skip_bad", "S05", "SELECT event_id, value FROM events WHERE event_id % 10 <> 9")
def scan_skip_bad(spark, sf_dir):
    path = scratch(spark, "s05")
    ev = Fixtures(spark, sf_dir).events
    bad = F.when(F.col("event_id") % 10 == 9, F.lit("not-a-number")).otherwise(F.col("value").cast("string"))
    K.write_pipe(ev.select("event_id", bad.alias("value")), path, sep=",")
    return R.read_skip_bad(spark, path, "event_id long, value double")


@query("scan_rejects", "S05", "SELECT CAST(event_id AS VARCHAR) || ',not-a-number' AS record FROM events WHERE event_id % 10 = 9")
def scan_rejects(spark, sf_dir):
    """The raw text of the rows that scan_skip_bad drops."""
    path = scratch(spark, "s05r")
    ev = Fixtures(spark, sf_dir).events
    bad = F.when(F.col("event_id") % 10 == 9, F.lit("not-a-number")).otherwise(F.col("value").cast("string"))
    K.write_pipe(ev.select("event_id", bad.alias("value")), path, sep=",")
    return R.read_rejects(spark, path, "event_id long, value double")


@query("scan_pruned", "S06", duck_with("msgs") + "SELECT uid, content, sentiment FROM msgs")
def scan_pruned(spark, sf_dir):
    return Fixtures(spark, sf_dir).msgs.select("uid", "content", "sentiment")


_A = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}):: .+/(.+?): (.+)"
_B = r"^(\d{4}-\d{2}-\d{2}" + D.WS + r"\d{2}:\d{2}:\d{2})" + D.WS + "::" + D.WS + r"([\p{L}\p{N}_#]+):" + D.WS + r"(.+)$"


@query("parse_chat_log", "S07", duck_with("log_lines") + f"""
SELECT event_id,
  CASE WHEN regexp_matches(line, {D.q(_A)}) THEN regexp_extract(line, {D.q(_A)}, 2) ELSE regexp_extract(line, {D.q(_B)}, 2) END AS uid,
  CASE WHEN regexp_matches(line, {D.q(_A)}) THEN regexp_extract(line, {D.q(_A)}, 1) ELSE regexp_extract(line, {D.q(_B)}, 1) END AS timestamp,
  CASE WHEN regexp_matches(line, {D.q(_A)}) THEN regexp_extract(line, {D.q(_A)}, 3) ELSE regexp_extract(line, {D.q(_B)}, 3) END AS content
FROM log_lines WHERE (regexp_matches(line, {D.q(_A)}) OR regexp_matches(line, {D.q(_B)}))
  AND NOT contains(CASE WHEN regexp_matches(line, {D.q(_A)}) THEN regexp_extract(line, {D.q(_A)}, 2) ELSE regexp_extract(line, {D.q(_B)}, 2) END, 'HelperBot#0000')""")
def parse_chat_log(spark, sf_dir):
    return R.parse_chat_log(Fixtures(spark, sf_dir).log_lines, bots=["HelperBot#0000"])


_DAT_LINE = ("CAST(ts AS VARCHAR) || ' :: user' || CAST(user_id AS VARCHAR) || ': ' || event_type || ': k=' || CAST(event_id AS VARCHAR)")


@query("parse_dat_log", "S08", f"""
SELECT event_id, string_split(string_split(line, ' :: ')[2], ': ')[1] AS uid, string_split(line, ' :: ')[1] AS timestamp,
  string_split(string_split(line, ' :: ')[2], ': ')[2] AS content
FROM (SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'garbage' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' :: user' || CAST(user_id AS VARCHAR) || ': ' || event_type || ': k=' || CAST(event_id AS VARCHAR) END AS line FROM events)""")
def parse_dat_log(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).events
    line = F.when(F.col("event_id") % 10 == 9, F.lit("garbage")).otherwise(F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" :: user"), F.col("user_id").cast("string"), F.lit(": "),
        F.col("event_type"), F.lit(": k="), F.col("event_id").cast("string")))
    return R.parse_dat_log(ev.select("event_id", line.alias("line")))


@query("split_first_commas", "S09", """
SELECT event_id, p[1] AS uid, p[2] AS timestamp, array_to_string(p[3:], ',') AS content FROM (
  SELECT event_id, string_split('user' || CAST(user_id AS VARCHAR) || ',' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || event_type
    || ', k=' || CAST(event_id AS VARCHAR) || ', v=' || props, ',') AS p FROM events)""")
def split_first_commas(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).events
    line = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(","), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                    F.lit(","), F.col("event_type"), F.lit(", k="), F.col("event_id").cast("string"), F.lit(", v="), F.col("props"))
    return R.split_first_commas(ev.select("event_id", line.alias("line")))


@query("sink_splits", "S12", duck_with("msgs") + """
, r AS (SELECT msg_id, row_number() OVER (ORDER BY md5(CAST(msg_id AS VARCHAR) || '69'), msg_id) - 1 AS idx, count(*) OVER () AS n FROM msgs),
s AS (SELECT *, CAST(floor(n * 0.75) AS BIGINT) AS nt FROM r),
t AS (SELECT *, CAST(floor((n - nt) * (0.1 / (1 - (0.75 + 0.1)))) AS BIGINT) AS nv FROM s)
SELECT CASE WHEN idx < nt THEN 'train' WHEN idx < nt + nv THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM t GROUP BY 1""")
def sink_splits(spark, sf_dir):
    path = scratch(spark, "s12")
    K.write_splits(S.split_exact(Fixtures(spark, sf_dir).msgs.select("msg_id", "uid")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("feature_store", "S13", duck_user_features(FT.VECTOR_FEATURES))
def feature_store(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    path = scratch(spark, "s13")
    K.write_feature_store(FT.user_features(fx.msgs, pos_lexicon=fx.pos_lexicon), path)
    return K.read_feature_store(spark, path)


def _verdict_sql() -> str:
    from .metrics_q import VERDICT_SQL
    return VERDICT_SQL


@query("sink_report", "S14", _verdict_sql())
def sink_report(spark, sf_dir):
    """The verdict table written as JSON lines and read back."""
    from .metrics_q import verdict
    path = scratch(spark, "s14")
    v = verdict(spark, sf_dir)
    K.write_report(v, path)
    return spark.read.schema(v.schema).json(path)


@query("save_model", "S15")
def save_model(spark, sf_dir):
    from ..operators import models as MD
    from .models_q import fit_sentiment
    model, d = fit_sentiment(spark, sf_dir, False)
    path = scratch(spark, "s15")
    K.save_model(model, path)
    loaded = K.load_model(path)
    return MD.batch_predict(loaded, d.filter("split = 'test'")).select("msg_id", "pred", "label")


@query("overlength_side_output", "S16", duck_with("msgs") +
       f"SELECT msg_id, len({D.tokens('content')}) > 512 AS truncated, "
       f"array_to_string({D.tokens('content')}[1:512], ' ') AS content FROM msgs")
def overlength_side_output(spark, sf_dir):
    m = Fixtures(spark, sf_dir).msgs.select("msg_id", "content")
    return K.overlength_side_output(m, scratch(spark, "s16-side"), 512)

