"""Derived test relations built from the driver tables.

Each relation is one SQL template. ``{name}`` placeholders are table
references: in Spark they are bound to DataFrames through
``spark.sql(text, name=df)`` (no global temp views), for DuckDB they become
CTE names. Literal braces are doubled. Where the two dialects differ, the
relation has a Spark text and a DuckDB text.

Every relation derives from the given tables, so its size grows with them;
value rules use modular arithmetic on ids to plant markers, never to drop
rows. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.lexicons import EMOTION_TO_SENTIMENT, EMOTIONS
from .tables import TABLES, read_table


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


_MSGS = """
SELECT d.doc_id AS msg_id, d.lang || '-' || d.source AS uid,
  d.text
  || CASE WHEN d.doc_id % 3 = 0 THEN ' see http://ex.org/p?q=' || CAST(d.doc_id AS STRING) || ' ok.' ELSE '' END
  || CASE WHEN d.doc_id % 4 = 0 THEN ' fun :) <3' ELSE '' END
  || CASE WHEN d.doc_id % 5 = 0 THEN ' 😀😀 🚀' ELSE '' END
  || CASE WHEN d.doc_id % 6 = 0 THEN ' <a:wave:12345> <@!987>' ELSE '' END
  || CASE WHEN d.doc_id % 7 = 0 THEN ' ```x = 1``` #tag' ELSE '' END
  || CASE WHEN d.doc_id % 8 = 0 THEN ' NATO McKay' ELSE '' END AS content,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'neg' WHEN l.quality = 1 THEN 'pos' ELSE 'neu' END AS sentiment
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

_MSGS_DIRTY = """
SELECT msg_id,
  CASE WHEN msg_id % 13 = 0 THEN NULL ELSE uid END AS uid,
  CASE WHEN msg_id % 17 = 1 THEN NULL WHEN msg_id % 17 = 2 THEN '' WHEN msg_id % 17 = 3 THEN '   '
       WHEN msg_id % 17 = 4 THEN '😀' WHEN msg_id % 17 = 5 THEN 'nan'
       WHEN msg_id % 17 = 6 THEN 'http://ex.org/only' ELSE content END AS content,
  CASE WHEN msg_id % 19 = 0 THEN 'sentiment' ELSE sentiment END AS sentiment
FROM {msgs}
"""

_ALIAS = """
SELECT * FROM (VALUES ('en-src1','en-src0'), ('en-src2','en-src0'), ('fr-src3','fr-src0'), ('xx-none','en-src0')) AS t(uid, canonical)
"""

_EMOTION_MAP = (
    "SELECT * FROM (VALUES "
    + _values(list(EMOTION_TO_SENTIMENT.items()))
    + ") AS t(emotion, sentiment)"
)

_EMO_ARRAY = "array(" + ", ".join(f"'{e}'" for e in EMOTIONS) + ")"
_EMO_LIST = "[" + ", ".join(f"'{e}'" for e in EMOTIONS) + "]"

# long form: emotion k of 28 is set when (doc_id*(k+1) + k*k) % 11 = 0
_EMOTIONS_SPARK = f"""
SELECT d.doc_id, e.k, e.emotion,
  CASE WHEN (d.doc_id * (e.k + 1) + e.k * e.k) % 11 = 0 THEN 1 ELSE 0 END AS flag
FROM {{documents}} d LATERAL VIEW posexplode({_EMO_ARRAY}) e AS k, emotion
"""
_EMOTIONS_DUCK = f"""
SELECT doc_id, k, list_extract({_EMO_LIST}, k + 1) AS emotion,
  CASE WHEN (doc_id * (k + 1) + k * k) % 11 = 0 THEN 1 ELSE 0 END AS flag
FROM (SELECT doc_id, CAST(unnest(range(28)) AS INTEGER) AS k FROM {{documents}})
"""


def _wide_emotion_cols() -> str:
    return ",\n  ".join(
        f"CASE WHEN (doc_id * {k + 1} + {k * k}) % 11 = 0 THEN 1 ELSE 0 END AS {e}"
        for k, e in enumerate(EMOTIONS)
    )


# wide form, like the public emotion CSV: text, id, example_very_unclear, 28 flags
_EMOTIONS_WIDE = f"""
SELECT text, doc_id AS id, CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS example_very_unclear,
  {_wide_emotion_cols()}
FROM {{documents}}
"""

_LOG_LINES_SPARK = """
SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'garbage line ' || CAST(event_id AS STRING)
  WHEN event_id % 2 = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') || ':: guild/' || u || ': ' || c
  ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') || ' :: ' || u || ': ' || c END AS line
FROM (SELECT event_id, ts, CASE WHEN user_id = 0 THEN 'HelperBot#0000' ELSE 'user' || CAST(user_id AS STRING) || '#0001' END AS u,
  event_type || ' happened, k=' || CAST(event_id AS STRING) AS c FROM {events})
"""
_LOG_LINES_DUCK = """
SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'garbage line ' || CAST(event_id AS STRING)
  WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ':: guild/' || u || ': ' || c
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' :: ' || u || ': ' || c END AS line
FROM (SELECT event_id, ts, CASE WHEN user_id = 0 THEN 'HelperBot#0000' ELSE 'user' || CAST(user_id AS STRING) || '#0001' END AS u,
  event_type || ' happened, k=' || CAST(event_id AS STRING) AS c FROM {events})
"""

_WORDS_SPARK = r"""
SELECT msg_id, uid, lower(w) AS word FROM {msgs} LATERAL VIEW explode(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+', 0)) x AS w
"""
_WORDS_DUCK = r"""
SELECT msg_id, uid, lower(w) AS word FROM (SELECT msg_id, uid, unnest(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+')) AS w FROM {msgs})
"""

_LEXICON = """
SELECT word, CAST((length(word) * 7) % 11 - 5 AS INT) AS weight FROM (SELECT DISTINCT word FROM {words} WHERE length(word) % 3 <> 0) t
"""

_POS_LEXICON = """
SELECT word, CASE length(word) % 4 WHEN 0 THEN 'NN' WHEN 1 THEN 'VB' WHEN 2 THEN 'JJ' ELSE 'RB' END AS tag
FROM (SELECT DISTINCT word FROM {words} WHERE length(word) % 5 <> 0) t
"""

# five labelers vote on every 510-character chunk of every message
_VOTE_LABEL = """CASE WHEN labeler IN (0, 1, 4)
    THEN CASE (msg_id * 7 + labeler * 3 + chunk_id) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END
    ELSE CASE (msg_id * 5 + labeler + chunk_id) % 3 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' ELSE 'neu' END END AS label"""
_VOTES_SPARK = f"""
SELECT msg_id, chunk_id, labeler, {_VOTE_LABEL}
FROM {{msgs}}
LATERAL VIEW explode(sequence(0, CAST(greatest(length(content) - 1, 0) div 510 AS INT))) c AS chunk_id
LATERAL VIEW explode(sequence(0, 4)) v AS labeler
"""
_VOTES_DUCK = f"""
SELECT msg_id, chunk_id, labeler, {_VOTE_LABEL}
FROM (SELECT msg_id, chunk_id, CAST(unnest(range(5)) AS INTEGER) AS labeler
      FROM (SELECT msg_id, CAST(unnest(range(greatest(length(content) - 1, 0) // 510 + 1)) AS INTEGER) AS chunk_id FROM {{msgs}}))
"""

_PREDS_SPARK = """
SELECT vec_id AS msg_id, label % 3 AS y_true,
  CAST(round(element_at(embedding, 1) * 1000) AS INT) AS a0, CAST(round(element_at(embedding, 2) * 1000) AS INT) AS a1, CAST(round(element_at(embedding, 3) * 1000) AS INT) AS a2,
  CAST(round(element_at(embedding, 4) * 1000) AS INT) AS b0, CAST(round(element_at(embedding, 5) * 1000) AS INT) AS b1, CAST(round(element_at(embedding, 6) * 1000) AS INT) AS b2
FROM {embeddings}
"""
_PREDS_DUCK = """
SELECT vec_id AS msg_id, label % 3 AS y_true,
  CAST(round(list_extract(embedding, 1) * 1000) AS INT) AS a0, CAST(round(list_extract(embedding, 2) * 1000) AS INT) AS a1, CAST(round(list_extract(embedding, 3) * 1000) AS INT) AS a2,
  CAST(round(list_extract(embedding, 4) * 1000) AS INT) AS b0, CAST(round(list_extract(embedding, 5) * 1000) AS INT) AS b1, CAST(round(list_extract(embedding, 6) * 1000) AS INT) AS b2
FROM {embeddings}
"""

_TOPIC_WEIGHTS_SPARK = """
SELECT msg_id, uid, topic, CAST((msg_id * 31 + topic * 17) % 101 AS INT) AS w
FROM {msgs} LATERAL VIEW explode(sequence(0, 7)) t AS topic
"""
_TOPIC_WEIGHTS_DUCK = """
SELECT msg_id, uid, topic, CAST((msg_id * 31 + topic * 17) % 101 AS INT) AS w
FROM (SELECT msg_id, uid, CAST(unnest(range(8)) AS INTEGER) AS topic FROM {msgs})
"""

# name -> (dependencies, spark text, duckdb text)
RELATIONS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "msgs": (("documents", "labels"), _MSGS, _MSGS),
    "msgs_dirty": (("msgs",), _MSGS_DIRTY, _MSGS_DIRTY),
    "alias": ((), _ALIAS, _ALIAS),
    "emotion_map": ((), _EMOTION_MAP, _EMOTION_MAP),
    "emotions": (("documents",), _EMOTIONS_SPARK, _EMOTIONS_DUCK),
    "emotions_wide": (("documents",), _EMOTIONS_WIDE, _EMOTIONS_WIDE),
    "log_lines": (("events",), _LOG_LINES_SPARK, _LOG_LINES_DUCK),
    "words": (("msgs",), _WORDS_SPARK, _WORDS_DUCK),
    "lexicon": (("words",), _LEXICON, _LEXICON),
    "pos_lexicon": (("words",), _POS_LEXICON, _POS_LEXICON),
    "votes": (("msgs",), _VOTES_SPARK, _VOTES_DUCK),
    "preds": (("embeddings",), _PREDS_SPARK, _PREDS_DUCK),
    "topic_weights": (("msgs",), _TOPIC_WEIGHTS_SPARK, _TOPIC_WEIGHTS_DUCK),
}


class Fixtures:
    """Lazily built Spark DataFrames of the driver tables and relations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name in self._cache:
            return self._cache[name]
        if name in TABLES:
            df = read_table(self.spark, self.sf_dir, name)
        elif name in RELATIONS:
            deps, text, _ = RELATIONS[name]
            df = self.spark.sql(text, **{d: self.get(d) for d in deps})
        else:
            raise KeyError(name)
        self._cache[name] = df
        return df


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the named relations (and their dependencies)
    for DuckDB, in dependency order. Driver tables are already views."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in order:
            return
        for d in RELATIONS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return ""
    parts = []
    for n in order:
        deps, _, text = RELATIONS[n]
        parts.append(f"{n} AS ({text.format(**{d: d for d in deps}).strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
