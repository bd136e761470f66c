"""Readers for the reference's file formats (S01-S09): pipe CSV, the wide
emotion CSV, positional fields, malformed-row handling and raw chat logs.
Every read takes an explicit schema; no inference. CSV files are read by
many tasks each, also where quoted fields hold line ends (records.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..functions.lexicons import EMOTIONS
from .records import read_records, without_headers

MESSAGES = T_.StructType([T_.StructField("uid", T_.StringType()), T_.StructField("timestamp", T_.StringType()),
                          T_.StructField("content", T_.StringType())])
LABELLED = T_.StructType([T_.StructField("uid", T_.StringType()), T_.StructField("content", T_.StringType()),
                          T_.StructField("sentiment", T_.StringType())])
EMOTION_TABLE = T_.StructType(
    [T_.StructField("text", T_.StringType()), T_.StructField("id", T_.LongType()),
     T_.StructField("example_very_unclear", T_.IntegerType())]
    + [T_.StructField(e, T_.IntegerType()) for e in EMOTIONS])

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _parsed(spark: SparkSession, path: str, schema: T_.StructType | str, sep: str, **options: str) -> DataFrame:
    """Records besides each file's first, parsed by position."""
    fields = schema if isinstance(schema, T_.StructType) else T_.StructType.fromDDL(schema)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    records = without_headers(read_records(spark, path, sep))
    return records.select(F.from_csv("record", ddl, CSV_OPTIONS | {"sep": sep} | options).alias("_row")).select("_row.*")


def read_pipe(spark: SparkSession, path: str, schema: T_.StructType | str = LABELLED, sep: str = "|") -> DataFrame:
    """Pipe-delimited CSV with header; quoted fields may hold the
    separator, quotes (doubled) and newlines."""
    return _parsed(spark, path, schema, sep)


def read_emotion_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma CSV with text, id, example_very_unclear and 28 flags."""
    return _parsed(spark, path, EMOTION_TABLE, ",")


def read_named_fields(spark: SparkSession, path: str, names: list[str], sep: str = "|") -> DataFrame:
    """The header line is skipped, fields are named by position by the
    caller; extra fields of a row are cut (PERMISSIVE), missing ones NULL."""
    schema = T_.StructType([T_.StructField(n, T_.StringType()) for n in names])
    return _parsed(spark, path, schema, sep)


def check_header(spark: SparkSession, path: str, expected: list[str], sep: str = "|") -> DataFrame:
    """Per file of ``path`` one row (header, ok) -- ``ok`` is false when
    its first line differs from ``expected`` in any field, also one too many.
    Reads the first split of each file only, whose first line is taken by its
    place in the scan."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    return first.select("header", (F.col("header") == F.lit(sep.join(expected))).alias("ok"))


def read_skip_bad(spark: SparkSession, path: str, schema: T_.StructType | str, sep: str = ",") -> DataFrame:
    """Malformed rows (wrong field count or type) are dropped, whatever
    columns the caller selects."""
    return _with_corrupt(spark, path, schema, sep).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_rejects(spark: SparkSession, path: str, schema: T_.StructType | str, sep: str = ",") -> DataFrame:
    """The raw text (column ``record``) of the rows that
    ``read_skip_bad`` drops."""
    return _with_corrupt(spark, path, schema, sep).filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))


CORRUPT = "_corrupt_record"


def _with_corrupt(spark: SparkSession, path: str, schema: T_.StructType | str, sep: str) -> DataFrame:
    fields = schema if isinstance(schema, T_.StructType) else T_.StructType.fromDDL(schema)
    return _parsed(spark, path, T_.StructType([*fields, T_.StructField(CORRUPT, T_.StringType())]), sep,
                   columnNameOfCorruptRecord=CORRUPT)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw text lines (column ``value``)."""
    return spark.read.text(path)


# --- Fixed values: the two chat-log line forms ------------------------------
# form A: "YYYY-MM-DD HH:MM:SS.ffffff:: <path>/<author>: <content>"
LOG_FORM_A = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}):: .+/(.+?): (.+)"
# form B: "YYYY-MM-DD HH:MM:SS :: <author>: <content>", author of [\w#]+
LOG_FORM_B = (r"^(\d{4}-\d{2}-\d{2}" + T.SPACE_CHAR + r"\d{2}:\d{2}:\d{2})" + T.SPACE_CHAR + "::" + T.SPACE_CHAR
              + r"([\p{L}\p{N}_#]+):" + T.SPACE_CHAR + r"(.+)$")
# --- end of fixed values ------------------------------------------------------


def parse_chat_log(lines: DataFrame, bots: list[str] = (), col: str = "line") -> DataFrame:
    """Two line forms tried in order; unmatched lines and lines by the
    listed bot authors are dropped -> (uid, timestamp, content)."""
    v = F.col(col)
    a, b = v.rlike(LOG_FORM_A), v.rlike(LOG_FORM_B)
    pick = lambda i: F.when(a, F.regexp_extract(v, LOG_FORM_A, i)).when(b, F.regexp_extract(v, LOG_FORM_B, i))
    out = lines.select(*[c for c in lines.columns if c != col], pick(2).alias("uid"), pick(1).alias("timestamp"),
                       pick(3).alias("content")).filter(F.col("uid").isNotNull())
    for bot in bots:
        out = out.filter(~F.col("uid").contains(bot))
    return out


def parse_dat_log(lines: DataFrame, col: str = "line") -> DataFrame:
    """``ts :: uid: content``; the content is cut at the next ': '
    (only the second piece is kept); lines without the parts give NULLs."""
    parts = F.split(T.py_strip(F.col(col)), " :: ")
    rest = F.split(F.get(parts, 1), ": ")
    return lines.select(*[c for c in lines.columns if c != col], F.get(rest, 0).alias("uid"),
                        F.get(parts, 0).alias("timestamp"), F.get(rest, 1).alias("content"))


def split_first_commas(lines: DataFrame, col: str = "line") -> DataFrame:
    """First two comma fields; the remainder (commas kept) is content."""
    p = F.split(T.py_strip(F.col(col)), ",", 3)
    return lines.select(*[c for c in lines.columns if c != col], F.get(p, 0).alias("uid"),
                        F.get(p, 1).alias("timestamp"), F.get(p, 2).alias("content"))
