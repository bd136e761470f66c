"""Projections, filters and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LABELS = ("pos", "neg", "neu")


def drop_prefixed(df: DataFrame, prefix: str = "Unnamed") -> DataFrame:
    """Drop columns whose name starts with ``prefix``."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    """Set all column names by position; raises unless there are as many
    names as columns."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def rename_drop_if_present(df: DataFrame, rename: dict[str, str] | None = None,
                           drop: tuple[str, ...] = ("nan",)) -> DataFrame:
    """rename/drop, both no-ops when the column is absent."""
    for a, b in (rename or {"neu": "sentiment"}).items():
        df = df.withColumnRenamed(a, b)
    return df.drop(*drop)


def reject_column(df: DataFrame, name: str = "nan", order: str = "msg_id") -> None:
    """Raise if column ``name`` exists, naming its first non-null row."""
    if name in df.columns:
        first = df.filter(F.col(name).isNotNull()).orderBy(order).select(order).limit(1).collect()
        where = first[0][0] if first else None
        raise ValueError(f"{name} column found (first non-null at {order}={where})")


def filter_label_in(df: DataFrame, col: str = "sentiment", labels=LABELS) -> DataFrame:
    """P05."""
    return df.filter(F.col(col).isin(*labels))


def filter_min_len(df: DataFrame, n: int = 25, col: str = "content") -> DataFrame:
    """At least ``n`` code points; NULL fails."""
    return df.filter(F.length(col) >= n)


def filter_min_group(df: DataFrame, n: int = 25, key: str = "uid") -> DataFrame:
    """Keep rows of keys with at least ``n`` rows.

    The counts are a partial aggregate (one row per key); they join back
    as a broadcast when small, else AQE splits a hot key in the join."""
    from .joins import sized_broadcast
    keep = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(key)
    return df.join(sized_broadcast(keep), key, "left_semi")


def drop_nulls(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """``any`` / ``all`` / subset forms."""
    return df.na.drop(how=how, subset=subset)


def filter_blank(df: DataFrame, col: str = "content") -> DataFrame:
    """Drop text that is empty after Python-style strip (NULL dropped)."""
    return df.filter(T.py_strip(col) != "")


def filter_printable(df: DataFrame, col: str = "content") -> DataFrame:
    """P10: keep text with at least one printable ASCII character (Python's
    printable set, whitespace included) after strip."""
    return df.filter(T.py_strip(col).rlike("[ -~\\t\\n\\x0B\\f\\r]"))


def filter_uid_not_contains(df: DataFrame, needles: list[str], col: str = "uid") -> DataFrame:
    """Drop rows whose uid contains any needle (NULL uid kept out)."""
    cond = F.lit(True)
    for s in needles:
        cond = cond & ~F.col(col).contains(s)
    return df.filter(cond)


def filter_user(df: DataFrame, uid: str, col: str = "uid") -> DataFrame:
    """Pushed down to the scan as an equality filter."""
    return df.filter(F.col(col) == uid)


def null_to_nan_text(df: DataFrame, col: str = "content", compat: bool = True) -> DataFrame:
    """Pandas ``astype(str)`` turns NULL into the text ``nan``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("nan"))) if compat else df


def empty_to_null_drop(df: DataFrame, col: str = "content") -> DataFrame:
    """Exactly-empty text -> NULL -> dropped; whitespace-only stays."""
    return df.withColumn(col, F.nullif(F.col(col), F.lit(""))).na.drop(subset=[col])


def quality_checks(df: DataFrame) -> DataFrame:
    """One aggregate row of violation counts."""
    return df.agg(
        F.count_if(F.col("uid").isNull()).alias("missing_uid"),
        F.count_if(F.col("content").isNull()).alias("missing_content"),
        F.count_if(F.col("sentiment").isNull()).alias("missing_sentiment"),
        F.count_if(~F.col("sentiment").isin(*LABELS)).alias("bad_label"),
    )


def one_user_violations(df: DataFrame, group: str, uid: str = "uid") -> DataFrame:
    """(group, n_users, missing_uid) of the groups whose messages are
    not all of one user: two users or more, or rows without one beside others."""
    per = df.groupBy(group).agg(F.count_if(F.col(uid).isNull()).alias("missing_uid"), F.count_distinct(uid).alias("n_users"))
    return per.filter((F.col("n_users") > 1) | ((F.col("missing_uid") > 0) & (F.col("n_users") > 0))) \
        .select(group, "n_users", "missing_uid")


def drop_first_row(df: DataFrame, order: str = "msg_id") -> DataFrame:
    """P16 (compat): the row with the smallest key is lost. Found with a
    global min (partial aggregate), not a global row_number."""
    first = df.agg(F.min(order).alias("_first"))
    return df.join(F.broadcast(first), F.col(order) == F.col("_first"), "left_anti").drop("_first")


def truncate_words(df: DataFrame, n: int, col: str = "content") -> DataFrame:
    """P17."""
    return df.withColumn(col, T.truncate_words(col, n))


def dropped_rows_report(df: DataFrame, cols: tuple[str, ...] = ("content", "sentiment")) -> DataFrame:
    """Rows a NULL drop on ``cols`` would remove, and rows kept."""
    null_any = F.lit(False)
    for c in cols:
        null_any = null_any | F.col(c).isNull()
    return df.agg(F.count_if(null_any).alias("dropped"), F.count_if(~null_any).alias("kept"))


def chunk_text(df: DataFrame, col: str = "content", size: int = T.CHUNK_CHARS) -> DataFrame:
    """One row per ``size``-character piece, stripped, blanks dropped."""
    return (df.select(*[c for c in df.columns if c != col], F.posexplode(T.chunks(col, size)).alias("chunk_id", "chunk"))
            .withColumn("chunk", T.py_strip("chunk"))
            .filter(F.col("chunk") != ""))


def split_text_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Replace '. ' by a newline, one row per line."""
    return df.select(F.explode(F.split(F.replace(F.col(col), F.lit(". "), F.lit("\n")), "\n")).alias("line"))


def clean_messages(df: DataFrame, col: str = "content") -> DataFrame:
    """The cleaning chain: custom emoji, URLs, mentions removed; exactly
    empty results dropped (P14)."""
    out = df.withColumn(col, T.strip_patterns(col, [T.CUSTOM_EMOJI, T.LINK, T.MENTION]))
    return empty_to_null_drop(out, col)
