"""Exact dedup by distributed MSD radix partitioning.

Texts are compared by their bytes alone. A round takes the next digit (a run
of bytes, wider in each round) of every text that still has company and splits
each group by it. A group that is down to one text is settled; a group whose
texts have all ended is a group of equal texts. Only texts that share all
bytes so far are read again, so most texts are settled by the first digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, attach_facts, materialize, numbered

FIRST_DIGIT = 64
GROWTH = 8


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def radix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256
    and row_key (the row's number in the scan, unique).

    Of equal texts the row with the most code points in the original text
    stays, then the smallest id (null ids last); of rows that repeat both, one
    stays. A null text counts as empty, all texts without words form one
    group; an empty table gives an empty result. Other columns are ignored, so
    their names cannot clash."""
    scan = numbered(docs, id=F.col(id_col), text=F.col(text_col))
    head = materialize(scan.select(
        "row_key", "id",
        F.char_length(F.coalesce("text", F.lit(""))).alias("chars"),
        F.encode(normalised(F.col("text")), "UTF-8").alias("bytes"),
    ).select("row_key", "id", "chars", F.sha2("bytes", 256).alias("text_sha256"),
             F.lit(0).cast("long").alias("gid"),
             F.substring("bytes", 1, first_digit).alias("digit"),
             (F.octet_length("bytes") <= first_digit).alias("ended")), "radix-head")
    total = head.count()
    settled: list[DataFrame] = []
    ended: list[DataFrame] = []
    rows, width, done = head, first_digit, first_digit
    while True:
        groups = materialize(
            rows.groupBy("gid", "digit", "ended").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .withColumn("next_gid", F.monotonically_increasing_id()), "radix-groups")
        step = attach_facts(rows, groups, ["gid", "digit", "ended"], "n", total).select(
            *[c for c in rows.columns if c not in ("gid", "digit")], F.col("next_gid").alias("gid"))
        if "rest" in rows.columns:
            step = materialize(step, "radix-step")
        else:
            step = materialize(step, "radix-step0")
        settled.append(step.filter("gid is null").select("row_key", "id", "chars", "text_sha256"))
        ended.append(step.filter("gid is not null and ended")
                     .select("row_key", "id", "chars", "text_sha256", "gid", F.lit(len(ended)).alias("round")))
        alive = step.filter("gid is not null and not ended")
        if alive.isEmpty():
            break
        if "rest" not in rows.columns:
            # only now, and only for texts that share their first digit, the rest of the bytes
            rest = scan.select("row_key", F.encode(normalised(F.col("text")), "UTF-8").alias("bytes")) \
                .select("row_key", F.expr(f"substring(bytes, {done + 1})").alias("rest"))
            alive = alive.drop("ended").join(rest, "row_key")
        else:
            alive = alive.drop("ended").withColumn("rest", F.expr(f"substring(rest, {width + 1})"))
        width *= growth
        rows = materialize(alive.withColumn("digit", F.substring("rest", 1, width))
                           .withColumn("ended", F.octet_length("rest") <= width), "radix-rows")
    equal = materialize(_union(ended), "radix-equal")
    best = materialize(
        equal.groupBy("round", "gid").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), "id", "row_key")).alias("best"))
        .select("round", "gid", "n", F.col("best.id").alias("keep_id"), F.col("best.row_key").alias("keep_key")),
        "radix-best")
    grouped = attach_facts(equal, best, ["round", "gid"], "n", total).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
        (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256", "row_key")
    alone = _union(settled).select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "row_key")
    return alone.unionByName(grouped)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
