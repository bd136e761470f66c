"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is due an expected number of copies: its size
class's weight times a factor chosen so that the source's words come to its
target, at most ``limit``. The whole part of that number is taken for certain.
For the rest, an inclusion probability below 1, documents are ranked by their
random odds divided by their inclusion odds, and the head of that order is
taken up to the words the source still lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import global_index
from .common import WORD, materialize, numbered

#: equal parts of the unit interval into which a source's order is cut; only
#: the part that holds the cut is ranked row by row
PARTS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) fixed by the values of ``parts`` (52 bits of MD5)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights: list[float], share: float, limit: float) -> DataFrame:
    """(source, source_size, target): sources by code point, nulls last, weigh
    ``weights`` in turn and divide ``share`` times all words; a target stops at
    ``limit`` times its source's words and the others share the excess by
    weight. ``sizes`` holds one row per source."""
    keyed = sizes.select("source", "source_size", F.col("source").isNull().alias("last"))
    ranked = global_index(keyed, ["last", "source"], "rank")
    k = len(weights)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = materialize(ranked.select(
        "source", "source_size", (limit * F.col("source_size")).alias("top"),
        F.element_at(cycle, (F.col("rank") % k + 1).cast("int")).alias("w")), "mix-sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    # the rate: words per unit of weight. It only rises from round to round;
    # a round's answer is two sums over the sources
    rate, full = None, F.lit(False)
    while True:
        free = t.agg(F.sum(F.when(full, F.col("top")).otherwise(F.lit(0.0))).alias("given"),
                     F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("w"))).alias("w"),
                     F.count(F.when(full, 1)).alias("n")).first()
        if not free.w:
            break
        rate = (share * total - (free.given or 0.0)) / free.w
        full = F.col("top") <= F.lit(rate) * F.col("w")
        if t.filter(full).count() == free.n:
            break
    target = F.col("top") if rate is None else F.least(F.col("top"), F.lit(rate) * F.col("w"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def pareto_mix(docs: DataFrame, weights: list[float], share: float = 1.5, limit: float = 2.0,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               seed: int = 20) -> DataFrame:
    """One row per row of ``docs``: id, size (words), source_size, target,
    expected (copies due), copies (whole copies taken, 0 to ``limit``), taken
    (words taken) and row_key (the row's number in the scan).

    Longer documents are due more copies: the weight of a document is the bit
    length of its size. A null text has size 0 and is never taken; a null
    source is a source of its own; rows that repeat are separate documents
    with the same random number, so ties are cut by the row's number. An empty
    table gives no rows. The random number depends on id and text alone, so
    reruns agree. A source's words differ from its target by at most half a
    document. Other columns are ignored."""
    sized = materialize(numbered(
        docs, id=F.col(id_col), source=F.col(source_col), size=word_count(F.col(text_col)),
        u=uniform(F.lit(seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))),
    ).withColumn("class", F.length(F.bin("size")) * (F.col("size") > 0).cast("int")), "mix-sized")
    classes = materialize(sized.groupBy("source", "class").agg(F.sum("size").alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)

    # copies due: least(limit, factor * class) with one factor per source such
    # that the words come to the target; at most 64 classes per source
    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    c = classes.alias("c").join(targets.alias("t"), same).select(
        F.col("t.source").alias("source"), "class", "words", "source_size", "target")
    above = Window.partitionBy("source").orderBy(F.col("class").desc())
    below = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    c = (c.withColumn("above", F.sum("words").over(above))
         .withColumn("below", F.coalesce(F.sum(F.col("class") * F.col("words")).over(below), F.lit(0)))
         .withColumn("full", (F.col("class") > 0)
                     & (limit * F.col("above") + F.try_divide(F.lit(limit), F.col("class")) * F.col("below")
                        <= F.col("target"))))
    per = Window.partitionBy("source")
    c = (c.withColumn("factor", F.try_divide(
            F.col("target") - limit * F.sum(F.when(F.col("full"), F.col("words")).otherwise(0)).over(per),
            F.sum(F.when(F.col("full"), 0).otherwise(F.col("class") * F.col("words"))).over(per).cast("double")))
         .withColumn("expected", F.when(F.col("full"), F.lit(float(limit)))
                     .otherwise(F.greatest(F.lit(0.0), F.coalesce(F.col("factor") * F.col("class"), F.lit(0.0)))))
         .withColumn("whole", F.floor("expected"))
         .withColumn("lack", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(per))
         .select("source", "class", "source_size", "target", "expected", "whole", "lack"))
    c = materialize(c, "mix-due")

    # odds of the random number over odds of inclusion, mapped to (0, 1)
    share_of = F.col("expected") - F.col("whole")
    odds = F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(share_of, 1 - share_of))
    place = F.when(share_of > 0, odds / (1 + odds))
    a, b = sized.alias("a"), c.alias("b")
    due = materialize(
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.class") == F.col("b.class")))
        .select("row_key", "id", F.col("b.source").alias("source"), "size", "source_size", "target", "expected", "whole",
                "lack", place.alias("place"))
        .withColumn("part", F.floor(F.col("place") * PARTS).cast("int")), "mix-due-rows")
    parts = due.filter("place is not null").groupBy("source", "part").agg(
        F.sum("size").alias("words"), F.first("lack").alias("lack"))
    run = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("upto", F.sum("words").over(run))
    cut = materialize(parts.groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("lack"), F.col("part"))).alias("last_full"),
        F.min(F.when(F.col("upto") > F.col("lack"), F.col("part"))).alias("cut_part"),
        F.max(F.when(F.col("upto") <= F.col("lack"), F.col("upto"))).alias("before")), "mix-cut")
    d = due.alias("d").join(cut.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")), "left") \
        .select("d.*", "cut_part", F.coalesce("before", F.lit(0)).alias("before"))
    at_cut = d.filter(F.col("part") == F.col("cut_part"))
    order = Window.partitionBy("source").orderBy("place", "id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = at_cut.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))) \
        .withColumn("extra", (F.col("ahead") + F.col("size") / 2 <= F.col("lack")).cast("int")).drop("ahead")
    others = d.filter(F.col("part").isNull() | F.col("cut_part").isNull() | (F.col("part") != F.col("cut_part"))) \
        .withColumn("extra", (F.col("part").isNotNull() & (F.col("cut_part").isNull() | (F.col("part") < F.col("cut_part"))))
                    .cast("int"))
    return others.unionByName(at_cut).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        ((F.col("whole") + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("int").alias("copies"),
        "expected", "row_key")
