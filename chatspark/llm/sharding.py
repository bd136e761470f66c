"""Sharding along a Hilbert curve over several metadata columns.

Language and source are quantised to equal-depth steps in value order, the
size to steps of its logarithm. Rows are ordered by the curve index of the
steps and the order is cut into runs, so the files of a shard hold a small
range of every column at once and minimum/maximum pruning works on each.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import global_index
from .common import let, materialize

BITS = 5


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with ``bits`` bits per axis
    (Skilling's transform, as a fold over arrays)."""
    n = len(axes)
    point = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << q).cast("long").alias("q"), F.lit(i).alias("i"))
                      for q in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        head, own = F.element_at(x, 1), F.element_at(x, s["i"] + 1)
        low = s["q"] - 1
        is_set = own.bitwiseAND(s["q"]) != 0
        swap = F.when(is_set, F.lit(0).cast("long")).otherwise(head.bitwiseXOR(own).bitwiseAND(low))
        flip = F.when(is_set, low).otherwise(F.lit(0).cast("long"))
        return F.transform(x, lambda v, j:
                           F.when((j == 0) & (s["i"] == 0), v.bitwiseXOR(flip))
                           .when(j == 0, v.bitwiseXOR(flip).bitwiseXOR(swap))
                           .when(j == s["i"], v.bitwiseXOR(swap)).otherwise(v))

    def gray(x: Column) -> Column:
        chain = [F.element_at(x, 1)]
        for i in range(1, n):
            chain.append(reduce(lambda a, b: a.bitwiseXOR(b), [F.element_at(x, k + 1) for k in range(i + 1)]))
        return F.array(*chain)

    def undo(x: Column) -> Column:
        last = F.element_at(x, n)
        terms = [F.when(last.bitwiseAND(F.lit(1 << q).cast("long")) != 0, F.lit((1 << q) - 1).cast("long"))
                 .otherwise(F.lit(0).cast("long")) for q in range(bits - 1, 0, -1)]
        t = reduce(lambda a, b: a.bitwiseXOR(b), terms, F.lit(0).cast("long"))
        return let(t, lambda m: F.transform(x, lambda v: v.bitwiseXOR(m)))

    def interleave(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for q in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(F.element_at(x, i + 1), q).bitwiseAND(F.lit(1).cast("long"))
                out = out + F.shiftleft(bit, q * n + (n - 1 - i))
        return out

    return let(let(F.aggregate(steps, point, turn), gray), lambda x: let(undo(x), interleave))


def _equal_depth(values: DataFrame, col: str, bits: int) -> DataFrame:
    """(col, step): the values in order, cut into 2**bits steps of about as
    many rows each; nulls first. ``values`` has one row per value and ``n``."""
    order = Window.orderBy("part")
    ranked = global_index(values.withColumn("has", F.col(col).isNotNull()), ["has", col], "rank")
    # running totals over blocks of values, then inside a block
    ranked = materialize(ranked.withColumn("part", F.floor(F.col("rank") / 4096)), "shard-values")
    blocks = ranked.groupBy("part").agg(F.sum("n").alias("rows"))
    total = ranked.agg(F.sum("n")).first()[0] or 1
    blocks = blocks.withColumn("ahead", F.sum("rows").over(order) - F.col("rows"))
    inside = Window.partitionBy("part").orderBy("rank")
    return ranked.join(blocks, "part").select(
        col, F.floor((F.col("ahead") + F.sum("n").over(inside) - F.col("n")) * (1 << bits) / F.lit(total))
        .cast("int").alias("step"))


def hilbert_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   dims: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: id, the columns ``dims``, size (UTF-8 bytes
    of the text plus 1), text_crc32, curve (index on the curve), position (the
    row's place in the order), shard and slot (place in the shard).

    Shards are runs of the order with counts at most one apart. Rows of one
    cell of the curve follow one another by text (CRC-32), then id. A null
    text has no bytes; null metadata values are values of their own, before
    all others; an empty table gives no rows; rows that repeat take places
    side by side. Other columns are ignored."""
    rows = docs.select(
        F.col(id_col).alias("id"), *[F.col(c).alias(f"d{i}") for i, c in enumerate(dims)],
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("text_crc32"))
    rows = materialize(rows, "shard-rows")
    names = [f"d{i}" for i in range(len(dims))]
    combos = materialize(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "shard-combos")
    cells = combos
    for d in names:
        steps = _equal_depth(combos.groupBy(d).agg(F.sum("n").alias("n")), d, bits).withColumnRenamed(d, "value") \
            .withColumnRenamed("step", f"{d}_step")
        cells = cells.join(steps, F.col(d).eqNullSafe(F.col("value")), "left").drop("value")
    cells = materialize(cells.drop("n"), "shard-cells")
    on = reduce(lambda a, b: a & b, [F.col(f"r.{d}").eqNullSafe(F.col(f"c.{d}")) for d in names])
    stepped = rows.alias("r").join(cells.alias("c"), on).select(
        "r.*", *[F.col(f"c.{d}_step") for d in names])
    # two steps of the size to each doubling, the last step open
    size_step = F.least(F.floor(F.log2(F.col("bytes") + 1) * 2), F.lit((1 << bits) - 1))
    placed = stepped.withColumn("curve", hilbert_index([*[F.col(f"{d}_step") for d in names], size_step], bits)) \
        .withColumn("has_id", F.col("id").isNotNull()).drop(*[f"{d}_step" for d in names])
    ordered = global_index(placed, ["curve", "text_crc32", "has_id", "id"], "position")
    total = rows.count()
    # shard k holds the positions from ceil(k * total / shards) on (integer division)
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    first = F.expr(f"((position * {shards}) div {max(total, 1)} * {total} + {shards - 1}) div {shards}")
    return ordered.select(
        F.col("id").alias(id_col), *[F.col(d).alias(c) for d, c in zip(names, dims)],
        (F.col("bytes") + 1).alias("size"), "text_crc32", "curve", "position",
        shard.cast("int").alias("shard"), (F.col("position") - first).alias("slot"))
