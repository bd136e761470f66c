"""Order-dependent building blocks that stay distributed.

- :func:`top_k_per_group`: row_number top-k; with ``salt_buckets`` it ranks
  inside (group, salt) first, so no task sorts a whole hot group.
- :func:`global_index`: exact 0-based position of every row in a total
  order (a distributed zipWithIndex): range partition + per-partition
  counts; the offsets table has one row per partition (size bound = the
  partition count), so broadcasting it is safe.
- :func:`prefix_sums`: exact running totals over a total order, same scheme.

Both index helpers checkpoint the range-partitioned data to the shared
checkpoint folder, so recomputation after an executor loss cannot change
partition boundaries between the two passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _order_cols(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column | str], k: int,
                    rank_col: str | None = None, salt_buckets: int = 0) -> DataFrame:
    """Top ``k`` rows per group by ``order`` (must be a total order for
    deterministic results)."""
    oc = _order_cols(order)
    cur = df
    if salt_buckets and salt_buckets > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
        w1 = Window.partitionBy(*group, "_salt").orderBy(*oc)
        cur = (cur.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
               .filter(F.col("_r1") <= k).drop("_salt", "_r1"))
    w = Window.partitionBy(*group).orderBy(*oc)
    rc = rank_col or "_rank"
    out = cur.withColumn(rc, F.row_number().over(w)).filter(F.col(rc) <= k)
    return out if rank_col else out.drop(rc)


def _range_tagged(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    return cut_lineage(tagged)


def global_index(df: DataFrame, order: list[str], index_col: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the order of ``order`` (unique)."""
    t = _range_tagged(df, order, partitions)
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    counts = t.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (t.join(F.broadcast(offsets), "_pid")
            .withColumn(index_col, F.col("_off") + local)
            .drop("_pid", "_mid", "_off"))


def prefix_sums(df: DataFrame, order: list[str], cols: list[str], suffix: str = "_before",
                partitions: int | None = None) -> DataFrame:
    """For each row, the sums of ``cols`` over all rows strictly before it
    in the order of ``order`` (unique)."""
    t = _range_tagged(df, order, partitions)
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = t.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_l_{c}") for c in cols])
    totals = t.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in cols])
    out = local.join(F.broadcast(offsets), "_pid")
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_o_{c}") + F.col(f"_l_{c}"))
    return out.drop("_pid", "_mid", *[f"_l_{c}" for c in cols], *[f"_o_{c}" for c in cols])
