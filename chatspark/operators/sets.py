"""Set operations and dataset splits.

Splits never sort the whole table in one task:
- :func:`split_exact` ranks rows by a keyed hash with
  :func:`~chatspark.operators.ordered.global_index` (range partitions,
  per-partition counts), then applies exact floor() sizes;
- :func:`split_hash` maps each key to [0, 1) and compares thresholds
  (no ordering at all, the scale form).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import global_index


def union_datasets(*dfs: DataFrame) -> DataFrame:
    """Concatenate by column name; missing columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, col: str = "uid") -> DataFrame:
    """U04."""
    return df.select(col).distinct()


def shared_columns(a: DataFrame, b: DataFrame, minus: tuple[str, ...] = ()) -> list[str]:
    """U03 (driver-side, schema only)."""
    return sorted((set(a.columns) & set(b.columns)) - set(minus))


def shared_column_profile(a: DataFrame, b: DataFrame, minus: tuple[str, ...] = ()) -> DataFrame:
    """(column, n_left, n_right): the non-null values each shared column has
    in either table; one aggregate a table."""
    cols = shared_columns(a, b, minus)

    def counts(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias(name)) for c in cols])
        return df.agg(cells.alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")

    if not cols:
        return a.sparkSession.createDataFrame([], "column string, n_left long, n_right long")
    return counts(a, "n_left").join(counts(b, "n_right"), "column")


def hash_key(key: Column, seed: int) -> Column:
    """md5 of ``key || seed`` -- deterministic pseudo-random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def unit_hash(key: Column, seed: int) -> Column:
    """First 32 bits of the keyed md5 as a number in [0, 1)."""
    h = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(float(2 ** 32))


def split_sizes(n: int, train_ratio: float, val_ratio: float) -> tuple[int, int, int]:
    """Sizes of the two-step split: floor(n*train), then of the rest
    floor(rest * val/test) for validation."""
    test_ratio = 1 - (train_ratio + val_ratio)
    n_train = math.floor(n * train_ratio)
    rest = n - n_train
    n_val = math.floor(rest * (val_ratio / test_ratio))
    return n_train, n_val, rest - n_val


def split_test_size(df: DataFrame, test_size: float, key: str = "msg_id", seed: int = 69) -> DataFrame:
    """W07, two-way form: the test part has ceil(n * test_size) rows, the rest
    trains, in keyed-hash order. Adds ``split`` in {train, test}."""
    n = df.count()
    n_train = n - math.ceil(n * test_size)
    ranked = global_index(df.withColumn("_h", hash_key(F.col(key), seed)), ["_h", key], "_idx")
    return ranked.withColumn("split", F.when(F.col("_idx") < n_train, "train").otherwise("test")).drop("_h", "_idx")


def split_exact(df: DataFrame, key: str = "msg_id", train_ratio: float = 0.75, val_ratio: float = 0.1,
                seed: int = 69) -> DataFrame:
    """Exact sizes (e.g. 33,026 -> 24,769 / 5,504 / 2,753) in keyed-hash
    order. Adds ``split`` in {train, val, test}."""
    n = df.count()
    n_train, n_val, _ = split_sizes(n, train_ratio, val_ratio)
    ranked = global_index(df.withColumn("_h", hash_key(F.col(key), seed)), ["_h", key], "_idx")
    split = (F.when(F.col("_idx") < n_train, "train")
             .when(F.col("_idx") < n_train + n_val, "val").otherwise("test"))
    return ranked.withColumn("split", split).drop("_h", "_idx")


def split_hash(df: DataFrame, key: str = "msg_id", train_ratio: float = 0.75, val_ratio: float = 0.1,
               seed: int = 69) -> DataFrame:
    """Same shares as W07 in expectation, no ordering (scale form)."""
    test_ratio = 1 - (train_ratio + val_ratio)
    val_cut = train_ratio + (1 - train_ratio) * (val_ratio / test_ratio)
    u = unit_hash(F.col(key), seed)
    split = F.when(u < train_ratio, "train").when(u < val_cut, "val").otherwise("test")
    return df.withColumn("split", split)


def shuffle_rows(df: DataFrame, key: str = "msg_id", seed: int = 69, position: str | None = "pos") -> DataFrame:
    """Deterministic shuffled order; with ``position`` each row gets
    its 0-based place in that order."""
    if position is None:
        return df.orderBy(hash_key(F.col(key), seed), F.col(key))
    ranked = global_index(df.withColumn("_h", hash_key(F.col(key), seed)), ["_h", key], position)
    return ranked.drop("_h")
