"""Equi-joins of the message data (J01-J06) and the size-checked broadcast.

All reference joins are dictionary lookups. Here the small side is
broadcast only after its row count is checked against a bound; above the
bound the join stays a shuffle join and AQE's skew-join handling splits a
hot key (``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BROADCAST_MAX_ROWS = 2_000_000
#: a key is hot if it has this part of all rows, so at most so many keys are
HOT_SHARE = 1000


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """(side, small): ``F.broadcast`` of the cached ``df`` when it has at
    most ``max_rows`` rows (checked with one count job), else ``df``
    unchanged for a shuffle join."""
    cached = df.cache()
    n = cached.limit(max_rows + 1).count()
    if n <= max_rows:
        cached.count()  # fully materialise the small side once
        return F.broadcast(cached), True
    cached.unpersist()
    return df, False


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``F.broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else
    ``df`` unchanged (AQE splits hot keys of the shuffle join)."""
    return small_side(df, max_rows)[0]


def split_join(rows: DataFrame, facts: DataFrame, key: str, freq: str, how: str = "inner",
               total: int | None = None) -> DataFrame:
    """Join ``rows`` with ``facts``, one row for each value of ``key``, whose
    column ``freq`` says how many rows have that value.

    Values with a share of at least 1 / HOT_SHARE of what ``freq`` adds up to,
    of which there are at most HOT_SHARE, are broadcast, so their rows stay
    where they are; the others, none of which is hot, meet in a shuffle.
    ``freq`` is kept. ``how`` is inner or left; facts with a null key and rows
    with one meet nothing. The facts are written once (they are read for their
    sum and by both joins); a caller who knows the sum gives ``total`` and
    facts that are written already."""
    if how not in ("inner", "left"):
        raise ValueError(f"split_join does inner and left joins, not {how}")
    if total is None:
        facts = cut_lineage(facts)
        total = facts.agg(F.sum(freq)).first()[0] or 0
    hot = facts.filter(F.col(freq) * HOT_SHARE >= F.lit(total))
    hit = rows.join(F.broadcast(hot), key, "inner")
    miss = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return hit.unionByName(miss.join(facts.filter(F.col(freq) * HOT_SHARE < F.lit(total)), key, how))


def merge_user_aliases(msgs: DataFrame, alias: DataFrame, uid: str = "uid") -> DataFrame:
    """Replace uid by its canonical uid when listed."""
    a = sized_broadcast(alias.select(F.col("uid").alias("_alias_uid"), F.col("canonical").alias("_canonical")))
    return (msgs.join(a, F.col(uid) == F.col("_alias_uid"), "left")
            .withColumn(uid, F.coalesce(F.col("_canonical"), F.col(uid)))
            .drop("_alias_uid", "_canonical"))


def attach_user_vector(msgs: DataFrame, users: DataFrame, feature_cols: list[str], uid: str = "uid") -> DataFrame:
    """The user's features on every message; zeros when the user has no
    vector (too few messages)."""
    u = sized_broadcast(users.select(uid, *feature_cols))
    j = msgs.join(u, uid, "left")
    return j.select(*msgs.columns, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feature_cols])


def messages_with_vector(msgs: DataFrame, users: DataFrame, uid: str = "uid") -> DataFrame:
    """Only messages whose user has a vector."""
    return msgs.join(sized_broadcast(users.select(uid)), uid, "left_semi")


def aligned_mismatches(source: DataFrame, target: DataFrame, key: str = "msg_id",
                       exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows present in both (by key) whose shared columns differ
    (NULL-safe). One output row per (key, column) difference."""
    shared = sorted((set(source.columns) & set(target.columns)) - {key} - set(exclude))
    s = source.select(key, *[F.col(c).cast("string").alias(f"s_{c}") for c in shared])
    t = target.select(key, *[F.col(c).cast("string").alias(f"t_{c}") for c in shared])
    j = s.join(t, key, "inner")
    diffs = F.array(*[F.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")),
                             F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("source_value"),
                                      F.col(f"t_{c}").alias("target_value"))) for c in shared])
    return (j.select(key, F.explode(F.filter(diffs, lambda x: x.isNotNull())).alias("d"))
            .select(key, "d.column", "d.source_value", "d.target_value"))


def resume_remaining(todo: DataFrame, done: DataFrame, key: str = "msg_id", label: str = "label") -> DataFrame:
    """Rows not yet labelled (no row with a non-NULL label in ``done``)."""
    finished = done.filter(F.col(label).isNotNull()).select(key)
    return todo.join(finished, key, "left_anti")


def paired_predictions(truth: DataFrame, baseline: DataFrame, candidate: DataFrame, key: str = "msg_id") -> DataFrame:
    """Truth and both models' predictions side by side (inner joins)."""
    return truth.join(baseline, key, "inner").join(candidate, key, "inner")
