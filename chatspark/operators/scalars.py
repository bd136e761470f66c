"""Attaching a one-row aggregate (totals, means, bounds) to a table.

The aggregate is computed once (partial aggregation, one row back to the
driver -- a bounded, fixed-size result) and attached as typed literals, so
plans stay plain projections: no join on a constant key, which Catalyst
would turn into a nested-loop (cross) join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of the single-row ``one`` added to every row."""
    row = one.first()
    values = row.asDict() if row is not None else {c: None for c in one.columns}
    types = {f.name: f.dataType for f in one.schema.fields}
    return df.select("*", *[F.lit(values[c]).cast(types[c]).alias(c) for c in one.columns])
