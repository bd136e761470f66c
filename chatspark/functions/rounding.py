"""Exact rounding of integer ratios.

Means are computed as exact integer numerators and denominators and rounded
once, half to even, on the rational value. This gives the same double in
every engine (it never depends on the order of a floating-point sum)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_ratio(num: Column, den: Column, places: int = 2) -> Column:
    """round_half_even(num / den, places) for non-negative integer num and
    positive integer den; NULL when den is 0 or NULL."""
    scale = 10 ** places
    scaled = num.cast("long") * F.lit(scale)
    d = F.nullif(den.cast("long"), F.lit(0))
    q = F.floor(scaled / d).cast("long")
    r = scaled - q * d
    up = (r * 2 > d) | ((r * 2 == d) & (q % 2 == 1))
    return ((q + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(scale)))


def duck_round_ratio(num: str, den: str, places: int = 2) -> str:
    """DuckDB text of :func:`round_ratio` (for oracles)."""
    scale = 10 ** places
    s = f"(CAST({num} AS BIGINT) * {scale})"
    d = f"NULLIF(CAST({den} AS BIGINT), 0)"
    q = f"({s} // {d})"
    r = f"({s} - {q} * {d})"
    return (f"(CAST({q} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE)"
            f" / {float(scale)})")
