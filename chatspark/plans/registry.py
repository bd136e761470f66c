"""Named queries: each has a Spark builder ``fn(spark, sf_dir) -> DataFrame``
and, where the result is SQL-expressible, an independent DuckDB oracle text
over the same driver tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class NamedQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    survey_id: str


QUERIES: dict[str, NamedQuery] = {}


def query(name: str, survey_id: str, oracle: str | None = None):
    """Register a named query (decorator)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = NamedQuery(name, fn, oracle, survey_id)
        return fn

    return deco


def load_all() -> dict[str, NamedQuery]:
    """Import every plan module (each registers its queries)."""
    from . import (  # noqa: F401
        features_q, text_q, labels_q, joins_q, metrics_q, topics_q, models_q, sources_q, streams_q,
    )
    return QUERIES
