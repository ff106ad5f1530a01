"""Registered queries: each is (spark, sf_dir) -> DataFrame plus, where SQL can express it,
the same result as DuckDB SQL over the same tables (the correctness oracle).

Queries read the whole tables of ``sf_dir``; none narrows its input to make a check cheap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    survey_ids: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None):
    """Register ``fn`` under ``name``; ``ids`` lists the SURVEY operator ids it covers."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle.strip() if oracle else None, tuple(ids.split()))
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from featpipe.queries import (  # noqa: F401
        q_contracts,
        q_features,
        q_metrics,
        q_relational,
        q_sources,
        q_splits,
        q_steps,
        q_streams,
        q_tracking,
        q_training,
    )

    return REGISTRY
