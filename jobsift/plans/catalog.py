"""Registered queries: name -> Spark builder (spark, sf_dir) -> DataFrame,
and name -> DuckDB oracle SQL over the same parquet tables.

Every query reads the driver's tables through the fixture views of
``jobsift.sources.fixtures`` and runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers itself)."""
    from jobsift.plans import (q_classify, q_dedup, q_io, q_live, q_match, q_skills,  # noqa: F401
                               q_tables, q_text, q_vectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: f() for k, f in ORACLES.items()}
