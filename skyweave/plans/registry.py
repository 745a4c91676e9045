"""Names of the survey queries, their plans and their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyweave.plans.fixtures import Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a plan over ``Tables``, with the SQL that gives the same rows."""

    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = plan
        if oracle is not None:
            # count_if is a wider integer in DuckDB than in Spark
            _ORACLES[name] = with_views(re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"count(case when \1 then 1 end)", oracle))
        return plan

    return add


def _load() -> None:
    from skyweave.plans import aggregate_queries, catalog_queries, fine_queries, frame_queries, job_queries, library_queries, match_queries, pixel_queries, review_queries, scan_queries, source_queries, survey_queries, view_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind line scan on a 25 nm grid and its gap clusters, best first."""
    _load()
    return _QUERIES["w4_gap_clusters"](Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, plan in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
