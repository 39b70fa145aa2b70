"""Named queries and their SQL counterparts; every key of one plan stands beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlake.plans import oracle
from barlake.plans.frames import Frames, release

Query = Callable[[SparkSession, str], DataFrame]
_plans: dict[str, Callable[[Frames], DataFrame]] = {}
_sql: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register a plan over frames, and the SQL that gives the same rows where there is one."""

    def add(f: Callable[[Frames], DataFrame]):
        _plans[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    from barlake.plans import bars, identities, rankings, studies  # noqa: F401


def queries() -> dict[str, Query]:
    _load()

    def query(f: Callable[[Frames], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()
            return f(Frames(spark, sf_dir))

        return run

    return {name: query(f) for name, f in _plans.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: oracle.complete(sql) for name, sql in _sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["gap_study_flagship"](spark, sf_dir)
