"""Registry of named queries: a Spark plan and, where SQL can say it, the
equivalent DuckDB SQL over the same parquet tables (the correctness oracle).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpuskit.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    """Decorator: ``@register("bm25_topk", sql=...)`` on ``fn(tables) -> DataFrame``."""
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, note)
        return fn
    return deco


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # timestamps are interpreted and rendered in UTC (NTZ inputs, 'Z' and
        # offset texts); pin it for sessions that did not set it
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return q.build(Tables(spark, sf_dir))
    run.__name__ = q.name
    return run


def load_all() -> dict[str, Query]:
    # importing the plan modules fills REGISTRY
    import importlib
    for mod in PLAN_MODULES:
        importlib.import_module(f"corpuskit.plans.{mod}")
    return REGISTRY


PLAN_MODULES = ["search", "urls", "corpus", "websearch", "items", "threads", "mail", "results", "streams", "files", "vectors"]
