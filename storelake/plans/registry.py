"""Registry of named queries (id -> callable(spark, sf_dir) and oracle SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "gold",
    "named",
    "windows",
    "joins",
    "sets",
    "scalars",
    "silver",
    "sources",
    "quality",
    "analytics",
    "measures",
    "reaimed",
    "streams",
)


def register(qid: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``qid``."""

    def deco(fn: QueryFn) -> QueryFn:
        if qid in QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        QUERIES[qid] = fn
        if sql is not None:
            ORACLES[qid] = sql
        return fn

    return deco


def load() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"storelake.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"storelake.plans.{m}":
                raise


def queries() -> dict[str, QueryFn]:
    load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
