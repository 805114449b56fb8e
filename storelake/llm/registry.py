"""Queries of the training-data operators (id -> callable(spark, sf_dir), DuckDB SQL where there is some)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("queries",)


def register(qid: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``qid``."""

    def deco(fn):
        QUERIES[qid] = fn
        if sql is not None:
            ORACLES[qid] = sql
        return fn

    return deco


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"storelake.llm.{m}")
