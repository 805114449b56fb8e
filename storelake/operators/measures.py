"""BI measures (§2.15): a measure is an aggregate under a filter context.

``evaluate(base, specs, derived, group_by)`` computes every base measure of
one fact in a single aggregate (one scan, partial aggregation), then the
derived measures (ratios, sums of measures) on the aggregated rows. Facts are
aggregated separately and combined on their group columns — never fact to
fact — so no measure double counts through a join.

DAX semantics kept: DIVIDE(x, y, 0) -> 0 on a zero/blank denominator
(``divide0``); DIVIDE(x, y, BLANK()) -> NULL (``divide_blank``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    mid: str  # stable id, e.g. "B060"
    name: str  # output column
    spark: Callable[[], Column] | None  # aggregate over the base rows (None for derived); built lazily
    sql: str  # the same aggregate / expression in SQL (oracle)
    derived: Callable[[], Column] | None = None  # expression over other measure columns


def divide0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def divide_blank(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def sql_divide0(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


def sql_divide_blank(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


def evaluate(base: DataFrame, measures: Sequence[Measure], group_by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    aggs = [m.spark().alias(m.name) for m in measures if m.spark is not None]
    out = base.groupBy(*group_by).agg(*aggs) if group_by else base.agg(*aggs)
    for m in measures:
        if m.derived is not None:
            out = out.withColumn(m.name, m.derived())
    cols = [F.col(g) for g in group_by]
    for m in measures:
        c = F.col(m.name)
        cols.append(F.round(c, digits).alias(m.name) if m.spark is None or "avg" in m.sql.lower() or "/" in m.sql else c)
    return out.select(*cols)


def evaluate_sql(base_sql: str, measures: Sequence[Measure], group_by: Sequence[str] = (), digits: int = 6) -> str:
    """The DuckDB text of :func:`evaluate` (same rounding rule)."""
    inner = ", ".join([*group_by, *[f"{m.sql} AS {m.name}" for m in measures if m.spark is not None]])
    g = f" GROUP BY {', '.join(group_by)}" if group_by else ""
    outer = []
    for m in measures:
        expr = m.sql if m.spark is None else m.name
        rounded = m.spark is None or "avg" in m.sql.lower() or "/" in m.sql
        outer.append(f"round({expr}, {digits}) AS {m.name}" if rounded else f"{expr} AS {m.name}")
    # derived measures may reference each other: expose base columns first
    return f"SELECT {', '.join([*group_by, *outer])} FROM (SELECT {inner} FROM {base_sql} b{g})"
