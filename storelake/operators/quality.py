"""Data-quality checks (§2.12, D01–D16). Every check returns one row
``(check, violations)``; ``report`` unions them. All checks are aggregates or
anti joins (no collect); a report is one Spark job per check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.operators import windows


def _row(df: DataFrame, name: str, violations: Column) -> DataFrame:
    return df.agg(violations.cast("bigint").alias("violations")).select(F.lit(name).alias("check"), "violations")


def key_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows - distinct keys."""
    k = df.select(*keys)
    total = k.agg(F.count(F.lit(1)).alias("n"))
    distinct = k.distinct().agg(F.count(F.lit(1)).alias("d"))
    return _pair(total, distinct, name)


def _pair(total: DataFrame, distinct: DataFrame, name: str) -> DataFrame:
    t = total.withColumn("_k", F.lit(1))
    d = distinct.withColumn("_k", F.lit(1))
    return t.join(d, "_k").select(F.lit(name).alias("check"), (F.col("n") - F.col("d")).cast("bigint").alias("violations"))


def orphans(child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str], name: str) -> DataFrame:
    """Child rows whose key has no parent (left_anti count); NULL keys
    are not orphans."""
    c = child.select(*[F.col(a).alias(f"_k{i}") for i, a in enumerate(child_keys)]).where(F.coalesce(*[F.col(f"_k{i}").isNotNull() for i in range(len(child_keys))]))
    p = parent.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(parent_keys)]).distinct()
    return _row(c.join(p, [f"_k{i}" for i in range(len(child_keys))], "left_anti"), name, F.count(F.lit(1)))


def exactly_one(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Rows where both or neither of two keys are set."""
    return _row(df, name, F.count_if(F.col(a).isNull() == F.col(b).isNull()))


def not_null(df: DataFrame, col: str, name: str) -> DataFrame:
    """D04."""
    return _row(df, name, F.count_if(F.col(col).isNull()))


def ordered(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """End before start."""
    return _row(df, name, F.count_if(F.col(end) < F.col(start)))


def running_consistent(df: DataFrame, keys: Sequence[str], order: Sequence[str], qty: str, balance: str, name: str) -> DataFrame:
    """Balance - previous balance = movement (first row: balance = qty)."""
    df = windows.previous(df, keys, order, balance, "_prev")
    prev = F.coalesce("_prev", F.lit(0))
    return _row(df.withColumn("_ok", (F.col(balance) - prev) == F.col(qty)), name, F.count_if(~F.col("_ok")))


def report(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


# The statuses of a shipment in their order.
STATUSES = ["SCHEDULED", "LOADING", "IN_TRANSIT", "ARRIVED", "UNLOADING", "COMPLETED"]


def lifecycle_checks(statuses: DataFrame, cargo: DataFrame) -> DataFrame:
    """Shipments whose lifecycle is broken, by check.

    ``statuses (shipment_id, status, event_ts)`` is folded to the first and the last time of each status
    by shipment, a state of twelve times however many rows a shipment has: ``all_six_statuses``
    counts shipments without one of them, ``statuses_in_order`` those where a status starts before
    the one that must come before it has ended, ``status`` values outside the list counting as missing.
    ``cargo (shipment_id, product_id, quantity, action LOAD|UNLOAD)`` is compared as multisets: what was
    unloaded beyond the load (``unload_has_load``), what was loaded and stayed (``load_is_unloaded``)."""
    times = [a for s in STATUSES for a in (F.min(F.when(F.col("status") == s, F.col("event_ts"))).alias(f"{s}_a"), F.max(F.when(F.col("status") == s, F.col("event_ts"))).alias(f"{s}_z"))]
    by = statuses.groupBy("shipment_id").agg(*times)
    missing, backwards = F.lit(False), F.lit(False)
    for s in STATUSES:
        missing = missing | F.col(f"{s}_a").isNull()
    for i, s in enumerate(STATUSES):
        for t in STATUSES[i + 1 :]:
            backwards = backwards | F.coalesce(F.col(f"{s}_z") >= F.col(f"{t}_a"), F.lit(False))
    net = cargo.groupBy("shipment_id", "product_id").agg(F.sum(F.when(F.col("action") == "LOAD", F.col("quantity")).when(F.col("action") == "UNLOAD", -F.col("quantity"))).alias("left"))
    one = by.agg(F.count_if(backwards).alias("statuses_in_order"), F.count_if(missing).alias("all_six_statuses"))
    two = net.agg(F.count_if(F.col("left") < 0).alias("unload_has_load"), F.count_if(F.col("left") > 0).alias("load_is_unloaded"))
    long = lambda df: df.unpivot([], df.columns, "check", "violations")
    return long(one).unionByName(long(two))
