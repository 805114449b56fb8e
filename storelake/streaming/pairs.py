"""Pairing of two streams whose open rows are a table, not a state store.

A stream-stream join keeps a state row for every row that may still pair, in memory or in a store on the executor's
disk, and looks each new row up alone. With a bound of months or years that is most of the input. Here every
micro-batch is one join: its rows with each other and with the open rows of earlier batches, which lie as
a view in the shared folder (:mod:`storelake.streaming.views`). A task sorts its share and spills, so memory does not
grow with the open rows.

The rules are those of a stream-stream join with watermarks. The mark of a batch is the newest time of the slower stream
in the batches before it, less the lateness: rows at or below it are late and left out, and open rows that can reach
no row above it any more are neither read nor merged on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.streaming import runner, views

DAY = 86_400_000_000  # microseconds
MARKS = "arrival long, departure long, batch_id long"


def run_pairs(arrivals: DataFrame, departures: DataFrame, key: str, arrival: str, departure: str, within_days: int, late_days: int, base: str, writer: Callable, unpaired: bool = False) -> str:
    """Write every pair of the streams with ``arrival < departure <= arrival + within_days`` once, in the batch that
    brings its later half, through ``writer(df, batch_id, out)``; returns ``out``. With ``unpaired`` an arrival whose last possible
    departure the mark has passed leaves too, once, with NULL if none came.

    A replayed batch rewrites its own output. The view names the batch's rows only when that is written, so a batch the
    view has merged on is written too and is left alone."""
    spark, state = arrivals.sparkSession, f"{base}/open"
    sides = {"arrival": (arrivals, arrival), "departure": (departures, departure)}
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.withColumnRenamed(ts, "_ts").withColumn("_side", F.lit(s)) for s, (x, ts) in sides.items()])

    def mark(bid: int) -> int | None:
        """The mark of batch ``bid`` in microseconds, if both streams had rows before it."""
        if bid == 0:
            return None
        m = tuple(spark.read.schema(MARKS).parquet(f"{base}/marks").where(F.col("batch_id") < bid).agg(F.max("arrival"), F.max("departure")).first())
        return None if None in m else min(m) - late_days * DAY

    def above(rows: DataFrame, us: int | None) -> DataFrame:
        return rows if us is None else rows.where(F.col("_ts") > F.timestamp_micros(F.lit(us)))

    def still_open(m: int | None) -> Callable:
        return lambda rows: above(rows, None if m is None else m - within_days * DAY - 1)

    def side(rows: DataFrame, name: str) -> DataFrame:
        x, ts = sides[name]
        return rows.where(F.col("_side") == name).select(*(F.col("_ts").alias(c) if c == ts else F.col(c) for c in x.columns), F.col("_new").alias(f"_new_{name}"))

    def batch(df: DataFrame, bid: int, out: str) -> None:
        before = mark(bid)

        def pairs(part: str, older: list[str]) -> None:
            read = spark.read.schema(union.schema)
            new = read.parquet(part)
            latest = [F.unix_micros(F.max(F.when(F.col("_side") == s, F.col("_ts")))).alias(s) for s in sides]
            new.agg(*latest).write.mode("overwrite").parquet(f"{base}/marks/batch_id={bid}")
            after = mark(bid + 1)
            rows = new.withColumn("_new", F.lit(True))
            if older:
                rows = rows.unionByName(still_open(before)(read.parquet(*older)).withColumn("_new", F.lit(False)))
            a, b = side(rows, "arrival"), side(rows, "departure").withColumnRenamed(key, "_key")
            on = F.expr(f"{key} = _key AND {departure} > {arrival} AND {departure} <= {arrival} + INTERVAL {within_days} DAYS")
            found = F.col("_new_arrival") | F.col("_new_departure")
            if unpaired:
                gone = F.lit(False) if after is None else F.col(arrival) < F.timestamp_micros(F.lit(after - within_days * DAY))
                found = F.when(F.col("_new_departure").isNull(), gone).otherwise(found)
            x = a.join(b, on, "leftOuter" if unpaired else "inner").where(found)
            writer(x.drop("_key", "_new_arrival", "_new_departure"), bid, out)

        views.commit(above(df, before), bid, state, still_open(before), use=pairs)

    return runner.run_batches(union, base, batch)
