"""Calendar and dense grids.

Both are built on executors from a ``sequence`` explode over the data's own
date range: no driver-side loop, no Python rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_columns(d: Column) -> list[Column]:
    """X03 calendar attributes of a date column.

    Fixed definitions: ISO day of week (Mon=1..Sun=7); week_of_year is the
    Sunday-based week number (strftime %U: days before the first Sunday are
    week 0); weekend = Sat/Sun; fiscal year starts in July and is named by
    its starting calendar year; fiscal quarter 1 = Jul-Sep.
    """
    dow_sun0 = F.dayofweek(d) - 1  # Sunday = 0
    iso_dow = F.when(dow_sun0 == 0, F.lit(7)).otherwise(dow_sun0)
    month = F.month(d)
    return [
        (F.year(d) * 10000 + month * 100 + F.dayofmonth(d)).cast("bigint").alias("date_key"),
        d.alias("date"),
        F.year(d).cast("bigint").alias("year"),
        F.quarter(d).cast("bigint").alias("quarter"),
        month.cast("bigint").alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).cast("bigint").alias("day"),
        iso_dow.cast("bigint").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.floor((F.dayofyear(d) - 1 + 7 - dow_sun0) / 7).cast("bigint").alias("week_of_year"),
        F.weekofyear(d).cast("bigint").alias("iso_week"),
        (iso_dow >= 6).cast("bigint").alias("is_weekend"),
        F.when(month >= 7, F.year(d)).otherwise(F.year(d) - 1).cast("bigint").alias("fiscal_year"),
        (F.floor(F.pmod(month - 7, F.lit(12)) / 3) + 1).cast("bigint").alias("fiscal_quarter"),
    ]


def dim_date(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per day between the ``start`` and ``end`` columns of a
    one-row ``bounds`` frame (e.g. min/max of a fact's dates)."""
    days = bounds.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("_d"))
    return days.select(*calendar_columns(F.col("_d")))


def densify(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    values: Sequence[str],
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Complete daily grid per key, zeros where a key has no row.

    Each key's range is its own first..last date unless ``start``/``end``
    (literals) are given. The grid is a per-key ``sequence`` explode on
    executors followed by an equi left join on (keys, date); there is no
    cross join of keys and calendar."""
    rng = df.groupBy(*keys).agg(
        (start if start is not None else F.min(date)).alias("_s"),
        (end if end is not None else F.max(date)).alias("_e"),
    )
    grid = rng.select(*keys, F.explode(F.sequence("_s", "_e")).alias(date))
    out = grid.join(df, [*keys, date], "left")
    return out.fillna(0, subset=list(values))


def calendar_features(df, day: str):
    """Model features of a date column: day of week and month, month, ISO week, weekend."""
    parts = {"day_of_week": F.dayofweek, "day_of_month": F.dayofmonth, "month": F.month, "week_of_year": F.weekofyear}
    out = df.withColumns({name: part(F.col(day)) for name, part in parts.items()})
    return out.withColumn("is_weekend", F.when(F.col("day_of_week").isin(1, 7), 1).otherwise(0))
