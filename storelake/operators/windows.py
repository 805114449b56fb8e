"""Window operators.

Plain ``Window.partitionBy(key)`` sends every row of a key to one task. Where
a key can be hot (one store or one device with a third of all rows) the
running-sum, session and rank operators below use a *segmented scan*:

1. partition by (key, bucket) where bucket is a time slice (day/hour) or a
   hash slice — many small windows instead of one huge one;
2. aggregate one summary row per (key, bucket) (partial aggregation, tiny);
3. a window over the summaries (one row per bucket) gives each bucket its
   carry-in (running total, last timestamp, rows before it);
4. join the carry-in back on (key, bucket) and finish inside the bucket.

The answer is identical to the single-window form (tests assert it); only
the parallelism changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


# W01 / W11 / W20 ----------------------------------------------------------------
def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1, rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per key by ``order`` (must end in a unique tiebreak).

    ``row_number() <= n`` lets Spark insert a WindowGroupLimit below the
    shuffle, so each map task forwards at most n rows per key: a hot key is
    cut down before it is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key (row_number over order desc = 1)."""
    return top_n_per_group(df, keys, [F.col(c).desc() for c in order], 1, "_rn").drop("_rn")


# W02 --------------------------------------------------------------------------
def dedupe_earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the earliest row per business key; NULL order values sort last."""
    return top_n_per_group(df, keys, [F.col(c).asc_nulls_last() for c in order], 1, "_rn").drop("_rn")


# W05 / W14 -- segmented running sum ---------------------------------------------
def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str = "running",
    bucket: Column | None = None,
    seed: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """sum(value) over rows ordered by ``order`` per key, plus ``seed``.

    With ``bucket`` (a column monotone in ``order``, e.g. ``to_date(ts)``)
    the sum runs as a segmented scan so a hot key spreads over its buckets.
    ``inclusive=False`` gives the sum of the rows strictly before."""
    seed = F.lit(0) if seed is None else seed
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(UNBOUNDED, 0 if inclusive else -1)
        s = F.coalesce(F.sum(value).over(w), F.lit(0))
        return df.withColumn(out, s + seed)
    b = df.withColumn("_bkt", bucket)
    tot = b.groupBy(*keys, "_bkt").agg(F.sum(value).alias("_bsum"))
    wb = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(UNBOUNDED, -1)
    carry = tot.select(*keys, "_bkt", F.coalesce(F.sum("_bsum").over(wb), F.lit(0)).alias("_carry"))
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(UNBOUNDED, 0 if inclusive else -1)
    return (
        b.join(carry, [*keys, "_bkt"], "inner")
        .withColumn(out, F.col("_carry") + F.coalesce(F.sum(value).over(w), F.lit(0)) + seed)
        .drop("_bkt", "_carry")
    )


def running_balance(
    ledger: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, qty: str, opening: Column | None = None, bucket: Column | None = None
) -> DataFrame:
    """Balance after each movement ordered by (ts, tiebreak) from an
    opening seed (default 0)."""
    return running_sum(ledger, keys, [ts, tiebreak], qty, "balance", bucket=bucket, seed=opening)


# W06 --------------------------------------------------------------------------
def threshold_crossings(balances: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, qty: str, balance: str = "balance") -> DataFrame:
    """Balance falls to <= 0 from > 0; first crossing per key and day.

    The balance before a movement is ``balance - qty`` (the running sum is
    exact), so no lag window is needed; the first-per-day pick is a partial
    aggregate (min_by), skew-safe."""
    prev = F.col(balance) - F.col(qty)
    x = balances.where((F.col(balance) <= 0) & (prev > 0)).withColumn("event_date", F.to_date(ts))
    order = F.struct(F.col(ts), F.col(tiebreak))
    vals = F.struct(F.col(ts).alias("event_ts"), F.col(tiebreak).alias(tiebreak), F.abs(F.col(qty)).alias("last_known_quantity"), F.col(balance).alias(balance))
    return x.groupBy(*keys, "event_date").agg(F.min_by(vals, order).alias("_v")).select(*keys, "event_date", "_v.*")


# W03 / W04 -- segmented sessionisation ----------------------------------------
def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: str,
    gap_seconds: float,
    bucket: Column | None = None,
    out: str = "session_no",
) -> DataFrame:
    """New session when the previous row of the key is absent or more than
    ``gap_seconds`` earlier (strict ``>``); ``out`` numbers sessions 1, 2, ...
    per key. Adds ``prev_ts`` and ``is_new``.

    With ``bucket`` the scan is segmented: the previous row across a bucket
    boundary comes from the preceding bucket's last timestamp."""
    # integer microsecond epochs: exact for fractional-second timestamps
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap_seconds = int(round(gap_seconds * 1_000_000))  # compared in microseconds
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(ts, tiebreak)
        x = df.withColumn("prev_ts", F.lag(ts).over(w))
        x = x.withColumn("is_new", F.col("prev_ts").isNull() | ((secs(ts) - secs("prev_ts")) > gap_seconds))
        return x.withColumn(out, F.sum(F.col("is_new").cast("int")).over(w.rowsBetween(UNBOUNDED, 0)))
    b = df.withColumn("_bkt", bucket)
    wi = Window.partitionBy(*keys, "_bkt").orderBy(ts, tiebreak)
    b = b.withColumn("_prev_in", F.lag(ts).over(wi))
    inner_new = F.col("_prev_in").isNotNull() & ((secs(ts) - secs("_prev_in")) > gap_seconds)
    stats = b.groupBy(*keys, "_bkt").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count_if(inner_new).alias("_inner_new")
    )
    wb = Window.partitionBy(*keys).orderBy("_bkt")
    stats = stats.withColumn("_prev_last", F.lag("_last").over(wb))
    first_new = F.col("_prev_last").isNull() | ((secs("_first") - secs("_prev_last")) > gap_seconds)
    stats = stats.withColumn("_bnew", F.col("_inner_new") + first_new.cast("int"))
    stats = stats.withColumn("_before", F.coalesce(F.sum("_bnew").over(wb.rowsBetween(UNBOUNDED, -1)), F.lit(0)))
    x = b.join(stats.select(*keys, "_bkt", "_prev_last", "_before"), [*keys, "_bkt"], "inner")
    x = x.withColumn("prev_ts", F.coalesce(F.col("_prev_in"), F.col("_prev_last")))
    x = x.withColumn("is_new", F.col("prev_ts").isNull() | ((secs(ts) - secs("prev_ts")) > gap_seconds))
    x = x.withColumn(out, F.col("_before") + F.sum(F.col("is_new").cast("int")).over(wi.rowsBetween(UNBOUNDED, 0)))
    return x.drop("_bkt", "_prev_in", "_prev_last", "_before")


def episodes(dates: DataFrame, keys: Sequence[str], date: str, gap_days: int = 7) -> DataFrame:
    """Distinct dates per key split into episodes where the gap is
    strictly more than ``gap_days``; one row per episode with start/end/days.
    Works on the distinct-date set (bounded by the calendar per key)."""
    d = dates.select(*keys, date).distinct()
    w = Window.partitionBy(*keys).orderBy(date)
    d = d.withColumn("_prev", F.lag(date).over(w))
    d = d.withColumn("_new", (F.col("_prev").isNull() | (F.datediff(F.col(date), F.col("_prev")) > gap_days)).cast("int"))
    d = d.withColumn("episode_no", F.sum("_new").over(w.rowsBetween(UNBOUNDED, 0)))
    return d.groupBy(*keys, "episode_no").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("active_days")
    )


# W07 / W08 ----------------------------------------------------------------------
def lag_features(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int] = (1, 7, 14, 28)) -> DataFrame:
    """lag(value, n) per key. On a densified daily grid (R01) a row lag is a
    day lag (G15); the grid bounds each key's partition by the calendar."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *[F.lag(value, n).over(w).alias(f"lag_{n}") for n in lags])


def rolling_stats(df: DataFrame, keys: Sequence[str], order: str, value: str, means: Sequence[int] = (7, 14, 28), stds: Sequence[int] = (14,)) -> DataFrame:
    """Rolling mean over the n rows before the current one (current row
    excluded) and rolling sample std."""
    w = Window.partitionBy(*keys).orderBy(order)
    cols = [F.avg(value).over(w.rowsBetween(-n, -1)).alias(f"roll_mean_{n}") for n in means]
    cols += [F.stddev_samp(value).over(w.rowsBetween(-n, -1)).alias(f"roll_std_{n}") for n in stds]
    return df.select("*", *cols)


# W09 ----------------------------------------------------------------------------
def dwell_to_next(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, cutoff_seconds: float = 3600) -> DataFrame:
    """Seconds until the next row of the same key; kept when 0 < d < cutoff."""
    w = Window.partitionBy(*keys).orderBy(ts, tiebreak)
    nxt = F.lead(ts).over(w)
    d = (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return df.withColumn("dwell_seconds", d).where((F.col("dwell_seconds") > 0) & (F.col("dwell_seconds") < cutoff_seconds))


def _by_day(df: DataFrame, keys: Sequence[str], ts: str, inside: Column, summary: Column, carry: Column, out: str) -> DataFrame:
    """``out`` = ``inside``, a window value within (key, day), or else what ``carry`` makes of
    the ``summary`` of the key's earlier days (one row a key and day)."""
    day = F.to_date(ts)
    x = df.withColumn("_day", day).withColumn("_in", inside)
    days = df.groupBy(*keys, day.alias("_day")).agg(summary.alias("_sum"))
    days = days.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_day").alias("_carry_day"), carry.alias("_carry"))
    same = F.col("_day").eqNullSafe(F.col("_carry_day"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return x.join(days, same).withColumn(out, F.coalesce("_in", "_carry")["v"]).drop("_day", "_in", "_carry", "_carry_day", *(f"_k_{k}" for k in keys))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """lag(value) per key in ``order`` (a timestamp first), a segmented scan by day: a key with
    a third of all rows is spread over its days."""
    boxed = F.struct(F.col(value).alias("v"))
    inside = F.lag(boxed).over(Window.partitionBy(*keys, "_day").orderBy(*order))
    carry = F.lag("_sum").over(Window.partitionBy(*keys).orderBy("_day"))
    return _by_day(df, keys, order[0], inside, F.max_by(boxed, F.struct(*order)), carry, out)


def last_at_or_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str, ts: str) -> DataFrame:
    """The latest non-null ``value`` at or before each row of the key (an as-of link), by day as in ``previous``."""
    boxed = F.when(value.isNotNull(), F.struct(value.alias("v")))
    w = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(UNBOUNDED, 0)
    at = F.when(value.isNotNull(), F.struct(*_cols(order)))
    carry = F.last("_sum", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(UNBOUNDED, -1))
    return _by_day(df, keys, ts, F.last(boxed, ignorenulls=True).over(w), F.max_by(boxed, at), carry, out)


# W10 ----------------------------------------------------------------------------
def changes(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, state: str, from_col: str = "from_state", to_col: str = "to_state") -> DataFrame:
    """Rows where ``state`` differs from the previous row of the key."""
    x = previous(df, keys, [ts, tiebreak], state, from_col).withColumn(to_col, F.col(state))
    return x.where(F.col(from_col).isNotNull() & (F.col(from_col) != F.col(to_col)))


# W12 / W13 / W15 -- distributed row numbers ------------------------------------
def bucketed_row_number(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    out: str = "row_no",
) -> DataFrame:
    """row_number() over (partition by ``partition`` order by ``order``)
    without gathering a partition into one task.

    ``bucket`` must be non-decreasing along ``order`` (e.g. a quantised
    probability or hash). Rows are numbered inside (partition, bucket) and
    offset by the count of all earlier buckets, taken from a tiny per-bucket
    count table. With an empty ``partition`` this is a global ranking."""
    b = df.withColumn("_bkt", bucket)
    cnt = b.groupBy(*partition, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*partition).orderBy("_bkt").rowsBetween(UNBOUNDED, -1) if partition else Window.orderBy("_bkt").rowsBetween(UNBOUNDED, -1)
    off = cnt.select(*partition, "_bkt", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(*partition, "_bkt").orderBy(*order)
    return b.join(off, [*partition, "_bkt"], "inner").withColumn(out, F.col("_off") + F.row_number().over(wi)).drop("_bkt", "_off")


def hash_unit(cols: Sequence[str | Column], seed: int, portable: bool = True) -> Column:
    """Deterministic uniform value in [0, 1) from a hash of the columns and a
    seed: independent of partitioning, unlike rand(seed)."""
    from storelake.functions.hashing import md5_unit, xxhash_unit

    return md5_unit(cols, seed) if portable else xxhash_unit(cols, seed)


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = 42, test_fraction: float = 0.2, buckets: int = 1024) -> DataFrame:
    """Per class, rows ordered by a seeded hash; the first
    max(1, floor(fraction * n_class)) rows are ``test``."""
    u = hash_unit([id_col], seed)
    x = df.withColumn("_u", u).withColumn("_tb", F.col(id_col))
    ranked = bucketed_row_number(x, [label], [F.col("_u"), F.col("_tb")], F.floor(F.col("_u") * buckets), "_rk")
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_cls_n"))
    ranked = ranked.join(n, label, "inner")
    k = F.greatest(F.lit(1), F.floor(F.col("_cls_n") * test_fraction))
    return ranked.withColumn("split", F.when(F.col("_rk") <= k, F.lit("test")).otherwise(F.lit("train"))).drop("_u", "_tb", "_rk", "_cls_n")


def capped_group_sample(df: DataFrame, group: Sequence[str], id_col: str, rate: float, seed: int = 7, buckets: int = 1024) -> DataFrame:
    """Keep the first floor(rate * n_group) rows per group by seeded rank."""
    u = hash_unit([id_col], seed)
    x = df.withColumn("_u", u)
    ranked = bucketed_row_number(x, list(group), [F.col("_u"), F.col(id_col)], F.floor(F.col("_u") * buckets), "_rk")
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_gn"))
    return ranked.join(n, list(group), "inner").where(F.col("_rk") <= F.floor(F.col("_gn") * rate)).drop("_u", "_rk", "_gn")


# W16 ----------------------------------------------------------------------------
def share_of_total(df: DataFrame, group: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """value / sum(value) within group (transition probabilities). Meant
    for aggregated inputs (one row per transition)."""
    w = Window.partitionBy(*group)
    return df.withColumn(out, F.col(value) / F.sum(value).over(w))


# W17 ----------------------------------------------------------------------------
def period_to_date(df: DataFrame, keys: Sequence[str], date: str, value: str, unit: str, out: str | None = None) -> DataFrame:
    """YTD/QTD/MTD: running sum in each calendar period (``unit`` = year,
    quarter, month) on a dense daily series."""
    period = F.trunc(F.col(date), unit)
    w = Window.partitionBy(*keys, period).orderBy(date).rowsBetween(UNBOUNDED, 0)
    return df.withColumn(out or f"{unit}_to_date", F.sum(value).over(w))


# W18 ----------------------------------------------------------------------------
def prior_period(df: DataFrame, keys: Sequence[str], date: str, value: str, months: int = 0, days: int = 0, out: str = "prior") -> DataFrame:
    """Value of the same key at date shifted back (``add_months`` clamps the
    day). Equi self-join on the shifted date: correct on sparse series, and
    NULL when the prior period is outside the data."""
    # Each current row looks up its own target date (DAX DATEADD: Mar 31 -> Feb 28/29),
    # so (keys, date) must be unique in ``df``.
    target = F.add_months(F.col(date), -months) if months else F.date_sub(F.col(date), days)
    prior = df.select(*keys, F.col(date).alias("_target"), F.col(value).alias(out))
    return df.withColumn("_target", target).join(prior, [*keys, "_target"], "left").drop("_target")


# W19 ----------------------------------------------------------------------------
def trailing_windows(df: DataFrame, keys: Sequence[str], date: str, value: str, width: int = 7) -> DataFrame:
    """Sum over the trailing ``width`` days and over the ``width`` days
    before those (range frames on the day number, gaps allowed)."""
    day = F.unix_date(F.col(date))
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumn(f"last_{width}d", F.sum(value).over(w.rangeBetween(-(width - 1), 0))).withColumn(
        f"prev_{width}d", F.sum(value).over(w.rangeBetween(-(2 * width - 1), -width))
    )
