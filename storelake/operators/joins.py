"""Join operators.

Equi joins are left to Catalyst/AQE: the optimizer picks sort-merge or
shuffled-hash join, and AQE converts to a broadcast only when the built side
is *measured* under ``spark.sql.autoBroadcastJoinThreshold`` at run time, and
splits skewed partitions of a hot key. Explicit ``broadcast`` hints are used
only for sides whose size is bounded by construction (a rule table, a
per-nation summary).

Range joins (J09–J12, J15) have no native operator in Spark. The bucketed
form below keeps them equi joins: the interval side is exploded into the
time buckets it overlaps, the point side is tagged with its single bucket,
they meet on (keys, bucket) and the exact bounds are applied afterwards. A
point lies in exactly one bucket, so no pair is produced twice and none is
lost; the work is proportional to the output, not to a cartesian product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys with NULL == NULL (the lifecycle pairing of J14/G12)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys]) if how in ("inner", "left", "left_outer") else out


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Per-column fill values after a left join (0 for activity,
    window + 1 for recency, ...)."""
    return df.fillna(defaults)


def _epoch_us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_start: str,
    left_end: str,
    right_ts: str,
    bucket_seconds: int = 86400,
    how: str = "inner",
    lower_inclusive: bool = True,
    upper_inclusive: bool = True,
    left_id: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of ``right`` whose ``right_ts`` lies in [left_start, left_end] of
    a ``left`` row with equal keys (bounds inclusive by default).

    ``how='left'`` keeps left rows without a match (right columns NULL); it
    needs ``left_id``, a unique key of ``left`` (deterministic under
    recomputation, unlike a generated row id).
    Choose ``bucket_seconds`` near the typical interval length: each left
    row is copied once per bucket it overlaps."""
    bu = bucket_seconds * 1_000_000
    lcols = left.columns
    if how != "inner" and not left_id:
        raise ValueError("range_join(how='left') needs left_id")
    first, last = F.floor(_epoch_us(F.col(left_start)) / bu), F.floor(_epoch_us(F.col(left_end)) / bu)
    rcols = [c for c in right.columns if c not in keys]
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.floor(_epoch_us(F.col(right_ts)) / bu).alias("_rbkt"), F.struct(*rcols).alias("_m"))
    t = F.col(f"_m.{right_ts}")
    lo = (t >= F.col(left_start)) if lower_inclusive else (t > F.col(left_start))
    hi = (t <= F.col(left_end)) if upper_inclusive else (t < F.col(left_end))
    on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_bkt") == F.col("_rbkt")]
    if how == "inner":
        pieces = left.withColumn("_bkt", F.explode(F.sequence(first, last)))
        return pieces.join(r, on, "inner").where(lo & hi).select(*lcols, "_m.*")
    # left outer, by pieces: a piece without a match gives a row with _m NULL. It stands for its
    # interval where the interval has no other piece, or where all of its pieces came out so. Both
    # branches read the same two exchanges (_m is one column, so pruning leaves them alike).
    valid = F.col(left_start) <= F.col(left_end)
    pieces = left.withColumn("_n", F.when(valid, last - first + 1).otherwise(1))
    pieces = pieces.withColumn("_bkt", F.explode(F.when(valid, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("bigint")))))
    joined = pieces.join(r, [*on, lo, hi], "left")
    alone = joined.where(F.col("_m").isNotNull() | (F.col("_n") == 1)).select(*lcols, "_m.*")
    rest = [c for c in lcols if c not in left_id]
    missed = joined.where(F.col("_m").isNull() & (F.col("_n") > 1)).groupBy(*left_id).agg(*[F.first(c).alias(c) for c in rest], F.first("_n").alias("_n"), F.count(F.lit(1)).alias("_c"))
    missed = missed.where(F.col("_c") == F.col("_n"))
    return alone.unionByName(missed.select(*lcols, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rcols]))


def range_aggregate(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_start: str,
    left_end: str,
    right_ts: str,
    count: str,
    sums: dict[str, str],
    bucket_seconds: int = 86400,
) -> DataFrame:
    """Every row of ``left`` with the number (``count``) and the sums (``sums``: output name to
    integer column of ``right``) of the rows of ``right`` whose ``right_ts`` lies in
    [left_start, left_end] and whose keys are equal. Intervals without a match keep their row, with
    0 and NULL sums; so do those with a NULL bound or key, or that end before they start. Rows of
    ``left`` must be distinct.

    No match is ever a row. An interval is cut at bucket edges; the two ends of a piece and the
    points of (keys, bucket) go through one running sum, and what stands at the end less what stands at
    the start is the piece's share. One exchange by (keys, bucket), one to add the shares up."""
    bu = bucket_seconds * 1_000_000
    cols = left.columns
    lo, hi = _epoch_us(F.col(left_start)), _epoch_us(F.col(left_end))
    valid = F.col(left_start) <= F.col(left_end)
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    p = left.select(F.struct(*cols).alias("_l"), *keys, lo.alias("_lo"), hi.alias("_hi"), valid.alias("_ok"))
    buckets = F.sequence(F.floor(F.col("_lo") / bu), F.floor(F.col("_hi") / bu))
    p = p.withColumn("_bkt", F.explode(F.when(F.col("_ok"), buckets).otherwise(F.array(F.lit(-1).cast("bigint")))))
    start, end = F.greatest(F.col("_lo"), F.col("_bkt") * bu), F.least(F.col("_hi"), F.col("_bkt") * bu + (bu - 1))
    # at equal times the start stands before the points and the end after them: both bounds are inclusive
    mark = lambda t, o, sign: F.struct(t.alias("_t"), F.lit(o).alias("_o"), F.when(F.col("_ok"), sign).otherwise(0).alias("_sign"))
    p = p.withColumn("_mark", F.explode(F.array(mark(start, 0, -1), mark(end, 2, 1))))
    p = p.select("_l", *keys, "_bkt", "_mark.*", F.lit(0).alias("_one"), *[F.lit(0).cast("bigint").alias(f"_v_{o}") for o in sums])
    us = _epoch_us(F.col(right_ts))
    q = right.where(F.col(right_ts).isNotNull())
    for k in keys:
        q = q.where(F.col(k).isNotNull())
    q = q.select(
        F.lit(None).cast(p.schema["_l"].dataType).alias("_l"), *keys, F.floor(us / bu).alias("_bkt"), us.alias("_t"), F.lit(1).alias("_o"), F.lit(0).alias("_sign"),
        F.lit(1).alias("_one"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(f"_v_{o}") for o, c in sums.items()],
    )
    w = Window.partitionBy(*keys, "_bkt").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    u = p.unionByName(q).withColumns({f"_s_{c}": F.sum(c).over(w) for c in ["_one", *[f"_v_{o}" for o in sums]]})
    u = u.where(F.col("_l").isNotNull()).select("_l.*", *[(F.col("_sign") * F.col(c)).alias(c) for c in u.columns if c.startswith("_s_")])
    g = u.groupBy(*cols).agg(F.sum("_s__one").alias(count), *[F.sum(f"_s__v_{o}").alias(o) for o in sums])
    return g.withColumns({o: F.when(F.col(count) > 0, F.col(o)) for o in sums})


def next_event_within(
    snapshots: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    snap_ts: str,
    event_ts: str,
    horizon_seconds: int,
    out: str = "label",
) -> DataFrame:
    """1 when some event of the same key happens strictly after the
    snapshot and no later than snapshot + horizon, else 0.

    Union both sides and take min(event time) over a following range frame on
    microseconds: one sort instead of a join fan-out. A key's rows are split into
    time buckets of four horizons; an event that a snapshot of the bucket before its own
    may reach goes there too, so a snapshot finds all it may reach in its own bucket."""
    horizon = horizon_seconds * 1_000_000
    bucket = lambda us: F.floor(us / (4 * horizon))
    t = _epoch_us(F.col("_t"))
    s = snapshots.withColumn("_is_snap", F.lit(True)).withColumn("_t", F.col(snap_ts)).withColumn("_bkt", bucket(t))
    e = events.select(*keys, F.col(event_ts).alias("_t")).withColumn("_is_snap", F.lit(False))
    e = e.withColumn("_bkt", F.explode(F.sequence(bucket(t - horizon), bucket(t))))
    u = s.unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bkt").orderBy(t).rangeBetween(1, horizon)
    nxt = F.min(F.when(~F.col("_is_snap"), F.col("_t"))).over(w)
    return u.withColumn("next_event_ts", nxt).where(F.col("_is_snap")).withColumn(out, F.col("next_event_ts").isNotNull().cast("int")).drop("_is_snap", "_t", "_bkt")


def best_match(
    left: DataFrame,
    candidates: DataFrame,
    left_key: str,
    cand_id: str,
    tiers: Sequence[tuple[str, str]],
) -> DataFrame:
    """Nearest candidate by tiered score without a cross join.

    ``tiers`` = [(left_col, cand_col), ...] from most to least specific; the
    score is the index of the first tier whose attribute matches (len(tiers)
    when none does); ties go to the smallest candidate id. The winner of
    each tier is min(id) per attribute value — a tiny grouped table — so the
    plan is one equi join per tier, never a left x candidates product."""
    out = left
    picks = []
    for i, (lc, cc) in enumerate(tiers):
        best = candidates.groupBy(F.col(cc).alias(f"_t{i}")).agg(F.min(cand_id).alias(f"_c{i}"))
        out = out.join(best, out[lc] == best[f"_t{i}"], "left").drop(f"_t{i}")
        picks.append(i)
    # Fallback when no tier matches: the globally smallest id (one scalar).
    global_min = candidates.agg(F.min(cand_id)).first()[0]
    chosen = F.coalesce(*[F.col(f"_c{i}") for i in picks], F.lit(global_min))
    score = F.coalesce(*[F.when(F.col(f"_c{i}").isNotNull(), F.lit(i)) for i in picks], F.lit(len(tiers)))
    return out.withColumn("match_id", chosen).withColumn("match_score", score).drop(*[f"_c{i}" for i in picks])


def rank_to_rank(left: DataFrame, right: DataFrame, group: str, left_rank: Column, right_order: Sequence[Column], out_rank: str = "_rk") -> DataFrame:
    """Pick the k-th member of ``right`` within ``group`` for each left
    row, k given by ``left_rank`` (1-based): number the right side per group
    and equi join on (group, rank)."""
    w = Window.partitionBy(group).orderBy(*right_order)
    r = right.withColumn(out_rank, F.row_number().over(w))
    return left.withColumn(out_rank, left_rank).join(r, [group, out_rank], "inner").drop(out_rank)
