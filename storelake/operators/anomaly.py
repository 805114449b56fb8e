"""Series anomaly scoring.

Our definition of the KQL ``series_decompose_anomalies(v, 1.5, -1, 'avg')``
call (the reference shows only the call): per key, hours in order, i = 0..n-1.
For p in (24, 168) with n >= 2p take corr(v, lag(v, p)); the season is the p
with the largest corr when that is >= 0.6, else none. baseline = mean(v) +
(season ? mean of (v - mean) over rows with the same i mod p : 0).
r = v - baseline; q10/q90 are exact percentiles of r per key, s = q90 - q10;
score = (r - q90)/s above q90, (r - q10)/s below q10, else 0 (0 when s = 0);
flag = sign(score) when |score| >= threshold.

Everything is window/aggregate SQL on one row per key-hour (already reduced
by a partial aggregation from the raw events), so the per-key partitions are
bounded by the number of hours, not by the raw row count. Correlations and
percentiles are windows too: the series is shuffled once and sorted three times.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEASONS = (24, 168)
MIN_CORR = 0.6

# Severity thresholds on |score| and their display rank.
SEVERITY = (("critical", 3.0, 1), ("high", 2.0, 2), ("medium", 1.5, 3))


def series_anomalies(df: DataFrame, keys: Sequence[str], ts: str, value: str, threshold: float = 1.5) -> DataFrame:
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(ts)
    wk = Window.partitionBy(*keys)
    x = df.select(*keys, ts, F.col(value).cast("double").alias("v"))
    x = x.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(wk)).withColumn("mean", F.avg("v").over(wk))
    for p in SEASONS:
        x = x.withColumn(f"lag{p}", F.lag("v", p).over(w))
    def safe_corr(p):
        # Pearson r over the pairs where the lag exists; NULL (not an ANSI
        # division error) when either side is constant.
        v = F.when(F.col(f"lag{p}").isNotNull(), F.col("v"))
        return F.try_divide(F.covar_samp(v, F.col(f"lag{p}")).over(wk), F.stddev_samp(v).over(wk) * F.stddev_samp(F.col(f"lag{p}")).over(wk))

    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))  # a series without a key has no season and no spread
    for p in SEASONS:
        x = x.withColumn(f"c{p}", F.when(known, safe_corr(p)))
    ok = {p: (F.col("n") >= 2 * p) & F.col(f"c{p}").isNotNull() & (F.col(f"c{p}") >= MIN_CORR) for p in SEASONS}
    season = F.when(ok[24] & ~(ok[168] & (F.col("c168") > F.col("c24"))), F.lit(24)).when(ok[168], F.lit(168))
    x = x.withColumn("season", season)
    for p in SEASONS:
        x = x.withColumn(f"s{p}", F.avg(F.col("v") - F.col("mean")).over(Window.partitionBy(*keys, F.pmod(F.col("i"), F.lit(p)))))
    seasonal = F.when(F.col("season") == 24, F.col("s24")).when(F.col("season") == 168, F.col("s168")).otherwise(F.lit(0.0))
    x = x.withColumn("baseline", F.col("mean") + seasonal).withColumn("r", F.col("v") - F.col("baseline"))
    for c, at in (("q10", 0.1), ("q90", 0.9)):
        x = x.withColumn(c, F.when(known, F.percentile("r", at).over(wk)))
    x = x.withColumn("spread", F.col("q90") - F.col("q10"))
    score = (
        F.when(F.col("spread") <= 0, F.lit(0.0))
        .when(F.col("r") > F.col("q90"), (F.col("r") - F.col("q90")) / F.col("spread"))
        .when(F.col("r") < F.col("q10"), (F.col("r") - F.col("q10")) / F.col("spread"))
        .otherwise(F.lit(0.0))
    )
    x = x.withColumn("score", score)
    x = x.withColumn("flag", F.when(F.abs("score") >= threshold, F.signum("score").cast("int")).otherwise(F.lit(0)))
    sev = F.when(F.abs("score") >= SEVERITY[0][1], F.lit(SEVERITY[0][0])).when(F.abs("score") >= SEVERITY[1][1], F.lit(SEVERITY[1][0])).when(
        F.abs("score") >= SEVERITY[2][1], F.lit(SEVERITY[2][0])
    ).otherwise(F.lit("low"))
    rank = F.when(F.abs("score") >= SEVERITY[0][1], F.lit(1)).when(F.abs("score") >= SEVERITY[1][1], F.lit(2)).when(F.abs("score") >= SEVERITY[2][1], F.lit(3)).otherwise(F.lit(4))
    return x.select(*keys, ts, F.col("v").alias("actual"), "baseline", "score", "flag", sev.alias("severity"), rank.alias("severity_rank"), "season")


def alerts(frames: dict[str, DataFrame], entity_type: str, ts: str = "hour") -> DataFrame:
    """Union of detector outputs (already keyed by ``entity_id``) into
    one alert schema with a deterministic sha256 id; flagged rows only."""
    out = None
    for metric, df in frames.items():
        part = df.where(F.col("flag") != 0).select(
            F.sha2(F.concat_ws("|", F.lit(metric), F.col("entity_id").cast("string"), F.col(ts).cast("string")), 256).alias("alert_id"),
            F.lit(metric).alias("metric_type"),
            F.lit(entity_type).alias("entity_type"),
            F.col("entity_id").cast("string").alias("entity_id"),
            F.col(ts).alias("time_window"),
            "baseline",
            "actual",
            "score",
            "severity",
            "severity_rank",
        )
        out = part if out is None else out.unionByName(part)
    return out
