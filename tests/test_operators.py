"""Fixture tests for the operators whose plan differs from the naive form:
the segmented / bucketed variants must equal the single-window answer."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from storelake.functions import money
from storelake.operators import aggs, joins, windows


def ts(s):
    return dt.datetime.fromisoformat(s)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_running_sum_segmented_equals_plain(spark):
    data = [(1, ts("2024-01-01 10:00"), "a", 5), (1, ts("2024-01-01 10:00"), "b", -3), (1, ts("2024-01-02 09:00"), "c", -4),
            (1, ts("2024-01-05 00:00"), "d", 7), (2, ts("2024-01-01 00:00"), "e", 1), (2, ts("2024-01-03 00:00"), "f", -1)]
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, id string, q long").repartition(3)
    plain = windows.running_balance(df, ["k"], "t", "id", "q")
    seg = windows.running_balance(df, ["k"], "t", "id", "q", bucket=F.to_date("t"))
    assert rows(plain, "id", "balance") == rows(seg, "id", "balance")
    assert dict(rows(seg, "id", "balance")) == {"a": 5, "b": 2, "c": -2, "d": 5, "e": 1, "f": 0}


def test_threshold_crossing_first_per_day(spark):
    data = [(1, ts("2024-01-01 10:00"), "a", 5), (1, ts("2024-01-01 11:00"), "b", -5), (1, ts("2024-01-01 12:00"), "c", 3),
            (1, ts("2024-01-01 13:00"), "d", -4), (1, ts("2024-01-02 09:00"), "e", 2), (1, ts("2024-01-02 10:00"), "f", -3)]
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, id string, q long")
    bal = windows.running_balance(df, ["k"], "t", "id", "q")
    out = windows.threshold_crossings(bal, ["k"], "t", "id", "q")
    got = rows(out, "event_date", "id", "last_known_quantity")
    assert got == [(dt.date(2024, 1, 1), "b", 5), (dt.date(2024, 1, 2), "f", 3)]


def test_sessionize_gap_boundary_and_segmented(spark):
    base = ts("2024-01-01 23:00")
    gap = 1800
    data = [(1, base, 1), (1, base + dt.timedelta(seconds=gap), 2),  # exactly T: same session
            (1, base + dt.timedelta(seconds=2 * gap + 1), 3),  # T+1: new session (crosses midnight)
            (2, base, 4), (1, base + dt.timedelta(days=2), 5)]
    df = spark.createDataFrame(data, "u long, t timestamp_ntz, id long").repartition(4)
    plain = windows.sessionize(df, ["u"], "t", "id", gap)
    seg = windows.sessionize(df, ["u"], "t", "id", gap, bucket=F.to_date("t"))
    assert rows(plain, "id", "session_no") == rows(seg, "id", "session_no")
    assert dict(rows(seg, "id", "session_no")) == {1: 1, 2: 1, 3: 2, 4: 1, 5: 3}


def test_bucketed_row_number_equals_global(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.pmod(F.col("id") * 7919, F.lit(97))).alias("v")).repartition(5)
    exp = df.withColumn("r", F.row_number().over(Window.orderBy(F.desc("v"), "id")))
    got = windows.bucketed_row_number(df, [], [F.desc("v"), F.asc("id")], -F.floor(F.col("v") / 10), "r")
    assert rows(exp, "id", "r") == rows(got, "id", "r")


def test_range_join_matches_brute_force(spark):
    left = spark.createDataFrame(
        [(1, 1, ts("2024-01-01 00:00"), ts("2024-01-03 00:00")), (2, 1, ts("2024-01-05 12:00"), ts("2024-01-05 13:00")), (3, 2, ts("2024-01-01 00:00"), ts("2024-01-01 00:00"))],
        "lid long, k long, s timestamp_ntz, e timestamp_ntz",
    )
    right = spark.createDataFrame(
        [(10, 1, ts("2024-01-01 00:00")), (11, 1, ts("2024-01-03 00:00")), (12, 1, ts("2024-01-03 00:00:01")), (13, 1, ts("2024-01-05 12:30")), (14, 2, ts("2024-01-01 00:00")), (15, 3, ts("2024-01-01 00:00"))],
        "rid long, k long, t timestamp_ntz",
    )
    got = joins.range_join(left, right, ["k"], "s", "e", "t", bucket_seconds=3600)
    brute = left.join(right, "k").where((F.col("t") >= F.col("s")) & (F.col("t") <= F.col("e")))
    assert rows(got, "lid", "rid") == rows(brute, "lid", "rid") == [(1, 10), (1, 11), (2, 13), (3, 14)]
    lj = joins.range_join(left, right.where(F.col("rid") != 13), ["k"], "s", "e", "t", bucket_seconds=3600, how="left", left_id=["lid"])
    assert (2, None) in rows(lj, "lid", "rid")


def test_next_event_within_strict_after(spark):
    snaps = spark.createDataFrame([(1, ts("2024-01-01 00:00")), (2, ts("2024-01-01 00:00"))], "k long, t timestamp_ntz")
    ev = spark.createDataFrame([(1, ts("2024-01-01 00:00")), (1, ts("2024-01-04 00:00")), (2, ts("2024-01-04 00:00:01"))], "k long, t timestamp_ntz")
    out = joins.next_event_within(snaps, ev, ["k"], "t", "t", 3 * 86400)
    assert rows(out, "k", "label") == [(1, 1), (2, 0)]


def test_best_match_tiers_without_cross_join(spark):
    cust = spark.createDataFrame([(1, 10, 100), (2, 11, 100), (3, 12, 200)], "c long, nation long, region long")
    cand = spark.createDataFrame([(7, 10, 100), (5, 10, 100), (9, 13, 100), (3, 14, 300)], "s long, nation long, region long")
    out = joins.best_match(cust, cand, "c", "s", [("nation", "nation"), ("region", "region")])
    assert rows(out, "c", "match_id", "match_score") == [(1, 5, 0), (2, 5, 1), (3, 3, 2)]
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_money_exact(spark):
    df = spark.createDataFrame([(12345, 725, 100), (1, 50, 100), (999, 800, 50), (1000, 800, 0)], "c long, bps long, m long")
    out = df.select(money.line_tax_cents("c", "bps", "m").alias("t"), money.cents_to_text("c").alias("txt"), money.cents_to_decimal("c").alias("d"))
    got = [(r.t, r.txt, str(r.d)) for r in out.collect()]
    # floor((12345*725*100 + 500000)/1e6) = floor(895.5125...) = 895
    assert got == [(895, "123.45", "123.4500"), (0, "0.01", "0.0100"), (40, "9.99", "9.9900"), (0, "10.00", "10.0000")]


def test_latest_per_key_tiebreak(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01"), "a", 1), (1, ts("2024-01-01"), "b", 2), (2, ts("2024-01-01"), "c", 3)], "k long, t timestamp_ntz, id string, v long")
    out = aggs.latest_per_key(df, ["k"], ["t", "id"], ["v"])
    assert rows(out, "k", "v") == [(1, 2), (2, 3)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "k long, t timestamp_ntz, id string, q long")
    assert windows.running_balance(df, ["k"], "t", "id", "q", bucket=F.to_date("t")).count() == 0
    assert windows.sessionize(df, ["k"], "t", "id", 60, bucket=F.to_date("t")).count() == 0


def test_overcrowded_zones(spark):
    """AL04 on rows: a crowded zone, a slow zone and a quiet one."""
    from storelake.plans.named import overcrowded

    rows = [(1, "a", 10.0)] * 51 + [(1, "b", 601.0)] + [(2, "a", 600.0)] * 50
    got = overcrowded(spark.createDataFrame(rows, "store_id long, zone string, dwell_seconds double"))
    assert sorted((r.store_id, r.zone, r.customers) for r in got.collect()) == [(1, "a", 51), (1, "b", 1)]


def test_recent_minutes_bound_equals_truncated_filter(spark):
    from pyspark.sql import functions as F

    from storelake.plans.named import recent_minutes

    df = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:30' + make_interval(0, 0, 0, 0, 0, 0, id * 17) AS ts FROM range(600)")
    m = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    last = df.agg(F.max(m)).first()[0]
    want = df.where(m > F.lit(last) - F.expr("INTERVAL 3600 SECOND"))
    assert sorted(recent_minutes(df, "ts", 3600).collect()) == sorted(want.collect())


def test_exact_percentiles_equal_percentile(spark):
    from pyspark.sql import functions as F

    from storelake.operators import aggs

    df = spark.range(200000).select(F.when(F.col("id") < 300, F.col("id") % 3 + 2).otherwise(F.col("id") % 2).alias("g"), F.when(F.col("id") % 11 != 0, F.pow(F.rand(3), 3) * 1000).alias("v"), (F.col("id") % 5).alias("w"))
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    want = {"a": ("v", 0.5), "b": ("v", 0.9), "c": ("w", 0.33), "d": ("v", 0.0), "e": ("v", 1.0)}
    for group in ([], ["g"]):
        by_group = lambda r: repr(r.asDict().get("g"))
        got = sorted(aggs.exact_percentiles(df, group, want).collect(), key=by_group)
        exp = sorted(df.groupBy(*group).agg(*(F.percentile(c, p).alias(k) for k, (c, p) in want.items())).collect(), key=by_group)
        assert len(got) == len(exp)
        for x, y in zip(got, exp, strict=True):
            assert all(a is b or abs(a - b) < 1e-9 for a, b in zip(x, y, strict=True))


def test_segmented_lag_and_as_of_equal_plain_windows(spark):
    """One key holds half of the rows; some values and timestamps tie or are null."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from storelake.operators import windows

    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") % 13).cast("long").alias("k"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, (id * 7919) % 900000)").alias("ts"),
        "id",
        F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("v"),
    )
    df = df.withColumn("k", F.when(F.col("k") != 3, F.col("k")))
    w = Window.partitionBy("k").orderBy("ts", "id")
    got = windows.previous(df, ["k"], ["ts", "id"], "v", "p").select("id", "p")
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(df.select("id", F.lag("v").over(w).alias("p")).collect(), key=lambda r: r.id)
    sign = F.when(F.col("id") % 4 == 0, F.col("id"))
    got = windows.last_at_or_before(df, ["k"], ["ts", "id"], sign, "s", "ts").select("id", "s")
    want = df.select("id", F.last(sign, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def _intervals(spark, seed=7):
    """Intervals over several buckets, a key with half of all points, NULL bounds and keys, one that ends early."""
    import random

    rnd = random.Random(seed)
    base = ts("2024-01-01 00:00")
    at = lambda: base + dt.timedelta(minutes=rnd.randrange(0, 60 * 72))
    left = []
    for i in range(60):
        s = at()
        left.append((i, rnd.choice([1, 1, 2, 3]), s, s + dt.timedelta(minutes=rnd.choice([0, 5, 300, 3000]))))
    left += [(100, None, at(), at()), (101, 1, None, at()), (102, 1, at(), None), (103, 1, ts("2024-01-02 00:00"), ts("2024-01-01 00:00")), (104, 9, base, base)]
    right = [(rnd.choice([1, 1, 2, 3]), at(), rnd.randrange(-5, 9)) for _ in range(300)]
    right += [(1, left[0][2], 3), (None, at(), 1), (1, None, 1), (2, at(), None)]
    lf = spark.createDataFrame(left, "id long, k long, s timestamp_ntz, e timestamp_ntz").repartition(4)
    return left, right, lf, spark.createDataFrame(right, "k long, t timestamp_ntz, v long").repartition(3)


def _hits(row, right):
    _, k, s, e = row
    return [] if None in (k, s, e) else [p for p in right if p[0] == k and p[1] is not None and s <= p[1] <= e]


def test_range_aggregate_equals_brute_force(spark):
    left, right, lf, rf = _intervals(spark)
    got = joins.range_aggregate(lf, rf, ["k"], "s", "e", "t", "n", {"total": "v"}, bucket_seconds=6 * 3600)
    want = []
    for row in left:
        hits = _hits(row, right)
        want.append((row[0], len(hits), sum(p[2] or 0 for p in hits) if hits else None))
    assert rows(got, "id", "n", "total") == sorted(want)
    none = joins.range_aggregate(lf, rf.limit(0), ["k"], "s", "e", "t", "n", {"total": "v"})
    assert {(r.n, r.total) for r in none.collect()} == {(0, None)} and none.count() == len(left)
    assert joins.range_aggregate(lf.limit(0), rf, ["k"], "s", "e", "t", "n", {"total": "v"}).count() == 0


def test_left_range_join_equals_brute_force(spark):
    left, right, lf, rf = _intervals(spark, seed=8)
    got = joins.range_join(lf, rf, ["k"], "s", "e", "t", bucket_seconds=6 * 3600, how="left", left_id=["id"])
    want = [(row[0], str(p and p[1]), p and p[2]) for row in left for p in (_hits(row, right) or [None])]
    assert sorted(((r.id, str(r.t), r.v) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_lifecycle_checks_find_what_was_planted(spark):
    """A clean shipment, one that lacks a status, one that goes backwards, cargo that stayed and cargo from nowhere."""
    from storelake.operators import quality as q

    start = ts("2024-01-01 00:00")
    st = [(1, s, start + dt.timedelta(hours=i)) for i, s in enumerate(q.STATUSES)]
    st += [(2, s, start + dt.timedelta(hours=i)) for i, s in enumerate(q.STATUSES) if s != "UNLOADING"]
    st += [(3, s, start + dt.timedelta(hours=-i)) for i, s in enumerate(q.STATUSES)]
    st += [(1, "LOADING", start + dt.timedelta(hours=1))]  # a repeated row is no violation
    cargo = [(1, 7, 5, "LOAD"), (1, 7, 2, "UNLOAD"), (1, 7, 3, "UNLOAD"), (2, 7, 5, "LOAD"), (2, 7, 4, "UNLOAD"), (3, 8, 1, "UNLOAD")]
    s = spark.createDataFrame(st, "shipment_id long, status string, event_ts timestamp_ntz")
    c = spark.createDataFrame(cargo, "shipment_id long, product_id long, quantity long, action string")
    assert dict(rows(q.lifecycle_checks(s, c), "check", "violations")) == {"all_six_statuses": 1, "statuses_in_order": 1, "unload_has_load": 1, "load_is_unloaded": 1}
    assert {v for _, v in rows(q.lifecycle_checks(s.limit(0), c.limit(0)), "check", "violations")} == {0}


def test_cluster_profile_labels_by_place(spark):
    from storelake.plans.analytics import cluster_profile

    data = [(i, 5.0 + i % 3, 50.0, 900.0 + i, 2) for i in range(10)] + [(20 + i, 100.0, 10.0 + i % 2, 300.0, 0) for i in range(10)] + [(40 + i, 400.0 + i, 1.0, 10.0, 1) for i in range(10)]
    x = spark.createDataFrame(data, "customer_id long, recency_days double, frequency double, monetary double, cluster int").repartition(4)
    got = rows(cluster_profile(x), "cluster_no", "cluster", "label", "customers", "median_monetary", "median_recency_days")
    assert got == [(1, 2, "Champions", 10, 904.5, 6.0), (2, 0, "Potential Loyalists", 10, 300.0, 100.0), (3, 1, "Lost", 10, 10.0, 404.5)]


def test_catalog_scan_reports_what_is_absent(spark):
    from storelake.sources import files as fs

    spark.range(4).createOrReplaceTempView("scan_here")
    assert fs.read_table(spark, "scan_nowhere") is None and fs.read_table(spark, "scan_here").count() == 4
    assert sorted(map(tuple, fs.catalog_scan(spark, ["scan_here", "scan_nowhere"]).collect())) == [("scan_here", True, 4), ("scan_nowhere", False, None)]


def test_series_scores_shuffle_each_series_once(spark):
    """M04 and M07 score a series from one shuffle and three sorts, without joining it with itself; seasons, exact
    quantiles and series without a key are scored as before."""
    import math

    from storelake.operators import anomaly

    hour = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    daily = [10.0 + 5 * math.sin(2 * math.pi * (n % 24) / 24) + (8.0 if n == 77 else 0.0) for n in range(120)]
    data = [("day", hour(n), v) for n, v in enumerate(daily)] + [("flat", hour(n), 2.0) for n in range(60)] + [("one", hour(0), 3.0)] + [(None, hour(n), float(n)) for n in range(5)]
    x = anomaly.series_anomalies(spark.createDataFrame(data, "entity_id string, hour timestamp_ntz, v double").repartition(3), ["entity_id"], "hour", "v")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity_id") == 1 and "Join" not in plan
    assert plan.count("Sort [") == 3
    got = {(r.entity_id, r.hour): r for r in x.collect()}
    assert len(got) == len(data)
    mean = sum(daily) / 120
    base = [mean + sum(daily[m] - mean for m in range(n % 24, 120, 24)) / 5 for n in range(120)]
    r = sorted(v - b for v, b in zip(daily, base, strict=True))
    q = lambda p: r[int(119 * p)] + (119 * p - int(119 * p)) * (r[int(119 * p) + 1] - r[int(119 * p)])
    for n, v in enumerate(daily):
        a = got["day", hour(n)]
        e, lo, hi = v - base[n], q(0.1), q(0.9)
        assert a.season == 24 and math.isclose(a.baseline, base[n], abs_tol=1e-9)
        if hi - lo > 1e-6:
            want = (e - hi) / (hi - lo) if e > hi else (e - lo) / (hi - lo) if e < lo else 0.0
            assert math.isclose(a.score, want, rel_tol=1e-6, abs_tol=1e-6)
    assert all((a.score, a.flag, a.season) == (0.0, 0, None) for (k, _), a in got.items() if k != "day")
