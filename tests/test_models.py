"""Trainers read features that were computed once; the recursive forecast equals its definition."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from storelake.operators import ml
from storelake.plans import analytics


def test_training_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def count(v):
        seen.add(1)
        return float(v)

    rows = [(k, float(k % 10), int(k % 10 > 4), "test" if k % 7 == 0 else "train") for k in range(200)]
    x = spark.createDataFrame(rows, "id long, v double, y int, split string").withColumn("v", count.asNondeterministic()("v"))
    model, metrics = ml.train_classifier(x, ["v"], "y", max_iter=2, max_depth=2)
    assert {r.name: r.value for r in metrics.collect()}["auc"] == 1.0
    assert seen.value == 200


def test_history_row_gives_the_features_of_the_next_day(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    units = [(k * 7) % 11 for k in range(40)]
    rows = [(1, 1, day(k), u) for k, u in enumerate(units)] + [(1, None, day(0), 1)] + [(2, 1, day(k), 5) for k in (0, 9)]
    x = analytics.last_days(spark.createDataFrame(rows, "store_id long, product_id long, sale_date date, units long"))
    got = {r.store_id: r for r in x.withColumns(analytics.history_features(F.col("_hist"))).collect()}
    assert got.keys() == {1, 2} and got[1]["_last"] == day(39) and len(got[1]["_hist"]) == 28
    back = units[::-1]
    for n in (1, 7, 14, 28):
        assert got[1][f"lag_{n}"] == back[n - 1]
    for n in (7, 14, 28):
        assert got[1][f"roll_mean_{n}"] == pytest.approx(statistics.fmean(back[:n]))
    assert got[1].roll_std_14 == pytest.approx(statistics.stdev(back[:14]))
    assert (got[2].lag_1, got[2].lag_7, got[2].roll_mean_7, got[2].roll_std_14) == (5.0, None, 5.0, 0.0)


def test_shuffles_grow_with_the_tables(spark, tmp_path, monkeypatch):
    from storelake import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(20_000).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(session, "PARTITION_BYTES", 1000)
    try:
        session.size_shuffles(spark, str(tmp_path), ["orders", "absent"])
        assert int(spark.conf.get(key)) > 8
        session.size_shuffles(spark)
        assert spark.conf.get(key, None) is None
        spark.conf.set(key, "17")  # the session's own number stays
        session.size_shuffles(spark, str(tmp_path), ["orders"])
        assert spark.conf.get(key) == "17"
    finally:
        spark.conf.unset(key)
