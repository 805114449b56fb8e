"""The stockout model: labels and trees from fewer bytes, the same as by their definitions; tied scores are ranked in ranges."""

import datetime as dt
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from storelake.operators import joins, ml
from storelake.plans import analytics
from storelake.plans.registry import ORACLES

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"


@pytest.fixture
def lines(spark, tmp_path):
    """Movements with times of day, equal times, and keys and quantities that are NULL."""
    r = random.Random(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(40), hours=r.choice([0, 0, 7, 23]))
    rows = [(k, 1 + k % 3, r.randrange(4), r.randrange(3), float(r.randrange(1, 9)), r.choice("RNA"), at()) for k in range(600)]
    rows += [(900, 1, None, 1, 3.0, "N", at()), (901, 1, 2, None, 3.0, "R", at()), (902, 1, 2, 1, None, "N", at())]
    spark.createDataFrame(rows, LINE).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_labels_from_snapshots_equal_the_sql(spark, lines):
    snaps = analytics.staged_snapshots(spark, lines)
    got = analytics.stockout_labels(spark, lines, snaps=snaps.drop("net"), empty=ml.staged(analytics.first_empty(spark, lines, snaps), "empty"))
    assert {"balance", "demand_30d"} <= {*got.columns}
    got = {tuple(r) for r in got.select("store_id", "product_id", "day", "label").dropna().collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{lines}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT store_id, product_id, day, label FROM ({ORACLES['M32']})").fetchall()
    want = {r for r in want if None not in r}
    assert got == want and {r[3] for r in want} == {0, 1}
    base, whole = analytics.with_rates(snaps.drop("net")), analytics.snapshot_features(spark, lines)
    assert whole.select(base.columns).exceptAll(base).count() == 0 == base.exceptAll(whole.select(base.columns)).count()


def test_trees_of_cells_are_those_of_rows(spark):
    r = random.Random(7)
    rows = [(k, r.randrange(9), float(r.randrange(400)), 0.5, "test" if k % 5 == 0 else "train") for k in range(1500)]
    x = spark.createDataFrame(rows, "id long, a long, b double, c double, split string")
    x = x.withColumn("y", ((F.col("a") > 5) != (F.col("b") % 50 > 30)).cast("int"))
    feats = ["a", "b", "c"]
    known = {}
    for by_cell in (False, True):
        model, metrics = ml.train_classifier(x, feats, "y", max_iter=5, max_depth=4, by_cell=by_cell)
        unknown = spark.createDataFrame([(2000, None, 3.0, None)], "id long, a long, b double, c double")  # to the right at each border
        scored = ml.score(model, x.select("id", *feats).unionByName(unknown), feats, "p", keep=["id"])
        assert scored.columns == ["id", "prediction", "p"]
        known[by_cell] = {s.id: s.p for s in scored.collect()}, {m.name: m.value for m in metrics.collect()}
    assert known[True][0] == pytest.approx(known[False][0]) and len(known[True][0]) == 1501
    assert known[True][1] == pytest.approx(known[False][1])


def test_no_more_rows_to_train_on_than_cells(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: (seen.append((df.count(), df.agg(F.sum("_rows")).first()[0])), fit(self, df))[1])
    x = spark.range(20_000).select((F.col("id") / 7).alias("a"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 9 == 0, "test").otherwise("train").alias("split"))
    ml.train_classifier(x, ["a"], "y", max_iter=2, max_depth=2, by_cell=True)
    assert seen == [(64, x.where("split = 'train'").count())]  # all values differ: 32 bins by 2 labels


def test_borders_are_midpoints_or_equal_shares():
    assert ml.borders([3.0, 1.0, 1.0, float("nan")], 32) == [2.0]
    assert ml.borders([4.0], 32) == []
    assert ml.borders([float(k) for k in range(100)], 4) == [24.5, 49.5, 74.5]


def test_tied_scores_are_ranked_in_ranges(spark, tmp_path, monkeypatch):
    """One score for all rows: the ranges still divide them, and the ranks are those of the whole order."""
    rows = [(k, 1, k, k % 7, 5.0, "R" if k % 11 == 0 else "N", dt.datetime(2024, 1, 1 + k % 20)) for k in range(3000)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    train, staged, ranges = ml.train_classifier, ml.staged, []

    def watched(df, name):
        out = staged(df, name)
        ranges.extend(out.groupBy("_range").count().collect() if name == "scored" else [])
        return out

    monkeypatch.setattr(ml, "train_classifier", lambda *a, **k: train(*a, **(k | {"max_iter": 2, "max_depth": 2})))
    monkeypatch.setattr(ml, "staged", watched)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = analytics.m34_stockout_model(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    want = sorted(got, key=lambda r: (-r.stockout_probability, r.store_id, r.product_id))
    assert [r.risk_rank for r in want] == [*range(1, 3001)]
    assert len({r.stockout_probability for r in got}) < 5
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 1500


def test_staging_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before = files()
    out = ml.staged(spark.range(5000).groupBy((F.col("id") % 500).alias("k")).agg(F.sum("id").alias("s")), "some")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 500 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_next_event_across_buckets(spark):
    """Buckets hold four horizons; by definition, with events on both sides of their borders and at the horizon itself."""
    r, h = random.Random(9), 3 * 86400
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.choice([h // 3 * r.randrange(60), r.randrange(20 * h)]), microseconds=r.choice([0, 1, 999_999]))
    snaps, events = [(r.randrange(4), at()) for _ in range(300)], [(r.randrange(4), at()) for _ in range(60)] + [(1, None)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, t timestamp_ntz")
    got = joins.next_event_within(frame(snaps), frame(events), ["k"], "t", "t", h).collect()
    after = lambda k, t: min((e for j, e in events if j == k and e and t < e <= t + dt.timedelta(seconds=h)), default=None)
    assert sorted((x.k, x.t, x.next_event_ts, x.label) for x in got if x.label) == sorted((k, t, e, 1) for k, t in snaps if (e := after(k, t)))
    assert len(got) == 300
