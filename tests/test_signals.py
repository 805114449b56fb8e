"""PJ04 sums the days before the latest signals and balances only the others; its rows are those of the SQL."""

import datetime as dt
import random

import duckdb
import pytest

from storelake.operators import windows
from storelake.plans import named
from storelake.plans.reaimed import ORACLES

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"
DAY = dt.datetime(2024, 3, 1)


def _rows(kind):
    r = random.Random(3)
    at = lambda most: DAY - dt.timedelta(days=r.randrange(*most), minutes=r.choice([0, 3, 20, 400]))
    rows = [(k, 1, r.randrange(30), r.randrange(4), float(r.randrange(1, 30)), r.choice("RN"), at((0, 200))) for k in range(800)]
    if kind == "midnight":  # the 30 minutes reach into the day before
        rows = [(*x[:6], x[6] - dt.timedelta(days=1)) for x in rows]
        rows += [(1000 + k, 1, 50 + k, 1, 5.0, "N", DAY + dt.timedelta(minutes=m)) for k, m in enumerate([-40, -20, -5, 2, 2, 6])]
    if kind == "long ago":  # returns alone, to pairs well in stock, for the last 90 days
        rows = [(*x[:6], x[6] - dt.timedelta(days=100)) for x in rows]
        rows += [(2000 + k, 1, r.randrange(30), r.randrange(4), 900.0, "R", at((1, 90))) for k in range(200)]
    if kind == "none":
        rows = [(*x[:4], 900.0, "R", x[6]) for x in rows]
    if kind == "nulls":
        rows += [(3000, 1, None, 1, 3.0, "N", DAY), (3001, 1, 2, None, 3.0, "N", DAY), (3002, 1, 2, 1, None, "N", DAY), (3003, 1, None, 1, 8.0, "R", DAY - dt.timedelta(days=9))]
        rows += [(3004, 1, 60, 1, None, "N", DAY), (3005, 1, 61, 1, 4.0, "N", None), (3006, 1, 61, 1, 4.0, "N", DAY)]
    return rows


@pytest.mark.parametrize("kind", ["days", "midnight", "long ago", "none", "nulls"])
def test_latest_signals_equal_those_of_all_days(spark, tmp_path, kind):
    spark.createDataFrame(_rows(kind), LINE).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in named.pj04_replenishment_signals(spark, str(tmp_path)).collect()]
    whole = named.recent(named._signals(spark, str(tmp_path)), "event_ts", 1800).collect()
    part = named.recent(named.latest_signals(spark, str(tmp_path), 1800), "event_ts", 1800).collect()
    assert sorted(map(repr, part)) == sorted(map(repr, whole))
    if kind != "nulls":  # DuckDB drops null keys from joins and has null times last
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert got == con.execute(ORACLES["PJ04"]).fetchall()
    assert (not got) == (kind == "none")


def test_only_the_last_days_are_balanced(spark, tmp_path, monkeypatch):
    spark.createDataFrame(_rows("days"), LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, balance = [], windows.running_balance
    monkeypatch.setattr(windows, "running_balance", lambda led, *a, **k: (seen.append(led.count()), balance(led, *a, **k))[1])
    assert named.pj04_replenishment_signals(spark, str(tmp_path)).count() > 0
    assert len(seen) == 1 and 0 < seen[0] < 80
