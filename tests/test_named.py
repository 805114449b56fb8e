"""Named queries over rows of their own."""

import datetime as dt

import duckdb

import __spark_entry__ as entry


def test_price_changes_from_a_price_of_zero(spark, tmp_path):
    """DP04: a recommendation for a product priced 0 counts like any other, in the bucket the SQL puts it."""
    at = dt.datetime(2024, 1, 1)
    props = lambda k: '{"k": %d}' % k
    data = [
        (1, at, 1, "signup", 0.0, props(10)),  # 0 to 0
        (2, at, 1, "signup", 0.0049, props(99)),  # 0 to 1 cent
        (3, at, 1, "signup", -0.0049, props(99)),  # 0 to -1 cent
        (4, at, 2, "signup", 10.0, props(10)),
        (5, at, 2, "signup", None, props(10)),
    ]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = {r.change_bucket: r.recommendations for r in entry.queries()["DP04"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(entry.oracle_sql()["DP04"]).fetchall())
    assert sum(got.values()) == 5 and got["Large Markdown (>20%)"] == 1
