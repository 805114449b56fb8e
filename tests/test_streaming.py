"""Streaming = batch: replay in several files (one per trigger), duplicate
replay, and the late-row split."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from storelake.streaming import runner as st

SF = "/root/testdata/sf0.001"


def _split_files(spark, base):
    e = spark.read.parquet(f"{SF}/events.parquet")
    days = [r[0] for r in e.select(F.to_date("ts")).distinct().orderBy(1).collect()]
    cut1, cut2 = days[len(days) // 3], days[2 * len(days) // 3]
    e.where(F.to_date("ts") < cut1).coalesce(1).write.parquet(f"{base}/f1")
    e.where((F.to_date("ts") >= cut1) & (F.to_date("ts") < cut2)).coalesce(1).write.parquet(f"{base}/f2")
    e.where(F.to_date("ts") >= cut2).coalesce(1).write.parquet(f"{base}/f3")
    return e


def _as_dir(spark, base, parts):
    """Gather the chosen part files into one replay folder, in order."""
    out = f"{base}/replay"
    for i, p in enumerate(parts):
        spark.read.parquet(f"{base}/{p}").coalesce(1).write.mode("append").parquet(out)
    return out


def test_multi_batch_window_aggregate_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="storelake-st-", dir="/tmp")
    e = _split_files(spark, base)
    src = _as_dir(spark, base, ["f1", "f2", "f3"])
    s = st.dir_stream(spark, src, e.schema, max_files=1).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    agg = s.groupBy(F.window("ts", "15 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    got = st.run_to_table(agg, "test-st03", mode="complete").select(F.col("w.start").cast("timestamp_ntz").alias("ws"), "event_type", "n")
    exp = e.groupBy(F.window("ts", "15 minutes").start.alias("ws"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_duplicate_replay_is_deduplicated(spark):
    base = tempfile.mkdtemp(prefix="storelake-st-", dir="/tmp")
    e = _split_files(spark, base)
    src = _as_dir(spark, base, ["f1", "f2", "f2", "f3"])  # f2 delivered twice
    s = st.dir_stream(spark, src, e.schema, max_files=1).withColumn("ts", F.col("ts").cast("timestamp"))
    d = s.withWatermark("ts", "3 days").dropDuplicatesWithinWatermark(["event_id"])
    got = st.run_to_table(d, "test-st08")
    assert got.count() == e.count()
    assert got.select("event_id").distinct().count() == e.count()


def test_batch_keyed_upsert_latest_wins(spark):
    base = tempfile.mkdtemp(prefix="storelake-st-", dir="/tmp")
    a = spark.createDataFrame([(1, "old"), (2, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "new")], "k long, v string")
    st.batch_keyed_upsert(a, 0, base)
    st.batch_keyed_upsert(b, 1, base)
    st.batch_keyed_upsert(b, 1, base)  # replayed batch rewrites itself
    got = dict((r.k, r.v) for r in st.latest_by_batch(spark.read.parquet(base), ["k"]).collect())
    assert got == {1: "new", 2: "x"}


def test_late_rows_are_kept_apart(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 10)), (2, dt.datetime(2024, 1, 1, 12))], "id long, ts timestamp_ntz")
    on_time, late = st.split_late(df, "ts", dt.datetime(2024, 1, 1, 11))
    assert [r.id for r in on_time.collect()] == [2]
    assert [r.id for r in late.collect()] == [1]


def _events(spark, rows):
    return spark.createDataFrame([(i, ts, u, "view", 1.0, "{}") for i, u, ts in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_latest_view_ignores_out_of_order_files(spark):
    """ST04: 10 Jan then 5 Jan for one user keeps 10 Jan."""
    from storelake.operators import aggs
    from storelake.plans.streams import latest_view

    base = st.run_folder(spark, "test-st04")
    a = _events(spark, [(1, 7, dt.datetime(2024, 1, 10)), (2, 8, dt.datetime(2024, 1, 1))])
    b = _events(spark, [(3, 7, dt.datetime(2024, 1, 5)), (4, 8, dt.datetime(2024, 1, 3))])
    cols = ["event_id", "ts", "event_type", "value", "props"]
    for part in (a, b):
        part.write.mode("append").parquet(f"{base}/in")
        view = latest_view(spark, st.dir_stream(spark, f"{base}/in", a.schema, max_files=None), base)
    assert {r.user_id: r.event_id for r in view.collect()} == {7: 1, 8: 4}
    batch = aggs.latest_per_key(a.unionByName(b), ["user_id"], ["ts", "event_id"], cols)
    assert sorted(view.select(*batch.columns).collect()) == sorted(batch.collect())


def test_late_marks_survive_restart_and_replay(spark):
    """ST09: each run of the stream is a restart; a replayed batch finds the same mark."""
    from storelake.plans.streams import mark_late

    base = st.run_folder(spark, "test-st09")
    a = _events(spark, [(1, 1, dt.datetime(2024, 1, 1, 10)), (2, 1, dt.datetime(2024, 1, 1, 12))])
    b = _events(spark, [(3, 1, dt.datetime(2024, 1, 1, 11)), (4, 1, dt.datetime(2024, 1, 1, 13))])
    for part in (a, b):
        part.write.mode("append").parquet(f"{base}/in")
        out = st.run_batches(st.dir_stream(spark, f"{base}/in", a.schema, max_files=None), base, mark_late)
    classes = lambda: {r.event_id: r["class"] for r in spark.read.parquet(out).collect()}
    assert classes() == {1: "on_time", 2: "on_time", 3: "late", 4: "on_time"}
    mark_late(b, 1, out)  # replay of the last batch
    assert classes() == {1: "on_time", 2: "on_time", 3: "late", 4: "on_time"} and spark.read.parquet(out).count() == 4


def test_fanout_replay_leaves_counts(spark):
    """ST07: a replayed batch rewrites its own folder."""
    from storelake.plans.streams import route_batch

    base = st.run_folder(spark, "test-st07")
    a = _events(spark, [(1, 1, dt.datetime(2024, 1, 1)), (2, 1, dt.datetime(2024, 1, 2))])
    route_batch(a, 0, base)
    route_batch(a, 0, base)
    assert spark.read.parquet(base).count() == 2


def test_incremental_views_over_files_equal_batch(spark):
    """ST03: parts of out-of-order files, one of them replayed, sum up to the batch result."""
    from storelake.plans.streams import merged_views, partial_views, view_rows

    base = st.run_folder(spark, "test-st03")
    a = _events(spark, [(1, 7, dt.datetime(2024, 1, 10, 9, 1)), (2, 8, dt.datetime(2024, 1, 1, 9, 2))])
    b = _events(spark, [(3, 7, dt.datetime(2024, 1, 1, 9, 2, 30)), (4, 8, dt.datetime(2024, 1, 10, 9, 1, 5))])
    minute = {"m": (F.lit(True), F.col("event_type"), F.date_trunc("minute", F.col("ts")), F.lit(1), F.col("value"))}
    for part in (a, b):
        part.write.mode("append").parquet(f"{base}/in")
        out = st.run_batches(st.dir_stream(spark, f"{base}/in", a.schema, max_files=None).select(view_rows(minute).alias("x")).select("x.*"), base, partial_views)
    partial_views(b.select(view_rows(minute).alias("x")).select("x.*"), 1, out)
    got = {(r.bucket, r.n, r.amount) for r in merged_views(spark, [out]).collect()}
    assert got == {(dt.datetime(2024, 1, 10, 9, 1), 2, 2.0), (dt.datetime(2024, 1, 1, 9, 2), 2, 2.0)}


def _alert_rows():
    """(event_id, store, zone, dwell, time): busy, long and quiet zones over half an hour, some rows late."""
    start, rows = dt.datetime(2024, 1, 1, 9, 0), []
    for i in range(300):
        store = i % 3
        rows.append((i, store, "a" if store < 2 else "b", 900.0 if store == 1 and (i // 3) % 4 else 10.0, start + dt.timedelta(seconds=(i * 7) % 600 if store == 0 else i * 6)))
    return rows


def _crowded_windows(rows):
    out = set()
    for minute in range(0, 60):
        end = dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=minute)
        by = {}
        for _, store, zone, dwell, ts in rows:
            if end - dt.timedelta(minutes=5) <= ts < end:
                by.setdefault(f"{store}|{zone}", []).append(dwell)
        out |= {(end, k, float(len(v))) for k, v in by.items() if len(v) > 50 or sum(v) / len(v) > 600}
    return out


def test_alerts_do_not_depend_on_batches(spark):
    """ST10: one batch and twenty batches of the same rows, late ones among them, give the alerts
    of the rules run at every full minute, each once."""
    from storelake.plans.streams import row_alerts, zone_alerts

    rows = _alert_rows()
    late = rows[50:60]  # come last
    expected = _crowded_windows(rows)
    assert len(expected) > 5 and len(expected - _crowded_windows(rows[:50] + rows[60:])) > 0
    receipts = [(i, 20000 + (i % 2) * 500, ts) for i, _, _, _, ts in rows]
    over = {(ts.replace(second=0) + dt.timedelta(minutes=1), str(i), float(c)) for i, c, ts in receipts if c > 20000}
    for n in (1, 20):
        base = st.run_folder(spark, f"test-st10-{n}")
        order = [r for r in rows if r not in late] + late
        for k in range(n):
            part = order[k * len(order) // n : (k + 1) * len(order) // n]
            spark.createDataFrame(part, "event_id long, store_id long, zone string, dwell_seconds double, event_ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{base}/z/in")
            again = part[:3] if k == n - 1 else []  # some rows are delivered twice
            spark.createDataFrame([receipts[r[0]] for r in part + again], "receipt_id long, total_cents long, event_ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{base}/r/in")
        zones = st.dir_stream(spark, f"{base}/z/in", "event_id long, store_id long, zone string, dwell_seconds double, event_ts timestamp_ntz")
        got = [tuple(r) for r in zone_alerts(zones, f"{base}/z").collect()]
        assert len(got) == len(set(got)) and set(got) == expected
        found = [tuple(r) for r in row_alerts("AL05", st.dir_stream(spark, f"{base}/r/in", "receipt_id long, total_cents long, event_ts timestamp_ntz"), f"{base}/r").collect()]
        assert len(found) == len(set(found)) and set(found) == over


def test_streams_import_alone():
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import storelake.plans.streams"], cwd=__file__.rsplit("/tests/", 1)[0], check=False).returncode == 0


def test_view_parts_are_merged_by_generations(spark):
    """Read cost stays flat: live parts grow with the logarithm of the batches, no rows are lost, and a
    replay changes nothing, whether its part was merged or not."""
    from storelake.plans.streams import VIEW_SCHEMA, summed
    from storelake.streaming import views

    base = st.run_folder(spark, "test-views")
    at = dt.datetime(2024, 1, 1)

    def batch(k):
        return spark.createDataFrame([("v", str(k % 3), at, 1, dt_decimal(k)), ("v", "all", at, 1, dt_decimal(1))], VIEW_SCHEMA).coalesce(1)

    def state():
        return sorted((r.key, r.n, int(r.amount)) for r in views.read_view(spark, base, VIEW_SCHEMA, summed).collect())

    assert state() == []
    n = 19
    for k in range(n):
        views.commit(batch(k), k, base, summed, fanout=3)
        assert len(views.live_parts(spark, base)) <= 2 * 3
    want = sorted([(str(m), len(range(m, n, 3)), sum(range(m, n, 3))) for m in range(3)] + [("all", n, n)])
    assert state() == want
    parts = views.live_parts(spark, base)
    assert sorted((e["first"], e["last"]) for e in parts) == [(0, 8), (9, 17), (18, 18)]
    for k in (0, 10, 18):
        views.commit(batch(k), k, base, summed, fanout=3)
    assert state() == want
    fs, p, _ = views._files(spark, f"{base}/parts")
    assert len(fs.listStatus(p)) <= len(parts) + 3  # superseded parts go


def dt_decimal(x):
    from decimal import Decimal

    return Decimal(x)


def test_lifecycles_pair_late_counterparts_and_time_out(spark):
    """ST05: a departure read before its arrival pairs, one read late pairs, an arrival without departure
    leaves once, and the state afterwards holds only what may still pair."""
    import json

    from storelake.plans.streams import lifecycle_batch, pair_lifecycles

    base = tempfile.mkdtemp(prefix="storelake-st-", dir="/tmp")
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    # shipments 0..59 arrive on their day; every third has no departure, every fifth departs in the batch before or after
    arrive = [[(i, day(i)) for i in range(b * 10, b * 10 + 10)] for b in range(6)]
    depart = [[] for _ in range(6)]
    for i in range(60):
        if i % 3:
            b = i // 10 + (-1 if i % 10 == 5 else 1 if i % 5 == 0 else 0)
            depart[min(5, max(0, b))].append((i, day(i + 2)))
    for b in range(6):
        spark.createDataFrame(arrive[b], "shipment_id long, arrival_ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{base}/a")
        spark.createDataFrame(depart[b], "shipment_id long, departure_ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{base}/d")
    a = st.dir_stream(spark, f"{base}/a", "shipment_id long, arrival_ts timestamp_ntz")
    b = st.dir_stream(spark, f"{base}/d", "shipment_id long, departure_ts timestamp_ntz")
    x = pair_lifecycles(a, b, "shipment_id", "arrival_ts", "departure_ts", within_days=3, late_days=12)
    out = f"{base}/out"
    w = x.writeStream.option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).foreachBatch(lambda df, bid: lifecycle_batch(df, bid, out)).start()
    w.awaitTermination()
    got = sorted((r.shipment_id, r.status) for r in spark.read.parquet(out).collect())
    mark = 59 - 12  # the slower side's newest row less the lateness; departures reach day 61
    want = [(i, "paired") for i in range(60) if i % 3] + [(i, "timed_out") for i in range(0, 60, 3) if i + 3 < mark]
    assert got == sorted(want)
    last = [json.loads(p.json) for p in w.recentProgress if p.stateOperators][-1]
    # arrivals of the last within + late days, departures of the last late days: the rest has left
    assert 0 < last["stateOperators"][0]["numRowsTotal"] <= (3 + 12 + 2) + (12 + 3)


def test_open_sessions_come_out_too(spark, tmp_path):
    """ST06: every session is out once, closed or still open at the end of the input, also when a second run goes on."""
    from storelake.plans.streams import sessions

    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    first = [(1, at(1, 0), 1), (2, at(1, 6), 1), (3, at(3, 0), 1), (4, at(5, 0), 2)]
    later = [(5, at(5, 6), 2), (6, at(9, 0), 1)]
    schema = "event_id long, ts timestamp_ntz, user_id long"
    base, src = f"{tmp_path}/run", f"{tmp_path}/in"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        return sorted(tuple(r) for r in sessions(spark, st.dir_stream(spark, src, spark.read.parquet(src).schema), base).collect())

    assert run(first) == [(1, at(1, 0), at(1, 18), 2), (1, at(3, 0), at(3, 12), 1), (2, at(5, 0), at(5, 12), 1)]
    assert run(later) == [(1, at(1, 0), at(1, 18), 2), (1, at(3, 0), at(3, 12), 1), (1, at(9, 0), at(9, 12), 1), (2, at(5, 0), at(5, 18), 2)]


def test_a_view_of_one_part_is_not_merged_again(spark, tmp_path):
    """ST03: the only part is a merge already and is read without a shuffle; two parts are merged."""
    from storelake.plans.streams import merged_views, partial_views

    out = f"{tmp_path}/view"
    rows = spark.createDataFrame([("v", "a", dt.datetime(2024, 1, 1), 1, None)] * 3, "view string, key string, bucket timestamp_ntz, n long, amount decimal(28,6)")
    partial_views(rows, 0, out)
    one = merged_views(spark, [out])
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString() and [r.n for r in one.collect()] == [3]
    partial_views(rows, 1, out)
    assert [r.n for r in merged_views(spark, [out]).collect()] == [6]


def test_no_events_no_sessions(spark, tmp_path):
    from storelake.plans.streams import sessions

    src = f"{tmp_path}/in"
    none = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long")
    none.coalesce(1).write.parquet(src)
    assert sessions(spark, st.dir_stream(spark, src, none.schema), f"{tmp_path}/run").count() == 0


def test_pairs_with_open_rows_in_a_table_equal_the_stream_join(spark, tmp_path):
    """Over ten files a side, with departures before their arrivals, rows that come twice or late, and nulls, the pairs
    and timed-out arrivals are those of the stream-stream join; a replayed batch changes nothing; merged parts hold no row that is out of reach."""
    from storelake.plans.streams import lifecycle_batch, lifecycle_pairs, pair_lifecycles
    from storelake.streaming import views

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    a, d = [[] for _ in range(10)], [[] for _ in range(10)]
    for i in range(100):
        a[i // 10].append((i, day(i)))
        if i % 3:
            d[min(9, max(0, i // 10 + (-1 if i % 10 == 5 else 1 if i % 5 == 0 else 0)))].append((i, i % 2, day(i + 2)))
    a[4] += [(44, day(44)), (44, day(46)), (None, day(41)), (45, None), (7, day(2))]  # twice, after its departure, null key, null time, late
    d[4] += [(43, 1, day(45)), (None, 1, day(43)), (48, 0, None), (9, 0, day(11))]
    for n, rows, schema in (("a", a, "shipment_id long, arrival_ts timestamp_ntz"), ("d", d, "shipment_id long, line int, departure_ts timestamp_ntz")):
        for part in rows:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}")
    streams = lambda: [st.dir_stream(spark, f"{tmp_path}/{n}", spark.read.parquet(f"{tmp_path}/{n}").schema) for n in "ad"]
    plain = lambda x: sorted(map(tuple, x.select("shipment_id", "arrival_ts", "departure_ts", "line", "status").collect()), key=str)

    joined = pair_lifecycles(*streams(), "shipment_id", "arrival_ts", "departure_ts", within_days=3, late_days=12)
    want = plain(st.run_to_table(joined, "test-pairs", writer=lifecycle_batch))
    base = f"{tmp_path}/run"
    run = lambda: plain(lifecycle_pairs(*streams(), base, 3, 12, lifecycle_batch, unpaired=True))
    assert run() == want
    assert {"paired", "timed_out"} == {r[-1] for r in want}

    merged = [e for e in views.live_parts(spark, f"{base}/open") if e["generation"]]
    assert merged and spark.read.parquet(*(e["path"] for e in merged)).where(F.col("_ts") < F.lit(day(69 - 12 - 3))).count() == 0

    commits = tmp_path / "run" / "_checkpoint" / "commits"
    for name in ("9", ".9.crc"):  # the last batch was written, its commit was lost
        (commits / name).unlink(missing_ok=True)
    assert run() == want


def test_lifecycle_queries_keep_no_state_store(spark, tmp_path):
    """ST05 and ST05_timeouts hold no row in a state store; without rows the result is empty."""
    import glob

    from storelake.plans import registry
    from storelake.session import checkpoint_dir

    sf = f"{tmp_path}/sf"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    orders = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"
    lines = "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp_ntz"
    spark.createDataFrame([(1, 5, day(0)), (2, 5, day(1)), (3, 6, day(200))], orders).write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(1, 1, 8, day(2)), (1, 2, 9, day(150)), (3, 1, 8, day(220))], lines).write.parquet(f"{sf}/lineitem.parquet")
    q = registry.queries()
    found = lambda p: set(glob.glob(f"{checkpoint_dir(spark)}/storelake-streams/{p}-*/_checkpoint/state"))
    before = found("st05") | found("st05t")
    assert sorted((r.shipment_id, r.l_linenumber) for r in q["ST05"](spark, sf).collect()) == [(1, 1), (1, 2), (3, 1)]
    assert sorted((r.shipment_id, r.status) for r in q["ST05_timeouts"](spark, sf).collect()) == [(1, "paired"), (2, "timed_out"), (3, "paired")]
    assert found("st05") | found("st05t") == before
    spark.createDataFrame([], orders).write.parquet(f"{tmp_path}/none/orders.parquet")
    spark.createDataFrame([], lines).write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert q["ST05"](spark, f"{tmp_path}/none").count() == q["ST05_timeouts"](spark, f"{tmp_path}/none").count() == 0
