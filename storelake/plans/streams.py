"""Streaming operators (ST01–ST13). Each query runs the streaming plan over
the driver table with ``availableNow`` and returns the sink's contents; the
expressions are the batch operators' own, so streaming result = batch result
(the oracles are the batch queries' SQL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.operators import aggs
from storelake.plans.analytics import _score as score_series
from storelake.plans.analytics import _sql_anomaly
from storelake.plans.common import SQL_RECEIPTS, finish
from storelake.plans.gold import SQL_LIFECYCLES, SQL_SENSORS, lifecycles
from storelake.plans.named import _SQL_STOCKOUTS, crowded, stockouts
from storelake.plans.reaimed import _SQL_REORDERS, reorder_signals
from storelake.plans.registry import ORACLES, register
from storelake.sources import driver as d
from storelake.streaming import pairs, views
from storelake.streaming import runner as st

WATERMARK = "1 hour"


def et(df, *cols):
    """Event-time columns as TIMESTAMP (watermarks need the session-zone
    type; the session is UTC so wall-clock values are unchanged)."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


@register("ST01", None)
def st01_incremental_load(spark, sf):
    """Incremental Silver load: file-source stream of lineitem, Silver line
    projection, appended to a parquet table; the checkpoint replaces the
    hand-kept high-water mark (exactly once, no ties lost, G11)."""
    li = st.table_stream(spark, sf, "lineitem")
    silver = li.select(
        F.concat(F.lit("RCP-"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("receipt_id_ext"),
        F.col("l_linenumber").alias("line_num"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"),
        d.cents("l_extendedprice").alias("ext_cents"), F.col("l_shipdate").alias("event_ts"), F.to_date("l_shipdate").alias("event_date"),
    )
    return st.run_to_table(silver, "st01")


ORACLES["ST01"] = """SELECT 'RCP-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS receipt_id_ext, l_linenumber AS line_num, l_partkey AS product_id,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_cents, l_shipdate AS event_ts, CAST(l_shipdate AS DATE) AS event_date FROM lineitem"""


@register("ST02", None)
def st02_watermark_table(spark, sf):
    """High-water-mark table (batch variant of ST01): per source the max
    timestamp loaded, rewritten by a full-outer merge of old and new marks
    into a fresh folder (no MERGE without a table format; ties handled by >=
    plus dedupe downstream)."""
    t = lambda n: d.table(spark, sf, n)
    new = aggs.freshness(
        {"orders": t("orders").select(F.col("o_orderdate").alias("ts")), "lineitem": t("lineitem").select(F.col("l_shipdate").alias("ts")), "events": t("events").select("ts")},
        "ts",
    ).select("source", F.col("latest").alias("new_mark"))
    # marks of an earlier load: orders up to its first day, and a source that has ended
    first = t("orders").agg(F.min("o_orderdate").alias("mark"))
    old = first.select(F.explode(F.array(F.lit("orders"), F.lit("archive"))).alias("source"), "mark")
    merged = old.join(new, "source", "full_outer").select("source", F.greatest(F.col("mark"), F.col("new_mark")).alias("mark"))
    out = st.run_folder(spark, "st02") + "/marks"
    merged.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


ORACLES["ST02"] = """SELECT 'orders' AS source, max(o_orderdate) AS mark FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem
UNION ALL SELECT 'events', max(ts) FROM events UNION ALL SELECT 'archive', min(o_orderdate) FROM orders"""


def view_rows(wanted: dict) -> "F.Column":
    """One row for each view a row counts in: {view: (condition, key, bucket, count, amount)}."""
    one = lambda v, x: F.when(x[0], F.struct(F.lit(v).alias("view"), x[1].cast("string").alias("key"), x[2].cast("timestamp_ntz").alias("bucket"), x[3].cast("bigint").alias("n"), x[4].cast("decimal(28,6)").alias("amount")))
    return F.explode(F.filter(F.array(*(one(v, x) for v, x in wanted.items())), lambda x: x.isNotNull()))


VIEW_SCHEMA = "view string, key string, bucket timestamp_ntz, n bigint, amount decimal(38,6)"


def summed(rows):
    """Counts and sums by view, key and bucket: of rows, of parts, and of parts of parts."""
    sums = rows.groupBy("view", "key", "bucket").agg(F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,6)").alias("amount"))
    return sums.select("view", "key", "bucket", "n", "amount")


def partial_views(df, bid: int, out: str) -> None:
    """foreachBatch of ST03: the batch's own counts and sums are a part of the view. Nothing is kept
    between batches, and late rows count like others."""
    views.commit(df.withColumn("amount", F.col("amount").cast("decimal(38,6)")), bid, out, summed)


def merged_views(spark, outs):
    """The views of several streams, each the sum of its live parts."""
    parts = reduce(lambda a, b: a.unionByName(b), [views.read_view(spark, out, VIEW_SCHEMA, summed) for out in outs])
    return parts.withColumn("amount", F.col("amount").cast("double"))


def _minute(c):
    return F.date_trunc("minute", F.col(c))


def _quarter(c):
    return F.window(F.col(c), "15 minutes").start


@register("ST03", None)
def st03_incremental_window_aggregates(spark, sf):
    """The seven incremental views (sales per store-minute and product-minute, top products and
    tender mix per 15 minutes, zone dwell per minute, approvals and rejections per hour) from
    three streams, each row of a view as (key, bucket, count, amount)."""
    yes, one = F.lit(True), F.lit(1)
    stores = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = st.table_stream(spark, sf, "orders").join(stores, "o_custkey")
    lines = st.table_stream(spark, sf, "lineitem")
    events = st.table_stream(spark, sf, "events").withColumn("q", _quarter("ts"))
    hour = F.date_trunc("hour", F.col("ts"))
    streams = {
        "orders": orders.select(view_rows({"store_minute": (yes, F.col("c_nationkey"), _minute("o_orderdate"), one, d.cents("o_totalprice"))}).alias("x")),
        "lines": lines.withColumn("q", _quarter("l_shipdate")).select(
            view_rows({
                "product_minute": (yes, F.col("l_partkey"), _minute("l_shipdate"), one, d.cents("l_extendedprice")),
                "top_products_15m": (yes, F.col("l_partkey"), F.col("q"), F.col("l_quantity"), d.cents("l_extendedprice")),
            }).alias("x")
        ),
        "events": events.select(
            view_rows({
                "zone_minute": (yes, F.concat_ws("|", F.get_json_object("props", "$.k"), "event_type"), _minute("ts"), one, F.round("value", 6)),
                "tender_15m": (yes, F.col("event_type"), F.col("q"), one, d.cents("value")),
                "approvals_hour": (F.col("event_type") == "click", F.lit("all"), hour, one, F.lit(0)),
                "rejections_hour": (F.col("event_type") == "error", F.lit("all"), hour, one, F.lit(0)),
            }).alias("x")
        ),
    }
    base = st.run_folder(spark, "st03")
    return merged_views(spark, [st.run_batches(x.select("x.*"), f"{base}/{name}", partial_views) for name, x in streams.items()])


ORACLES["ST03"] = """WITH v AS (
  SELECT 'store_minute' AS view, CAST(c_nationkey AS VARCHAR) AS key, date_trunc('minute', o_orderdate) AS bucket, 1 AS n, round(o_totalprice * 100) AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'product_minute', CAST(l_partkey AS VARCHAR), date_trunc('minute', l_shipdate), 1, round(l_extendedprice * 100) FROM lineitem
  UNION ALL SELECT 'top_products_15m', CAST(l_partkey AS VARCHAR), time_bucket(INTERVAL '15 minutes', l_shipdate), CAST(l_quantity AS BIGINT), round(l_extendedprice * 100) FROM lineitem
  UNION ALL SELECT 'zone_minute', concat_ws('|', json_extract_string(props, '$.k'), event_type), date_trunc('minute', ts), 1, round(value, 6) FROM events
  UNION ALL SELECT 'tender_15m', event_type, time_bucket(INTERVAL '15 minutes', ts), 1, round(value * 100) FROM events
  UNION ALL SELECT 'approvals_hour', 'all', date_trunc('hour', ts), 1, 0 FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'rejections_hour', 'all', date_trunc('hour', ts), 1, 0 FROM events WHERE event_type = 'error')
SELECT view, key, bucket, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS amount FROM v GROUP BY ALL"""


def latest_rows(df):
    return aggs.latest_per_key(df, ["user_id"], ["ts", "event_id"], ["event_id", "ts", "event_type", "value", "props"])


def latest_part(df, bid: int, out: str) -> None:
    """foreachBatch of ST04: the batch's arg_max rows are a part of the view."""
    views.commit(df.select("user_id", "event_id", "ts", "event_type", "value", "props"), bid, out, latest_rows)


@register("ST04", None)
def st04_latest_per_key(spark, sf):
    """Incremental latest-per-key view: the arg_max over the arg_max rows of all micro-batches, kept
    in merged parts, so rows that arrive out of order never replace a later one."""
    return latest_view(spark, st.table_stream(spark, sf, "events"), st.run_folder(spark, "st04"))


def latest_view(spark, stream, base):
    out = st.run_batches(stream, base, latest_part)
    columns = stream.select("user_id", "event_id", "ts", "event_type", "value", "props").schema
    return views.read_view(spark, out, columns, latest_rows)


@register("ST05", None)
def st05_stream_stream_pairs(spark, sf):
    """Arrival <-> departure pairing of two streams, whichever comes in first, with
    watermarks on both sides and a time bound (departure within 10 years
    after arrival) so open rows are evicted. Ten years of open rows are a table, not a state store."""
    x = lifecycle_pairs(*lifecycle_streams(spark, sf), st.run_folder(spark, "st05"), 3650, 3650, st.batch_keyed_upsert)
    return finish(x.select("shipment_id", "truck_id", "l_linenumber", "l_suppkey", "arrival_ts", "departure_ts"))


ORACLES["ST05"] = """SELECT o_orderkey AS shipment_id, o_custkey AS truck_id, l_linenumber, l_suppkey, o_orderdate AS arrival_ts, l_shipdate AS departure_ts
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 3650 DAY"""


def lifecycle_streams(spark, sf):
    """Arrivals (orders) and departures (lines) of the shipments."""
    o = st.table_stream(spark, sf, "orders").select(F.col("o_orderkey").alias("shipment_id"), F.col("o_custkey").alias("truck_id"), F.col("o_orderdate").alias("arrival_ts"))
    li = st.table_stream(spark, sf, "lineitem").select(F.col("l_orderkey").alias("shipment_id"), "l_linenumber", "l_suppkey", F.col("l_shipdate").alias("departure_ts"))
    return o, li


def lifecycle_pairs(arrivals, departures, base: str, within_days: int, late_days: int, writer, unpaired: bool = False):
    """What :func:`pairs.run_pairs` wrote for the two streams in ``base``."""
    a, b = et(arrivals, "arrival_ts"), et(departures, "departure_ts")
    out = pairs.run_pairs(a, b, "shipment_id", "arrival_ts", "departure_ts", within_days, late_days, base, writer, unpaired)
    spark, columns = a.sparkSession, T.StructType([*a.schema.fields, *b.drop("shipment_id").schema.fields, *([T.StructField("status", T.StringType())] if unpaired else [])])
    return spark.read.schema(columns).parquet(out) if views.live_parts(spark, f"{base}/open") else spark.createDataFrame([], columns)


def pair_lifecycles(arrivals, departures, key: str, arrival: str, departure: str, within_days: int, late_days: int):
    """Arrivals with their departures up to ``within_days`` later, whichever comes in first, as a stream: for streams
    whose open rows are few. :func:`lifecycle_pairs` has the same rules and keeps them in a table.

    A stream-stream left join: a pair goes out when its later half is read. An arrival stays
    in the state until the watermark (``late_days`` behind the newest row of the slower side)
    has passed its last possible departure and then leaves, with NULL if none came; a departure
    leaves with the watermark. So the state holds the rows of ``within_days + late_days``, not all."""
    a = et(arrivals, arrival).withWatermark(arrival, f"{late_days} days")
    b = et(departures.withColumnRenamed(key, "_key"), departure).withWatermark(departure, f"{late_days} days")
    on = F.expr(f"{key} = _key AND {departure} > {arrival} AND {departure} <= {arrival} + INTERVAL {within_days} DAYS")
    return a.join(b, on, "leftOuter").drop("_key")


def lifecycle_batch(df, bid: int, out: str) -> None:
    """foreachBatch of ST05_timeouts: pairs and timed-out arrivals go to their own partition of the batch's folder."""
    status = F.when(F.col("departure_ts").isNull(), "timed_out").otherwise("paired")
    df.withColumn("status", status).write.mode("overwrite").partitionBy("status").parquet(f"{out}/batch_id={bid}")


# Fixed choice: a truck departs within 120 days; rows come at most 30 days late.
LIFECYCLE_DAYS, LATE_DAYS = 120, 30


@register("ST05_timeouts", None)
def st05_timeouts(spark, sf):
    """Lifecycle pairing with bounded open rows: pairs within 120 days, and arrivals that timed out."""
    x = lifecycle_pairs(*lifecycle_streams(spark, sf), st.run_folder(spark, "st05t"), LIFECYCLE_DAYS, LATE_DAYS, lifecycle_batch, unpaired=True)
    x = x.select("shipment_id", "truck_id", "status", "arrival_ts", "departure_ts", F.col("l_linenumber").cast("double").alias("l_linenumber"), F.col("l_suppkey").cast("double").alias("l_suppkey"))
    return finish(x)


ORACLES["ST05_timeouts"] = f"""WITH w AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL {LATE_DAYS} DAY AS mark),
p AS (SELECT o_orderkey AS shipment_id, o_custkey AS truck_id, 'paired' AS status, o_orderdate AS arrival_ts, l_shipdate AS departure_ts,
  CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_suppkey AS DOUBLE) AS l_suppkey
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL {LIFECYCLE_DAYS} DAY)
SELECT * FROM p UNION ALL
SELECT o_orderkey, o_custkey, 'timed_out', o_orderdate, NULL, NULL, NULL FROM orders
WHERE o_orderkey NOT IN (SELECT shipment_id FROM p) AND o_orderdate + INTERVAL {LIFECYCLE_DAYS} DAY < (SELECT mark FROM w)"""


@register("ST06", None)
def st06_session_windows(spark, sf):
    """All sessions with a 12 h gap timeout via session_window."""
    return sessions(spark, st.table_stream(spark, sf, "events"), st.run_folder(spark, "st06"))


def sessions(spark, events, base):
    """The sessions of the stream run in ``base``. One is written once, when the watermark (12 h after the latest
    event) has passed its end, and leaves the state with that; the sessions that may still go on
    at the end of the input are read from the state and come out with the others."""
    e = et(events, "ts").withWatermark("ts", "12 hours")
    s = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(F.count(F.lit(1)).alias("events"))
    parts = lambda w, n: [F.col("user_id"), F.col(f"{w}.start").cast("timestamp_ntz").alias("session_start"), F.col(f"{w}.end").cast("timestamp_ntz").alias("session_end"), F.col(n).alias("events")]
    closed = st.run_to_table(s.select(*parts("s", "events")), "st06", base=base)
    return closed.unionByName(st.open_state(spark, base).select(*parts("session_window", "count")))


ORACLES["ST06"] = f"""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS events FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= {12 * 3600 * 1_000_000} THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sn FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, sn"""


def route_batch(df, bid: int, out: str) -> None:
    """foreachBatch of ST07: a replayed batch rewrites its own folder."""
    df.write.mode("overwrite").partitionBy("event_type").parquet(f"{out}/batch_id={bid}")


@register("ST07", None)
def st07_typed_fanout(spark, sf):
    """Typed fan-out of the mixed stream: each micro-batch is routed by
    event_type into a same-named partition; a failed write fails the batch
    (no swallowed errors, G10). Returns rows per routed table."""
    e = st.table_stream(spark, sf, "events")
    routed = st.run_to_table(e, "st07", writer=route_batch)
    return routed.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


ORACLES["ST07"] = "SELECT event_type, count(*) AS rows FROM events GROUP BY 1"


@register("ST08", None)
def st08_duplicate_safe_replay(spark, sf):
    """Replay safety: the same events arrive twice (two sources unioned);
    dropDuplicatesWithinWatermark on event_id keeps one copy."""
    a = st.table_stream(spark, sf, "events")
    b = st.table_stream(spark, sf, "events")
    u = et(a.unionByName(b), "ts").withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
    return finish(st.run_to_table(u, "st08"))


ORACLES["ST08"] = "SELECT * FROM events"


def deliveries(events, n: int = 3, every: int = 10) -> list:
    """``events`` as ``n`` deliveries by time, one event in ``every`` a delivery late."""
    lo, hi = events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    if lo is None:
        return []
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - lo) * n / (hi - lo + 1)).cast("int")
    due = F.least(part + F.when(F.col("event_id") % every == 0, 1).otherwise(0), F.lit(n - 1))
    return [events.where(due == k) for k in range(n)]


def mark_late(df, bid: int, out: str) -> None:
    """foreachBatch of ST09: rows at or below the mark (the latest time of all earlier
    batches) are late. Every batch writes its mark beside its rows in the shared folder, so a
    restart or a replayed batch finds the marks of the batches before it and rewrites only its own."""
    spark, marks, wm = df.sparkSession, f"{out}-marks", None
    if bid > 0:
        wm = spark.read.schema("mark timestamp_ntz, batch_id long").parquet(marks).where(F.col("batch_id") < bid).agg(F.max("mark")).first()[0]
    on_time, late = st.split_late(df, "ts", wm)
    on_time.withColumn("class", F.lit("on_time")).unionByName(late.withColumn("class", F.lit("late"))).write.mode("overwrite").parquet(f"{out}/batch_id={bid}")
    df.agg(F.max("ts").alias("mark")).write.mode("overwrite").parquet(f"{marks}/batch_id={bid}")


@register("ST09", None)
def st09_late_rows(spark, sf):
    """Late-data rule over a replay of the table in three deliveries with one
    event in ten a delivery late; returns counts per class. Each delivery is one
    run of the stream on the same checkpoint."""
    events = d.table(spark, sf, "events")
    base = st.run_folder(spark, "st09")
    for part in deliveries(events):
        part.write.mode("append").parquet(f"{base}/in")
        st.run_batches(st.dir_stream(spark, f"{base}/in", events.schema, max_files=None), base, mark_late)
    return spark.read.parquet(f"{base}/out").groupBy("class").agg(F.count(F.lit(1)).alias("rows"))


ORACLES["ST09"] = """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
e AS (SELECT ts, least(CAST(floor((epoch_us(ts) - lo) * 3 / (hi - lo + 1)) AS INTEGER) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 2) AS due FROM events, b),
m AS (SELECT due, max(max(ts)) OVER (ORDER BY due ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e GROUP BY due)
SELECT CASE WHEN ts <= mark THEN 'late' ELSE 'on_time' END AS class, count(*) AS rows FROM e JOIN m USING (due) GROUP BY 1"""


LATENESS = "1 day"  # how late a row of an alert rule may come, and how long its state is kept
SLIDE = "1 minute"  # alert windows end at every full minute


def alert_rules() -> dict:
    """Rule -> (time column, rows -> alerts (key, value)) of the rules that look at single rows."""
    key = lambda *c: F.concat_ws("|", *(F.col(x).cast("string") for x in c)).alias("key")
    value = lambda c: F.col(c).cast("double").alias("value")
    return {
        "AL01": ("event_ts", lambda x: x.select("event_ts", key("store_id", "product_id"), value("last_known_quantity"))),
        "AL02": ("event_ts", lambda x: x.where(F.col("priority") == "URGENT").select("event_ts", key("store_id", "product_id"), value("reorder_quantity"))),
        "AL03": ("arrival_ts", lambda x: x.where(F.col("dwell_minutes") > 90).select("arrival_ts", key("shipment_id", "site"), F.round("dwell_minutes", 4).alias("value"))),
        "AL05": ("event_ts", lambda x: x.where(F.col("total_cents") > 20000).select("event_ts", key("receipt_id"), value("total_cents"))),
    }


def row_alerts(rule: str, stream, base: str):
    """Alerts of a rule on single rows, as ``raised_at, key, value``. A row is in the rule's lookback at all window
    ends from the next full minute on, so it raises its alert there and nowhere else, whatever
    batch brings it. A row that is delivered again within ``LATENESS`` raises none."""
    ts, alerts = alert_rules()[rule]
    found = alerts(et(stream, ts).withWatermark(ts, LATENESS)).dropDuplicatesWithinWatermark([ts, "key", "value"])
    found = found.select((F.date_trunc("minute", ts) + F.expr(f"INTERVAL {SLIDE}")).cast("timestamp_ntz").alias("raised_at"), "key", "value")
    out = st.run_batches(found, base, st.batch_keyed_upsert)
    return stream.sparkSession.read.schema(found.schema).parquet(out).select("raised_at", "key", "value")


def zone_alerts(stream, base: str):
    """AL04 over windows of five minutes that end at every full minute, as ``raised_at, key, value``.

    The windows' counts and sums are state until the watermark has passed them. Every batch writes the windows
    it changed, crowded or no longer so, into its own folder; of each window the last version counts. A window that a
    late row of ``LATENESS`` or less changes is so corrected, and raises one alert or none."""
    w = et(stream, "event_ts").withWatermark("event_ts", LATENESS).groupBy(F.window("event_ts", "5 minutes", SLIDE).alias("w"), "store_id", "zone")
    found = w.agg(F.count(F.lit(1)).alias("customers"), F.avg("dwell_seconds").alias("avg_dwell"))
    found = found.select(F.col("w.end").cast("timestamp_ntz").alias("raised_at"), "store_id", "zone", "customers", "avg_dwell")
    out = st.run_batches(found, base, st.batch_keyed_upsert, mode="update")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in found.schema)}, batch_id long"
    latest = st.latest_by_batch(stream.sparkSession.read.schema(schema).parquet(out), ["raised_at", "store_id", "zone"])
    return crowded(latest).select("raised_at", F.concat_ws("|", "store_id", "zone").alias("key"), F.col("customers").cast("double").alias("value"))


@register("ST10", None)
def st10_streaming_alerts(spark, sf):
    """Rules AL01–AL05 over streams of their event tables, on sliding event-time windows: the
    alerts are those of the batch rules run at the end of every minute, each written once, and do not depend on how the
    rows are cut into batches. Derived tables (stockouts, reorders, truck
    lifecycles) are landed as files first, as their producers would."""
    base = st.run_folder(spark, "st10")
    tables = {"AL01": stockouts(spark, sf), "AL02": reorder_signals(spark, sf), "AL03": lifecycles(spark, sf), "AL04": d.sensors(spark, sf), "AL05": d.receipts(spark, sf)}
    out = []
    for rule, table in tables.items():
        table.write.parquet(f"{base}/{rule}/in")
        stream = st.dir_stream(spark, f"{base}/{rule}/in", table.schema, max_files=None)
        found = zone_alerts(stream, f"{base}/{rule}") if rule == "AL04" else row_alerts(rule, stream, f"{base}/{rule}")
        out.append(found.select(F.lit(rule).alias("rule"), "raised_at", "key", "value"))
    return reduce(lambda a, b: a.unionByName(b), out)


def _sql_row_alerts(rule: str, table: str, ts: str, key: str, value: str, where: str = "TRUE") -> str:
    return f"SELECT DISTINCT '{rule}' AS rule, date_trunc('minute', {ts}) + INTERVAL 1 MINUTE AS raised_at, concat_ws('|', {key}) AS key, CAST({value} AS DOUBLE) AS value FROM {table} x WHERE {where}"


ORACLES["ST10"] = " UNION ALL ".join((
    _sql_row_alerts("AL01", _SQL_STOCKOUTS, "event_ts", "store_id, product_id", "last_known_quantity"),
    _sql_row_alerts("AL02", _SQL_REORDERS, "event_ts", "store_id, product_id", "reorder_quantity", "priority = 'URGENT'"),
    _sql_row_alerts("AL03", SQL_LIFECYCLES, "arrival_ts", "shipment_id, site", "round(dwell_minutes, 4)", "dwell_minutes > 90"),
    _sql_row_alerts("AL05", SQL_RECEIPTS, "event_ts", "receipt_id", "total_cents", "total_cents > 20000"),
    f"""SELECT 'AL04', raised_at, concat_ws('|', store_id, zone), CAST(count(*) AS DOUBLE) FROM (
  SELECT *, date_trunc('minute', event_ts) + unnest(range(1, 6)) * INTERVAL 1 MINUTE AS raised_at FROM {SQL_SENSORS}) x
GROUP BY raised_at, store_id, zone HAVING count(*) > 50 OR avg(dwell_seconds) > 600""",
))


def closed_hours(events):
    """(entity_id, hour, v): events per type and hour, each hour once, when the watermark has passed its end."""
    hourly = et(events, "ts").withWatermark("ts", WATERMARK).groupBy(F.col("event_type").alias("entity_id"), F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return hourly.select("entity_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "v")


@register("ST11", None)
def st11_streaming_anomalies(spark, sf):
    """Hourly event counts on the stream, scored with the M01 scorer. The stream appends closed hours
    only (its state is the open ones); the scorer reads those few rows, one a type and hour, when asked."""
    return score_series(st.run_to_table(closed_hours(st.table_stream(spark, sf, "events")), "st11"))


ORACLES["ST11"] = _sql_anomaly("""(SELECT event_type AS entity_id, date_trunc('hour', ts) AS hour, CAST(count(*) AS DOUBLE) AS v FROM events
  GROUP BY ALL HAVING date_trunc('hour', max(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""")


@register("ST13", None)
def st13_stream_enrichment(spark, sf):
    """Stream-static enrichment (J13 on a stream): events x broadcast nation
    dimension (25 rows, bounded by the domain) with defaults."""
    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("user_id"), "n_name", "n_regionkey")
    e = st.table_stream(spark, sf, "events").select("event_id", "user_id", "event_type")
    j = e.join(F.broadcast(n), "user_id", "left")
    out = j.select("event_id", "user_id", "event_type", F.coalesce("n_name", F.lit("UNKNOWN")).alias("nation"), F.coalesce("n_regionkey", F.lit(-1)).alias("region"))
    return st.run_to_table(out, "st13")


def _share(alias, src):
    if src in ORACLES:
        ORACLES[alias] = ORACLES[src]


_share("ST04", "A13")
_share("ST13", "J13")
