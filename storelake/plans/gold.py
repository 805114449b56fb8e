"""Gold aggregates and the rest of §2.4 (A01–A36) bound to the driver tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from storelake.operators import aggs, windows
from storelake.plans.common import (
    SQL_EVENTS,
    SQL_LEDGER,
    SQL_LINES,
    SQL_RECEIPTS,
    SQL_RECEIPTS_STORE,
    finish,
    scalar,
)
from storelake.plans.registry import register
from storelake.sources import driver as d


# A01 ---------------------------------------------------------------------------
@register(
    "A01",
    f"""SELECT store_id, date_trunc('minute', event_ts) AS ts,
  CAST(sum(total_cents) AS DOUBLE) / 100 AS total_sales, count(*) AS receipts,
  CAST(sum(total_cents) AS DOUBLE) / 100 / count(*) AS avg_basket
FROM {SQL_RECEIPTS_STORE} GROUP BY ALL""",
)
def a01_sales_minute_store(spark, sf):
    return finish(aggs.sales_by_time(d.receipts(spark, sf, with_store=True), ["store_id"], "event_ts", "total_cents", "minute"))


# A02 ---------------------------------------------------------------------------
@register(
    "A02",
    f"""SELECT product_id, time_bucket(INTERVAL '15 minutes', event_ts) AS window_start,
  time_bucket(INTERVAL '15 minutes', event_ts) + INTERVAL '15 minutes' AS computed_at,
  CAST(sum(ext_cents) AS DOUBLE) / 100 AS revenue, CAST(sum(quantity) AS BIGINT) AS units
FROM {SQL_LINES} GROUP BY ALL""",
)
def a02_top_products_15m(spark, sf):
    return finish(aggs.top_products_window(d.lines(spark, sf), "product_id", "event_ts", "ext_cents", "quantity"))


# A03 ---------------------------------------------------------------------------
@register(
    "A03",
    f"""SELECT product_id, date_trunc('minute', event_ts) AS ts,
  CAST(sum(ext_cents) AS DOUBLE) / 100 AS total_sales, count(*) AS receipts,
  CAST(sum(ext_cents) AS DOUBLE) / 100 / count(*) AS avg_basket
FROM {SQL_LINES} GROUP BY ALL""",
)
def a03_sales_product_minute(spark, sf):
    return finish(aggs.sales_by_time(d.lines(spark, sf), ["product_id"], "event_ts", "ext_cents", "minute"))


def current_positions(ledger, keys):
    """Latest balance per key without a window: the balance after the last
    movement of a running sum from 0 is the key's total, and its time is the
    latest movement's. One partial hash aggregate of two numbers, so a hot key is
    pre-reduced in every map task and the movement's text id is never built."""
    return ledger.groupBy(*keys).agg(F.sum("qty").alias("on_hand"), F.max("event_ts").alias("as_of"))


def _store_positions(spark, sf):
    return current_positions(d.ledger(spark, sf), ["store_id", "product_id"])


_SQL_POSITIONS = f"""(SELECT store_id, product_id, on_hand, as_of FROM (
  SELECT store_id, product_id, event_ts AS as_of, txn_id,
    CAST(sum(qty) OVER (PARTITION BY store_id, product_id ORDER BY event_ts, txn_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS on_hand
  FROM {SQL_LEDGER})
  QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY as_of DESC, txn_id DESC) = 1)"""


# A04 ---------------------------------------------------------------------------
@register("A04", f"SELECT * FROM {_SQL_POSITIONS}")
def a04_inventory_position_current(spark, sf):
    """Latest running balance per (store, product) (W05 then arg_max, G13)."""
    return finish(_store_positions(spark, sf))


# A05 ---------------------------------------------------------------------------
@register(
    "A05",
    f"""SELECT dc_id, product_id, on_hand, as_of FROM (
  SELECT dc_id, product_id, event_ts AS as_of, txn_id,
    CAST(sum(qty) OVER (PARTITION BY dc_id, product_id ORDER BY event_ts, txn_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS on_hand
  FROM (SELECT CAST(s_nationkey AS BIGINT) AS dc_id, l.* FROM {SQL_LEDGER} l JOIN supplier ON l.store_id = s_suppkey))
QUALIFY row_number() OVER (PARTITION BY dc_id, product_id ORDER BY as_of DESC, txn_id DESC) = 1""",
)
def a05_dc_inventory_position_current(spark, sf):
    """DC positions: the ledger rolled to the supplier's nation as DC."""
    sup = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_nationkey").cast("bigint").alias("dc_id"))
    led = d.ledger(spark, sf).join(sup, "store_id", "inner")
    return finish(current_positions(led, ["dc_id", "product_id"]))


SQL_TRUCK_MOVES = """(SELECT o_custkey AS truck_id,
  CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS dc_id,
  CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS store_id,
  l_orderkey AS shipment_id, o_orderdate AS eta, l_shipdate AS etd, s.status, s.event_ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey,
  LATERAL (SELECT 'ARRIVED' AS status, o_orderdate AS event_ts UNION ALL SELECT 'DEPARTED', l_shipdate) s)"""

SQL_LIFECYCLES = f"""(SELECT truck_id, dc_id, store_id, shipment_id, arrival_ts, departure_ts,
  CAST(epoch(departure_ts) - epoch(arrival_ts) AS DOUBLE) / 60 AS dwell_minutes,
  CASE WHEN store_id IS NOT NULL THEN 'STORE_' || CAST(store_id AS VARCHAR) ELSE 'DC_' || CAST(dc_id AS VARCHAR) END AS site
FROM (SELECT truck_id, dc_id, store_id, shipment_id,
    min(CASE WHEN status = 'ARRIVED' THEN event_ts END) AS arrival_ts,
    max(CASE WHEN status = 'DEPARTED' THEN event_ts END) AS departure_ts
  FROM {SQL_TRUCK_MOVES} GROUP BY ALL)
WHERE arrival_ts IS NOT NULL AND departure_ts IS NOT NULL AND departure_ts > arrival_ts)"""


def lifecycles(spark, sf):
    life = aggs.lifecycles(d.truck_moves(spark, sf), ["truck_id", "dc_id", "store_id", "shipment_id"], "status", "event_ts")
    return life.withColumn("site", aggs.site_label("store_id", "dc_id"))


# A06 ---------------------------------------------------------------------------
@register(
    "A06",
    f"""SELECT site, day, round(avg(dwell_min), 4) AS avg_dwell_min, count(DISTINCT truck_id) AS trucks FROM (
  SELECT CASE WHEN store_id IS NOT NULL THEN 'STORE_' || CAST(store_id AS VARCHAR) ELSE 'DC_' || CAST(dc_id AS VARCHAR) END AS site,
    CAST(event_ts AS DATE) AS day, CAST(epoch(etd) - epoch(eta) AS DOUBLE) / 60 AS dwell_min, truck_id
  FROM {SQL_TRUCK_MOVES}) WHERE dwell_min IS NOT NULL AND dwell_min > 0 GROUP BY ALL""",
)
def a06_truck_dwell_daily_v1(spark, sf):
    return finish(aggs.truck_dwell_daily_v1(d.truck_moves(spark, sf), "event_ts", "truck_id", "store_id", "dc_id", "eta", "etd"), 4)


# A07 ---------------------------------------------------------------------------
@register(
    "A07",
    f"""SELECT site, CAST(arrival_ts AS DATE) AS day, round(avg(dwell_minutes), 4) AS avg_dwell_min, count(*) AS trucks
FROM {SQL_LIFECYCLES} GROUP BY ALL""",
)
def a07_truck_dwell_daily_v2(spark, sf):
    return finish(aggs.truck_dwell_daily_v2(lifecycles(spark, sf), "store_id", "dc_id"), 4)


def order_totals(spark, sf, seconds: int | None = None):
    """R13 order totals (basis-point tax on lines) joined to the header.

    With ``seconds`` only orders of the last ``seconds`` before the latest order that has
    lines; the orders are chosen first, so only their lines are summed."""
    from storelake.functions.money import line_tax_cents

    li = d.lines(spark, sf)
    r = d.receipts(spark, sf).select("receipt_id", "customer_id", "event_ts", "tender_type")
    if seconds is not None:
        last = scalar(r.select("receipt_id", "event_ts").join(li.select("receipt_id"), "receipt_id", "left_semi"), F.max("event_ts"))
        if last is not None:
            r = r.where(F.col("event_ts") > F.lit(last - timedelta(seconds=seconds)))
        li = li.join(r.select("receipt_id"), "receipt_id", "left_semi")
    li = li.withColumn("tax_cents", line_tax_cents("ext_cents", F.round(F.col("tax_rate") * 10000).cast("bigint"), F.lit(100)))
    head = aggs.header_rollup(li, "receipt_id", "ext_cents", "tax_cents")
    return r.join(head, "receipt_id", "inner")


SQL_ORDER_TOTALS = f"""(SELECT r.receipt_id, r.customer_id, r.event_ts, r.tender_type, h.subtotal_cents, h.tax_cents,
  h.line_count, h.subtotal_cents + h.tax_cents AS total_cents
FROM {SQL_RECEIPTS} r JOIN (
  SELECT receipt_id, CAST(sum(ext_cents) AS BIGINT) AS subtotal_cents,
    CAST(sum((ext_cents * CAST(round(tax_rate * 10000) AS BIGINT) * 100 + 500000) // 1000000) AS BIGINT) AS tax_cents,
    count(*) AS line_count
  FROM {SQL_LINES} GROUP BY receipt_id) h ON r.receipt_id = h.receipt_id)"""


# A08 ---------------------------------------------------------------------------
@register(
    "A08",
    f"""SELECT CAST(event_ts AS DATE) AS day, count(*) AS orders,
  CAST(sum(subtotal_cents) AS DOUBLE) / 100 AS subtotal, CAST(sum(tax_cents) AS DOUBLE) / 100 AS tax,
  CAST(sum(total_cents) AS DOUBLE) / 100 AS total,
  CAST(sum(total_cents) AS DOUBLE) / 100 / count(*) AS avg_order_value
FROM {SQL_ORDER_TOTALS} GROUP BY ALL""",
)
def a08_online_sales_daily(spark, sf):
    return finish(aggs.online_sales_daily(order_totals(spark, sf), "event_ts", "subtotal_cents", "tax_cents", "total_cents"))


SQL_SENSORS = f"""(SELECT k AS store_id, event_type AS zone, user_id AS device_id, value AS dwell_seconds, ts AS event_ts, event_id FROM {SQL_EVENTS})"""


# A09 ---------------------------------------------------------------------------
@register(
    "A09",
    f"""SELECT store_id, zone, date_trunc('minute', event_ts) AS ts, round(avg(dwell_seconds), 4) AS avg_dwell,
  count(*) AS customers, round(sum(dwell_seconds), 4) AS dwell_total
FROM {SQL_SENSORS} GROUP BY ALL""",
)
def a09_zone_dwell_minute(spark, sf):
    return finish(aggs.zone_dwell(d.sensors(spark, sf), "store_id", "zone", "event_ts", "dwell_seconds"), 4)


SQL_MARKETING = f"""(SELECT k AS campaign_id, user_id AS customer_id, CAST(round(value * 100) AS BIGINT) AS cost_cents,
  ts AS event_ts, event_id AS impression_id FROM {SQL_EVENTS} WHERE event_type = 'view')"""


# A10 ---------------------------------------------------------------------------
@register(
    "A10",
    f"""SELECT campaign_id, CAST(event_ts AS DATE) AS day, count(*) AS impressions,
  CAST(sum(cost_cents) AS DOUBLE) / 100 AS cost FROM {SQL_MARKETING} GROUP BY ALL""",
)
def a10_marketing_cost_daily(spark, sf):
    return finish(aggs.marketing_cost_daily(d.marketing(spark, sf), "campaign_id", "event_ts", "cost_cents"))


# A11 ---------------------------------------------------------------------------
@register(
    "A11",
    f"""SELECT CAST(event_ts AS DATE) AS day, tender_type AS payment_method, count(*) AS transactions,
  CAST(sum(total_cents) AS DOUBLE) / 100 AS total_amount FROM {SQL_RECEIPTS} GROUP BY ALL""",
)
def a11_tender_mix_daily(spark, sf):
    return finish(aggs.tender_mix(d.receipts(spark, sf), "event_ts", "tender_type", "total_cents"))


# A12 ---------------------------------------------------------------------------
@register(
    "A12",
    f"""SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, event_type AS payment_method, count(*) AS transactions,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_amount FROM events GROUP BY ALL""",
)
def a12_tender_mix_15m(spark, sf):
    """15-minute tender mix over the live stream (method = event type)."""
    e = d.events(spark, sf).withColumn("cents", d.cents("value"))
    out = (
        e.groupBy(F.window("ts", "15 minutes").start.alias("window_start"), F.col("event_type").alias("payment_method"))
        .agg(F.count(F.lit(1)).alias("transactions"), (F.sum("cents") / 100).alias("total_amount"))
    )
    return finish(out)


# A13 ---------------------------------------------------------------------------
@register(
    "A13",
    """SELECT user_id, event_id, ts, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def a13_latest_row_per_key(spark, sf):
    e = d.table(spark, sf, "events")
    return finish(aggs.latest_per_key(e, ["user_id"], ["ts", "event_id"], ["event_id", "ts", "event_type", "value", "props"]))


# A14 ---------------------------------------------------------------------------
@register(
    "A14",
    """SELECT user_id, event_id, ts, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def a14_earliest_row_per_key(spark, sf):
    e = d.table(spark, sf, "events")
    return finish(aggs.earliest_per_key(e, ["user_id"], ["ts", "event_id"], ["event_id", "ts", "event_type", "value", "props"]))


# A15 ---------------------------------------------------------------------------
@register("A15", f"SELECT store_id, count(DISTINCT device_id) AS distinct_count FROM {SQL_SENSORS} GROUP BY ALL")
def a15_distinct_devices(spark, sf):
    """Exact distinct devices per store (the oracle-checked form)."""
    return aggs.distinct_count(d.sensors(spark, sf), ["store_id"], "device_id")


@register("A15_approx")
def a15_approx_distinct_devices(spark, sf):
    """HyperLogLog++ devices per store (dcount); fixed-size state per store."""
    return aggs.distinct_count(d.sensors(spark, sf), ["store_id"], "device_id", approx=True)


# A16 ---------------------------------------------------------------------------
@register(
    "A16",
    """SELECT CAST(ts AS DATE) AS day, CAST(count_if(event_type = 'error') AS BIGINT) AS hits, count(*) AS total,
  CAST(count_if(event_type = 'error') AS DOUBLE) / count(*) AS error_rate FROM events GROUP BY ALL""",
)
def a16_conditional_rate(spark, sf):
    e = d.table(spark, sf, "events")
    return finish(aggs.conditional_rate(e, [F.to_date("ts").alias("day")], F.col("event_type") == "error", "error_rate"))


# A17 ---------------------------------------------------------------------------
@register(
    "A17",
    f"SELECT store_id, count(DISTINCT product_id) AS distinct_count FROM {SQL_LINES} GROUP BY ALL",
)
def a17_exact_distinct(spark, sf):
    return aggs.distinct_count(d.lines(spark, sf), ["store_id"], "product_id")


# A18 ---------------------------------------------------------------------------
@register(
    "A18",
    f"""SELECT tender_type, round(quantile_cont(total_cents, 0.5), 4) AS p50, round(quantile_cont(total_cents, 0.9), 4) AS p90
FROM {SQL_RECEIPTS} GROUP BY ALL""",
)
def a18_percentiles(spark, sf):
    return finish(aggs.percentiles(d.receipts(spark, sf), ["tender_type"], "total_cents", (0.5, 0.9)), 4)


# A19 ---------------------------------------------------------------------------
@register(
    "A19",
    f"""SELECT store_id, count(*) AS receipts, CAST(sum(basket_cents) AS BIGINT) AS revenue_cents,
  round(avg(line_count), 4) AS avg_lines FROM (
  SELECT store_id, receipt_id, sum(ext_cents) AS basket_cents, count(*) AS line_count FROM {SQL_LINES} GROUP BY ALL)
GROUP BY ALL""",
)
def a19_two_level(spark, sf):
    """Receipt grain first, then store: a receipt is counted once per store."""
    out = aggs.two_level(
        d.lines(spark, sf),
        ["store_id", "receipt_id"],
        ["store_id"],
        [F.sum("ext_cents").alias("basket_cents"), F.count(F.lit(1)).alias("line_count")],
        [F.count(F.lit(1)).alias("receipts"), F.sum("basket_cents").alias("revenue_cents"), F.avg("line_count").alias("avg_lines")],
    )
    return finish(out, 4)


# A20 ---------------------------------------------------------------------------
@register(
    "A20",
    f"""WITH a AS (SELECT max(event_date) AS as_of FROM {SQL_LINES})
SELECT product_id,
  CAST(sum(CASE WHEN days_ago >= 0 AND days_ago < 7 THEN quantity ELSE 0 END) AS BIGINT) AS demand_7d,
  CAST(sum(CASE WHEN days_ago >= 0 AND days_ago < 14 THEN quantity ELSE 0 END) AS BIGINT) AS demand_14d,
  CAST(sum(CASE WHEN days_ago >= 0 AND days_ago < 30 THEN quantity ELSE 0 END) AS BIGINT) AS demand_30d
FROM (SELECT product_id, quantity, date_diff('day', event_date, (SELECT as_of FROM a)) AS days_ago FROM {SQL_LINES})
GROUP BY ALL""",
)
def a20_conditional_window_sums(spark, sf):
    li = d.lines(spark, sf)
    as_of = scalar(li, F.max("event_date"))
    x = li.withColumn("days_ago", F.datediff(F.lit(as_of), F.col("event_date")))
    return aggs.conditional_window_sums(x, ["product_id"], "days_ago", "quantity")


# A21 ---------------------------------------------------------------------------
@register(
    "A21",
    f"""WITH a AS (SELECT max(event_date) AS as_of FROM {SQL_RECEIPTS})
SELECT customer_id, max(event_date) AS last_date, min(event_date) AS first_date, count(DISTINCT receipt_id) AS frequency,
  CAST(sum(total_cents) AS BIGINT) AS monetary_cents,
  CAST(date_diff('day', max(event_date), (SELECT as_of FROM a)) AS INTEGER) AS recency_days,
  CAST(sum(total_cents) AS DOUBLE) / 100 AS monetary,
  CAST(sum(total_cents) AS DOUBLE) / 100 / count(DISTINCT receipt_id) AS avg_order_value
FROM {SQL_RECEIPTS} WHERE customer_id IS NOT NULL GROUP BY customer_id HAVING sum(total_cents) > 0""",
)
def a21_rfm(spark, sf):
    r = d.receipts(spark, sf)
    as_of = scalar(r, F.max("event_date"))
    return finish(aggs.rfm(r, "customer_id", "event_ts", "total_cents", "receipt_id", F.lit(as_of)))


# A22 ---------------------------------------------------------------------------
@register(
    "A22",
    f"""WITH a AS (SELECT max(event_date) AS as_of FROM {SQL_RECEIPTS})
SELECT customer_id, count(*) AS orders, CAST(sum(total_cents) AS BIGINT) AS spend_cents,
  avg(total_cents) AS avg_cents, min(total_cents) AS min_cents, max(total_cents) AS max_cents,
  round(stddev_samp(total_cents), 4) AS std_cents, count(DISTINCT tender_type) AS tenders,
  count(DISTINCT event_date) AS active_days, CAST(count_if(status = 'F') AS BIGINT) AS fulfilled,
  CAST(date_diff('day', max(event_date), (SELECT as_of FROM a)) AS INTEGER) AS recency_days,
  CAST(date_diff('day', min(event_date), max(event_date)) AS INTEGER) AS tenure_days,
  CAST(count(*) AS DOUBLE) / (date_diff('day', min(event_date), max(event_date)) + 1) AS frequency_per_day
FROM {SQL_RECEIPTS} GROUP BY customer_id""",
)
def a22_behaviour_features(spark, sf):
    r = d.receipts(spark, sf)
    as_of = scalar(r, F.max("event_date"))
    g = r.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("total_cents").alias("spend_cents"),
        F.avg("total_cents").alias("avg_cents"),
        F.min("total_cents").alias("min_cents"),
        F.max("total_cents").alias("max_cents"),
        F.stddev_samp("total_cents").alias("std_cents"),
        F.count_distinct("tender_type").alias("tenders"),
        F.count_distinct("event_date").alias("active_days"),
        F.count_if(F.col("status") == "F").alias("fulfilled"),
        F.max("event_date").alias("_last"),
        F.min("event_date").alias("_first"),
    )
    g = (
        g.withColumn("recency_days", F.datediff(F.lit(as_of), "_last"))
        .withColumn("tenure_days", F.datediff("_last", "_first"))
        .withColumn("frequency_per_day", F.col("orders") / (F.col("tenure_days") + 1))
        .drop("_last", "_first")
    )
    return finish(g.withColumn("std_cents", F.round("std_cents", 4)))


SQL_DAILY = f"""(SELECT product_id, event_date AS sale_date, CAST(sum(quantity) AS BIGINT) AS units,
  CAST(sum(ext_cents) AS BIGINT) AS revenue_cents FROM {SQL_LINES} WHERE receipt_type = 'SALE' GROUP BY ALL)"""


def daily(spark, sf):
    li = d.lines(spark, sf).where(F.col("receipt_type") == "SALE")
    return aggs.daily_sales(li, ["product_id"], "event_ts", "quantity", "ext_cents")


# A23 ---------------------------------------------------------------------------
@register(
    "A23",
    f"""SELECT product_id, min(sale_date) AS first_sale, max(sale_date) AS last_sale, count(*) AS days_sold,
  avg(units) AS avg_daily, CAST(date_diff('day', min(sale_date), max(sale_date)) AS INTEGER) AS history_days
FROM {SQL_DAILY} GROUP BY product_id
HAVING date_diff('day', min(sale_date), max(sale_date)) >= 30 AND avg(units) >= 0.5""",
)
def a23_history_qualification(spark, sf):
    return finish(aggs.history_qualified(daily(spark, sf), ["product_id"], "sale_date", "units"))


# A24 ---------------------------------------------------------------------------
@register(
    "A24",
    f"""SELECT store_id, product_id, event_date AS sale_date, CAST(sum(quantity) AS BIGINT) AS units,
  CAST(sum(ext_cents) AS BIGINT) AS revenue_cents FROM {SQL_LINES} GROUP BY ALL""",
)
def a24_daily_sales(spark, sf):
    return aggs.daily_sales(d.lines(spark, sf), ["store_id", "product_id"], "event_ts", "quantity", "ext_cents")


# A25 ---------------------------------------------------------------------------
@register(
    "A25",
    f"""SELECT product_id, CAST(sum(revenue_cents) AS BIGINT) AS revenue_total, count(DISTINCT sale_date) AS days_sold
FROM {SQL_DAILY} GROUP BY product_id HAVING count(DISTINCT sale_date) >= 30
ORDER BY revenue_total DESC, product_id LIMIT 100""",
)
def a25_top_sellers(spark, sf):
    return aggs.top_sellers(daily(spark, sf), "product_id", "sale_date", "revenue_cents", 100, 30)


# A26 ---------------------------------------------------------------------------
@register(
    "A26",
    f"""SELECT product_id, round(regr_slope(ln(units), ln(price)), 4) AS slope, round(regr_intercept(ln(units), ln(price)), 4) AS intercept,
  CAST(regr_count(ln(units), ln(price)) AS BIGINT) AS n, round(regr_r2(ln(units), ln(price)), 4) AS r2, round(var_samp(ln(price)), 4) AS var_x
FROM (SELECT product_id, event_date, sum(quantity) AS units, avg(unit_cents) AS price FROM {SQL_LINES}
  WHERE receipt_type = 'SALE' GROUP BY ALL) GROUP BY product_id""",
)
def a26_regression_slope(spark, sf):
    li = d.lines(spark, sf).where(F.col("receipt_type") == "SALE")
    day = li.groupBy("product_id", "event_date").agg(F.sum("quantity").alias("units"), F.avg("unit_cents").alias("price"))
    x = day.select("product_id", F.ln("units").alias("ly"), F.ln("price").alias("lx"))
    return finish(aggs.regression_slope(x, ["product_id"], "ly", "lx"), 4)


# A27 ---------------------------------------------------------------------------
@register(
    "A27",
    f"""SELECT receipt_id, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS items,
  CAST(len(list_distinct(list(p_type))) AS INTEGER) AS n_items
FROM {SQL_LINES} l JOIN part ON l.product_id = p_partkey WHERE receipt_type = 'SALE'
GROUP BY receipt_id HAVING len(list_distinct(list(p_type))) >= 2""",
)
def a27_baskets(spark, sf):
    li = d.lines(spark, sf).where(F.col("receipt_type") == "SALE")
    p = d.products(spark, sf).select("product_id", "department")
    b = aggs.baskets(li.join(p, "product_id", "inner"), "receipt_id", "department")
    return b.select("receipt_id", F.array_join("items", ",").alias("items"), F.size("items").alias("n_items"))


# A28 ---------------------------------------------------------------------------
@register(
    "A28",
    """SELECT user_id, day, path, path_len FROM (
  SELECT user_id, day, first(from_state ORDER BY ts, event_id) || '>' || string_agg(to_state, '>' ORDER BY ts, event_id) AS path,
    CAST(count(*) + 1 AS INTEGER) AS path_len
  FROM (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id,
      lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS from_state, event_type AS to_state
    FROM events) WHERE from_state IS NOT NULL AND from_state <> to_state GROUP BY ALL) WHERE path_len >= 2""",
)
def a28_ordered_path(spark, sf):
    """Zone path per (device, day): first from-zone, then each to-zone."""
    e = d.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    ch = windows.changes(e, ["user_id", "day"], "ts", "event_id", "event_type")
    ch = ch.withColumn("_o", F.struct("ts", "event_id"))
    return aggs.ordered_path(ch, ["user_id", "day"], "_o", "from_state", "to_state")


# A29 ---------------------------------------------------------------------------
@register(
    "A29",
    f"""SELECT receipt_id, promo_code, CAST(sum(disc) AS BIGINT) AS discount_cents, count(DISTINCT product_id) AS product_count,
  array_to_string(list_sort(list_distinct(list(CAST(product_id AS VARCHAR)))), ',') AS product_ids,
  CAST(sum(quantity) AS BIGINT) AS quantity,
  CASE WHEN count(DISTINCT product_id) > 1 THEN 'BASKET' ELSE 'ITEM' END AS discount_type
FROM (SELECT *, CAST(round(ext_cents * discount) AS BIGINT) AS disc FROM {SQL_LINES}) WHERE promo_code IS NOT NULL GROUP BY ALL""",
)
def a29_promo_rollup(spark, sf):
    li = d.lines(spark, sf).withColumn("disc", F.round(F.col("ext_cents") * F.col("discount")).cast("bigint"))
    return aggs.promo_rollup(li, "receipt_id", "promo_code", "product_id", "disc", "quantity")


# A30 ---------------------------------------------------------------------------
@register(
    "A30",
    f"""SELECT receipt_id, subtotal_cents, tax_cents, line_count, total_cents FROM {SQL_ORDER_TOTALS}""",
)
def a30_header_rollup(spark, sf):
    return order_totals(spark, sf).select("receipt_id", "subtotal_cents", "tax_cents", "line_count", "total_cents")


# A31 ---------------------------------------------------------------------------
@register(
    "A31",
    f"""SELECT product_id, CAST(sum(on_hand) AS BIGINT) AS total_on_hand, max(on_hand) AS max_store_on_hand,
  count(*) AS stores, max(as_of) AS latest FROM {_SQL_POSITIONS} GROUP BY product_id""",
)
def a31_product_inventory(spark, sf):
    pos = _store_positions(spark, sf)
    return pos.groupBy("product_id").agg(
        F.sum("on_hand").alias("total_on_hand"), F.max("on_hand").alias("max_store_on_hand"), F.count(F.lit(1)).alias("stores"), F.max("as_of").alias("latest")
    )


# A32 ---------------------------------------------------------------------------
@register(
    "A32",
    f"""WITH a AS (SELECT max(sale_date) AS as_of FROM {SQL_DAILY})
SELECT product_id, CAST(sum(CASE WHEN date_diff('day', sale_date, (SELECT as_of FROM a)) < 30 THEN units ELSE 0 END) AS BIGINT) AS units_30d,
  CAST(sum(CASE WHEN date_diff('day', sale_date, (SELECT as_of FROM a)) < 30 THEN units ELSE 0 END) AS DOUBLE) / 30 AS velocity,
  CAST(date_diff('day', min(sale_date), (SELECT as_of FROM a)) AS INTEGER) AS age_days,
  CAST(date_diff('day', max(sale_date), (SELECT as_of FROM a)) AS INTEGER) AS days_since_last_sale
FROM {SQL_DAILY} GROUP BY product_id""",
)
def a32_velocity_age(spark, sf):
    dl = daily(spark, sf)
    as_of = F.lit(scalar(dl, F.max("sale_date")))
    recent = F.when(F.datediff(as_of, "sale_date") < 30, F.col("units")).otherwise(F.lit(0))
    g = dl.groupBy("product_id").agg(F.sum(recent).alias("units_30d"), F.min("sale_date").alias("_f"), F.max("sale_date").alias("_l"))
    return finish(
        g.select(
            "product_id",
            "units_30d",
            (F.col("units_30d") / 30).alias("velocity"),
            F.datediff(as_of, "_f").alias("age_days"),
            F.datediff(as_of, "_l").alias("days_since_last_sale"),
        )
    )


# A33 ---------------------------------------------------------------------------
@register(
    "A33",
    """SELECT 'orders' AS source, count(*) AS rows, max(o_orderdate) AS latest FROM orders
UNION ALL SELECT 'lineitem', count(*), max(l_shipdate) FROM lineitem
UNION ALL SELECT 'events', count(*), max(ts) FROM events""",
)
def a33_freshness(spark, sf):
    t = lambda n: d.table(spark, sf, n)
    return aggs.freshness(
        {
            "orders": t("orders").select(F.col("o_orderdate").alias("ts")),
            "lineitem": t("lineitem").select(F.col("l_shipdate").alias("ts")),
            "events": t("events").select("ts"),
        },
        "ts",
    )


# A34 ---------------------------------------------------------------------------
@register(
    "A34",
    """SELECT date_trunc('hour', ts) AS hour, CASE event_type WHEN 'click' THEN 'approved' ELSE 'rejected' END AS decision,
  count(*) AS decisions FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL""",
)
def a34_hourly_decisions(spark, sf):
    """Approvals (click) and rejections (error) per hour, from a tagged union."""
    e = d.table(spark, sf, "events")
    u = aggs.tagged_union({"approved": e.where(F.col("event_type") == "click"), "rejected": e.where(F.col("event_type") == "error")}, "ts")
    return u.groupBy(aggs.bucket_ts("ts", "hour").alias("hour"), F.col("source").alias("decision")).agg(F.count(F.lit(1)).alias("decisions"))


# A35 ---------------------------------------------------------------------------
def _sql_drill(name: str, source: str, levels: list[str]) -> str:
    cols = ", ".join(f"CAST({x} AS VARCHAR) AS level_{i + 1}" for i, x in enumerate(levels))
    pad = "".join(f", NULL::VARCHAR AS level_{i + 1}" for i in range(len(levels), 4))
    return f"""SELECT '{name}' AS hierarchy, {cols}{pad}, CAST(sum(cents) AS BIGINT) AS revenue_cents, count(*) AS rows,
  CAST(grouping({", ".join(levels)}) AS BIGINT) AS grouping_level FROM {source} GROUP BY ROLLUP ({", ".join(levels)})"""


@register(
    "A35",
    _sql_drill("calendar", f"(SELECT year(event_ts) AS y, quarter(event_ts) AS q, month(event_ts) AS m, CAST(event_ts AS DATE) AS d, total_cents AS cents FROM {SQL_RECEIPTS})", ["y", "q", "m", "d"])
    + " UNION ALL "
    + _sql_drill("product", f"(SELECT p_type, p_brand, product_id, ext_cents AS cents FROM {SQL_LINES} JOIN part ON product_id = p_partkey)", ["p_type", "p_brand", "product_id"]),
)
def a35_drill_rollup(spark, sf):
    """Drill totals along the calendar (year, quarter, month, date) and the product
    hierarchy (department, brand, product); levels as text, null where rolled up."""
    ts = F.col("event_ts")
    calendar = d.receipts(spark, sf).select(F.year(ts).alias("level_1"), F.quarter(ts).alias("level_2"), F.month(ts).alias("level_3"), F.to_date(ts).alias("level_4"), F.col("total_cents").alias("cents"))
    part = d.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("level_1"), F.col("p_brand").alias("level_2"))
    product = d.lines(spark, sf).join(part, "product_id").select("level_1", "level_2", F.col("product_id").alias("level_3"), F.col("ext_cents").alias("cents"))
    out = []
    for name, x, n in (("calendar", calendar, 4), ("product", product, 3)):
        levels = [f"level_{i + 1}" for i in range(n)]
        g = aggs.hierarchy_rollup(x, levels, [F.sum("cents").alias("revenue_cents"), F.count(F.lit(1)).alias("rows")])
        shown = [(F.col(f"level_{i + 1}").cast("string") if i < n else F.lit(None).cast("string")).alias(f"level_{i + 1}") for i in range(4)]
        out.append(g.select(F.lit(name).alias("hierarchy"), *shown, "revenue_cents", "rows", "grouping_level"))
    return out[0].unionByName(out[1])


# A36 ---------------------------------------------------------------------------
@register(
    "A36",
    f"""SELECT CAST(year(event_ts) AS INTEGER) AS year, CAST(sum(total_cents) AS BIGINT) AS total_cents,
  CAST(sum(total_cents) AS DOUBLE) / 100 AS total_sales FROM {SQL_RECEIPTS} GROUP BY ALL""",
)
def a36_cents_sum(spark, sf):
    r = d.receipts(spark, sf)
    return finish(r.groupBy(F.year("event_ts").alias("year")).agg(F.sum("total_cents").alias("total_cents"), (F.sum("total_cents") / 100).alias("total_sales")))
