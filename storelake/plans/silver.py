"""Bronze -> Silver and Silver -> OLTP projections (P01–P41) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelake.functions import money
from storelake.operators import aggs, projections as pj
from storelake.plans.common import SQL_EVENTS, SQL_LINES, SQL_RECEIPTS, SQL_RECEIPTS_STORE, finish, nullable_ids_as_double
from storelake.plans.registry import register
from storelake.sources import driver as d


def _txt(c):
    return money.cents_to_text(c)


_SQL_TXT = "(CASE WHEN {c} < 0 THEN '-' ELSE '' END || CAST(abs({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


def sql_txt(c: str) -> str:
    return _SQL_TXT.format(c=c)


@register("P01", "SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity) FROM lineitem")
def p01_cast_ids(spark, sf):
    """Cast only the columns that exist (the missing one is skipped)."""
    return pj.cast_ids(d.table(spark, sf, "lineitem"), {"l_linenumber": "bigint", "l_quantity": "bigint", "l_missing": "int"})


@register("P03", "SELECT event_id, event_type FROM events")
def p03_normalise_names(spark, sf):
    """Drifted schema: a legacy 'EventType' column next to a partly NULL
    'event_type'; coalesce then drop the legacy spelling."""
    e = d.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("EventType"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type")
    )
    return pj.normalise_names(e, {"eventtype": "event_type"})


@register("P04", "SELECT event_id, ts, CAST(ts AS DATE) AS event_date FROM events")
def p04_derive_event_date(spark, sf):
    e = d.table(spark, sf, "events").select("event_id", "ts", F.lit(None).cast("date").alias("event_date"))
    return pj.derive_event_date(e, "ts")


_SQL_RCP = "(SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'RCP' || strftime(o_orderdate, '%Y%m%d%H%M') ELSE 'ORD' || CAST(o_orderkey AS VARCHAR) END AS rid FROM orders)"


@register(
    "P05",
    f"SELECT o_orderkey, rid, CASE WHEN regexp_matches(rid, '^RCP[0-9]{{12}}') THEN try_strptime(substring(rid, 4, 12), '%Y%m%d%H%M') END AS ts_from_id FROM {_SQL_RCP}",
)
def p05_ts_from_id(spark, sf):
    o = d.table(spark, sf, "orders")
    rid = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("RCP"), F.date_format("o_orderdate", "yyyyMMddHHmm"))).otherwise(
        F.concat(F.lit("ORD"), F.col("o_orderkey").cast("string"))
    )
    x = o.select("o_orderkey", rid.alias("rid"))
    return finish(x.withColumn("ts_from_id", pj.ts_from_id("rid")))


@register(
    "P06",
    f"""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 100 AS DOUBLE) AS amount,
  {sql_txt('CAST(round(o_totalprice * 100) AS BIGINT)')} AS amount_text FROM orders""",
)
def p06_p08_money(spark, sf):
    """P06 to_cents, P07 cents_to_decimal (decimal(19,4), shown as double), P08 '%.2f' text."""
    o = d.table(spark, sf, "orders").select("o_orderkey", money.to_cents("o_totalprice").alias("cents"))
    return finish(o.select("o_orderkey", "cents", money.cents_to_decimal("cents").alias("amount"), _txt("cents").alias("amount_text")))


@register("P07", f"SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 100 AS DOUBLE) AS amount FROM orders")
def p07_cents_to_decimal(spark, sf):
    o = d.table(spark, sf, "orders").select("o_orderkey", money.to_cents("o_totalprice").alias("cents"))
    return finish(o.select("o_orderkey", money.cents_to_decimal("cents").alias("amount")))


@register("P08", f"SELECT o_orderkey, {sql_txt('CAST(round(o_totalprice * 100) AS BIGINT)')} AS amount_text FROM orders")
def p08_cents_to_text(spark, sf):
    o = d.table(spark, sf, "orders").select("o_orderkey", money.to_cents("o_totalprice").alias("cents"))
    return o.select("o_orderkey", _txt("cents").alias("amount_text"))


def silver_receipts(spark, sf):
    r = d.receipts(spark, sf, with_store=True)
    return r.select(
        F.concat(F.lit("RCP-"), F.lpad(F.col("receipt_id").cast("string"), 10, "0")).alias("receipt_id_ext"), "event_ts", "event_date", "store_id", "customer_id",
        F.coalesce(F.when(F.col("status") == "P", "PENDING"), F.lit("SALE")).alias("receipt_type"), F.col("tender_type").alias("payment_method"),
        "total_cents", _txt("total_cents").alias("total_amount"),
    )


@register(
    "P09",
    f"""SELECT 'RCP-' || lpad(CAST(receipt_id AS VARCHAR), 10, '0') AS receipt_id_ext, event_ts, event_date, store_id, customer_id,
  CASE WHEN status = 'P' THEN 'PENDING' ELSE 'SALE' END AS receipt_type, tender_type AS payment_method, total_cents, {sql_txt('total_cents')} AS total_amount
FROM {SQL_RECEIPTS_STORE}""",
)
def p09_silver_receipts(spark, sf):
    """Silver receipts: renames, default type SALE, text and cent money."""
    return silver_receipts(spark, sf)


@register(
    "P10",
    f"""SELECT 'RCP-' || lpad(CAST(receipt_id AS VARCHAR), 10, '0') AS receipt_id_ext, line_num, product_id, quantity, unit_cents, {sql_txt('unit_cents')} AS unit_price,
  ext_cents, {sql_txt('ext_cents')} AS ext_price, promo_code, event_ts, event_date FROM {SQL_LINES}""",
)
def p10_silver_lines(spark, sf):
    li = d.lines(spark, sf)
    return li.select(
        F.concat(F.lit("RCP-"), F.lpad(F.col("receipt_id").cast("string"), 10, "0")).alias("receipt_id_ext"), "line_num", "product_id", "quantity",
        "unit_cents", _txt("unit_cents").alias("unit_price"), "ext_cents", _txt("ext_cents").alias("ext_price"), "promo_code", "event_ts", "event_date",
    )


def silver_payments(spark, sf):
    r = d.receipts(spark, sf)
    return r.select(
        F.concat(F.lit("RCP-"), F.lpad(F.col("receipt_id").cast("string"), 10, "0")).alias("receipt_id_ext"), F.lit(None).cast("string").alias("order_id_ext"),
        "event_ts", "event_date", F.col("tender_type").alias("payment_method"), F.col("total_cents").alias("amount_cents"), _txt("total_cents").alias("amount"),
        F.concat(F.lit("TX"), F.col("receipt_id").cast("string")).alias("transaction_id"),
        F.when(F.col("status") == "P", "DECLINED").otherwise("APPROVED").alias("status"), "customer_id",
    )


_SQL_PAY = f"""(SELECT 'RCP-' || lpad(CAST(receipt_id AS VARCHAR), 10, '0') AS receipt_id_ext, NULL::VARCHAR AS order_id_ext, event_ts, event_date,
  tender_type AS payment_method, total_cents AS amount_cents, {sql_txt('total_cents')} AS amount, 'TX' || CAST(receipt_id AS VARCHAR) AS transaction_id,
  CASE WHEN status = 'P' THEN 'DECLINED' ELSE 'APPROVED' END AS status, customer_id FROM {SQL_RECEIPTS})"""


@register("P11", f"SELECT * FROM {_SQL_PAY}")
def p11_silver_payments(spark, sf):
    return silver_payments(spark, sf)


@register(
    "P12",
    """SELECT store_id, product_id, event_ts, txn_id, qty AS quantity, CASE reason WHEN 'R' THEN 'RETURN' ELSE 'SALE' END AS txn_type,
  CAST(sum(qty) OVER (PARTITION BY store_id, product_id ORDER BY event_ts, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM (
  SELECT l_suppkey AS store_id, l_partkey AS product_id, l_shipdate AS event_ts, l_returnflag AS reason,
    concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS txn_id,
    CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS qty FROM lineitem)""",
)
def p12_silver_inventory(spark, sf):
    """Inventory movements; the balance the stream lacks is filled by the
    running balance (W05, G13)."""
    from storelake.plans.windows import balances

    b = balances(spark, sf)
    return b.select("store_id", "product_id", "event_ts", "txn_id", F.col("qty").alias("quantity"), F.when(F.col("reason") == "R", "RETURN").otherwise("SALE").alias("txn_type"), "balance")


@register(
    "P13",
    f"""SELECT k AS store_id, 'S' || CAST(user_id AS VARCHAR) AS sensor_id, event_type AS zone, CAST(round(value) AS BIGINT) AS dwell_seconds,
  1 AS count, ts AS event_ts, CAST(ts AS DATE) AS event_date FROM {SQL_EVENTS}""",
)
def p13_silver_foot_traffic(spark, sf):
    s = d.sensors(spark, sf)
    return s.select(
        "store_id", F.concat(F.lit("S"), F.col("device_id").cast("string")).alias("sensor_id"), "zone", F.round("dwell_seconds").cast("bigint").alias("dwell_seconds"),
        F.lit(1).alias("count"), "event_ts", F.to_date("event_ts").alias("event_date"),
    )


@register(
    "P14",
    """SELECT store_id, NULL::DOUBLE AS dc_id, product_id, last_known_quantity, event_ts, CAST(event_ts AS DATE) AS event_date FROM (
  SELECT *, balance - qty AS prev FROM (SELECT *, CAST(sum(qty) OVER (PARTITION BY store_id, product_id ORDER BY event_ts, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance,
    abs(qty) AS last_known_quantity FROM (SELECT l_suppkey AS store_id, l_partkey AS product_id, l_shipdate AS event_ts,
    concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS txn_id,
    CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS qty FROM lineitem)))
WHERE balance <= 0 AND prev > 0 QUALIFY row_number() OVER (PARTITION BY store_id, product_id, CAST(event_ts AS DATE) ORDER BY event_ts, txn_id) = 1""",
)
def p14_silver_stockouts(spark, sf):
    from storelake.plans.named import stockouts

    s = stockouts(spark, sf)
    return s.select("store_id", F.lit(None).cast("double").alias("dc_id"), "product_id", "last_known_quantity", "event_ts", F.to_date("event_ts").alias("event_date"))


@register("P15", None)
def p15_silver_reorders(spark, sf):
    from storelake.plans.reaimed import reorder_signals

    r = reorder_signals(spark, sf)
    return r.select("store_id", F.lit(None).cast("bigint").alias("dc_id"), "product_id", "current_quantity", "reorder_quantity", "reorder_point", "priority", "event_ts", F.col("day").alias("event_date"))


@register(
    "P16",
    f"""SELECT store_id, min(event_ts) AS event_ts, 'OPENED' AS operation_type, event_date FROM {SQL_RECEIPTS_STORE} GROUP BY store_id, event_date
UNION ALL SELECT store_id, max(event_ts), 'CLOSED', event_date FROM {SQL_RECEIPTS_STORE} GROUP BY store_id, event_date""",
)
def p16_store_ops(spark, sf):
    """Store operations from two sources (first and last receipt of the day)
    with a literal operation type, unioned."""
    r = d.receipts(spark, sf, with_store=True)
    opened = r.groupBy("store_id", "event_date").agg(F.min("event_ts").alias("event_ts")).withColumn("operation_type", F.lit("OPENED"))
    closed = r.groupBy("store_id", "event_date").agg(F.max("event_ts").alias("event_ts")).withColumn("operation_type", F.lit("CLOSED"))
    return opened.unionByName(closed)


@register(
    "P17",
    f"""SELECT 'web' AS channel, CAST(k AS VARCHAR) AS campaign_id, 'AD' || CAST(user_id AS VARCHAR) AS customer_ad_id, CAST(round(value * 100) AS BIGINT) AS cost_cents,
  {sql_txt('CAST(round(value * 100) AS BIGINT)')} AS cost, ts AS event_ts, CAST(ts AS DATE) AS event_date FROM {SQL_EVENTS} WHERE event_type = 'view'""",
)
def p17_silver_marketing(spark, sf):
    m = d.marketing(spark, sf)
    return m.select(
        F.lit("web").alias("channel"), F.col("campaign_id").cast("string").alias("campaign_id"), F.concat(F.lit("AD"), F.col("customer_id").cast("string")).alias("customer_ad_id"),
        "cost_cents", _txt("cost_cents").alias("cost"), "event_ts", F.to_date("event_ts").alias("event_date"),
    )


@register(
    "P18",
    f"""SELECT receipt_id, promo_code, array_to_string(list_sort(list_distinct(list(CAST(product_id AS VARCHAR)))), ',') AS product_ids,
  count(DISTINCT product_id) AS product_count, min(event_date) AS event_date FROM {SQL_LINES} WHERE promo_code IS NOT NULL GROUP BY ALL""",
)
def p18_silver_promotions(spark, sf):
    """Promotions with the product id array rendered as text."""
    li = d.lines(spark, sf).where(F.col("promo_code").isNotNull())
    g = li.groupBy("receipt_id", "promo_code").agg(F.sort_array(F.collect_set(F.col("product_id").cast("string"))).alias("ids"), F.count_distinct("product_id").alias("product_count"), F.min("event_date").alias("event_date"))
    return g.select("receipt_id", "promo_code", F.array_join("ids", ",").alias("product_ids"), "product_count", "event_date")


@register(
    "P19",
    """SELECT * FROM (SELECT 'BLE' || CAST(user_id AS VARCHAR) AS customer_ble_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_zone,
  event_type AS to_zone, ts AS event_ts, CAST(ts AS DATE) AS event_date FROM events) WHERE from_zone IS NOT NULL AND from_zone <> to_zone""",
)
def p19_silver_zone_changes(spark, sf):
    from storelake.operators import windows

    e = d.table(spark, sf, "events")
    ch = windows.changes(e, ["user_id"], "ts", "event_id", "event_type", "from_zone", "to_zone")
    return ch.select(F.concat(F.lit("BLE"), F.col("user_id").cast("string")).alias("customer_ble_id"), "from_zone", "to_zone", F.col("ts").alias("event_ts"), F.to_date("ts").alias("event_date"))


@register(
    "P20",
    f"""SELECT k AS store_id, 'B-' || event_type AS beacon_id, 'BLE' || CAST(user_id AS VARCHAR) AS customer_ble_id, CAST(-round(value) AS BIGINT) AS rssi,
  event_type AS zone, ts AS event_ts, CAST(ts AS DATE) AS event_date FROM {SQL_EVENTS}""",
)
def p20_silver_ble(spark, sf):
    s = d.sensors(spark, sf)
    return s.select(
        "store_id", F.concat(F.lit("B-"), F.col("zone")).alias("beacon_id"), F.concat(F.lit("BLE"), F.col("device_id").cast("string")).alias("customer_ble_id"),
        (-F.round("dwell_seconds")).cast("bigint").alias("rssi"), "zone", "event_ts", F.to_date("event_ts").alias("event_date"),
    )


@register("P21", None)
def p21_online_headers(spark, sf):
    """Online order headers from the order totals (R13) with text money."""
    from storelake.plans.gold import order_totals

    t = order_totals(spark, sf)
    return t.select(
        F.concat(F.lit("ORD-"), F.col("receipt_id").cast("string")).alias("order_id_ext"), "customer_id", "subtotal_cents", "tax_cents", "total_cents",
        _txt("subtotal_cents").alias("subtotal_amount"), _txt("tax_cents").alias("tax_amount"), _txt("total_cents").alias("total_amount"),
        F.col("tender_type").alias("payment_method"), "event_ts", F.to_date("event_ts").alias("event_date"),
    )


@register(
    "P22",
    """SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS order_id_ext, 'PICKED' AS fulfillment_status, o_orderdate AS picked_ts, NULL::TIMESTAMP AS shipped_ts FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'ORD-' || CAST(l_orderkey AS VARCHAR), 'SHIPPED', NULL, max(l_shipdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_orderkey""",
)
def p22_order_status(spark, sf):
    """Order status rows from picked and shipped sources with different
    columns (unionByName with missing columns)."""
    o = d.table(spark, sf, "orders")
    picked = o.where(F.col("o_orderstatus") == "P").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_id_ext"), F.lit("PICKED").alias("fulfillment_status"), F.col("o_orderdate").alias("picked_ts"))
    li = d.table(spark, sf, "lineitem").join(o.where(F.col("o_orderstatus") == "F").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    shipped = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped_ts")).select(
        F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("order_id_ext"), F.lit("SHIPPED").alias("fulfillment_status"), "shipped_ts"
    )
    return picked.unionByName(shipped, allowMissingColumns=True)


# ---------------- OLTP projections ----------------
@register("P23", "SELECT CAST(n_nationkey AS BIGINT) AS geography_id, n_name AS state, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def p23_geographies(spark, sf):
    n, r = d.table(spark, sf, "nation"), d.table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("geography_id"), F.col("n_name").alias("state"), F.col("r_name").alias("region"))


@register("P24", "SELECT c_custkey AS customer_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS geography_id, c_mktsegment AS segment FROM customer")
def p24_customers(spark, sf):
    c = d.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("geography_id"), F.col("c_mktsegment").alias("segment"))


@register("P25", "SELECT s_suppkey AS store_id, s_name AS store_number, CAST(s_nationkey AS BIGINT) AS geography_id, CAST(CAST(s_acctbal AS DECIMAL(19,4)) AS DOUBLE) AS balance FROM supplier")
def p25_stores(spark, sf):
    """Stores with decimal(19,4) money (shown as double)."""
    s = d.table(spark, sf, "supplier")
    return finish(s.select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_number"), F.col("s_nationkey").cast("bigint").alias("geography_id"), F.col("s_acctbal").cast("decimal(19,4)").alias("balance")))


@register("P26", "SELECT CAST(n_nationkey AS BIGINT) AS dc_id, 'DC-' || n_name AS dc_number, CAST(n_nationkey AS BIGINT) AS geography_id FROM nation")
def p26_distribution_centers(spark, sf):
    n = d.table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("dc_id"), F.concat(F.lit("DC-"), F.col("n_name")).alias("dc_number"), F.col("n_nationkey").cast("bigint").alias("geography_id"))


@register("P27", "SELECT DISTINCT o_custkey AS truck_id, 'TRK-' || CAST(o_custkey AS VARCHAR) AS license_plate FROM orders")
def p27_trucks(spark, sf):
    return d.table(spark, sf, "orders").select(F.col("o_custkey").alias("truck_id")).distinct().withColumn("license_plate", F.concat(F.lit("TRK-"), F.col("truck_id").cast("string")))


@register("P28", "SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS department, CAST(CAST(p_retailprice AS DECIMAL(19,4)) AS DOUBLE) AS sale_price FROM part")
def p28_products(spark, sf):
    p = d.table(spark, sf, "part")
    return finish(p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("department"), F.col("p_retailprice").cast("decimal(19,4)").alias("sale_price")))


@register(
    "P29",
    f"""SELECT r.receipt_id, r.customer_id, r.event_ts, r.total_cents, p.promo_code FROM {SQL_RECEIPTS} r LEFT JOIN (
  SELECT receipt_id, arg_min(promo_code, (line_num, product_id, store_id)) AS promo_code FROM {SQL_LINES} WHERE promo_code IS NOT NULL GROUP BY 1) p
ON r.receipt_id = p.receipt_id""",
)
def p29_oltp_sales(spark, sf):
    """Sale header with the first non-null promo code of its lines; first =
    lowest line key (min_by), deterministic unlike first(ignorenulls)."""
    li = d.lines(spark, sf).where(F.col("promo_code").isNotNull())
    first = li.groupBy("receipt_id").agg(F.min_by("promo_code", F.struct("line_num", "product_id", "store_id")).alias("promo_code"))
    return d.receipts(spark, sf).select("receipt_id", "customer_id", "event_ts", "total_cents").join(first, "receipt_id", "left")


@register(
    "P30",
    f"""SELECT l.receipt_id, l.line_num, l.product_id, l.store_id, l.ext_cents, coalesce(x.discount_cents, 0) AS discount_cents FROM {SQL_LINES} l LEFT JOIN (
  SELECT receipt_id, line_num, CAST(sum(CAST(round(ext_cents * discount) AS BIGINT)) AS BIGINT) AS discount_cents FROM {SQL_LINES} WHERE promo_code IS NOT NULL GROUP BY ALL) x
ON l.receipt_id = x.receipt_id AND l.line_num = x.line_num""",
)
def p30_oltp_sale_lines(spark, sf):
    """Sale lines with the promo discount summed per (receipt, line) first,
    then a composite-key left join (no fan-out)."""
    li = d.lines(spark, sf)
    disc = li.where(F.col("promo_code").isNotNull()).groupBy("receipt_id", "line_num").agg(F.sum(F.round(F.col("ext_cents") * F.col("discount")).cast("bigint")).alias("discount_cents"))
    return li.select("receipt_id", "line_num", "product_id", "store_id", "ext_cents").join(disc, ["receipt_id", "line_num"], "left").fillna({"discount_cents": 0})


@register("P31", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts, o_orderstatus AS status, o_orderpriority AS payment_method FROM orders")
def p31_online_orders(spark, sf):
    o = d.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_ts"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("payment_method"))


@register(
    "P32",
    f"""SELECT receipt_id AS order_id, line_num, product_id, quantity, unit_cents, ext_cents, CASE WHEN line_status = 'F' THEN 'DELIVERED' ELSE 'OPEN' END AS fulfillment_status,
  'STORE' AS node_type, store_id AS node_id, event_ts AS shipped_ts FROM {SQL_LINES}""",
)
def p32_online_order_lines(spark, sf):
    li = d.lines(spark, sf)
    return li.select(
        F.col("receipt_id").alias("order_id"), "line_num", "product_id", "quantity", "unit_cents", "ext_cents", F.when(F.col("line_status") == "F", "DELIVERED").otherwise("OPEN").alias("fulfillment_status"),
        F.lit("STORE").alias("node_type"), F.col("store_id").alias("node_id"), F.col("event_ts").alias("shipped_ts"),
    )


@register("P33", f"SELECT receipt_id_ext, payment_method, amount_cents, CAST(amount_cents / 100 AS DOUBLE) AS amount, status FROM {_SQL_PAY}")
def p33_oltp_payments(spark, sf):
    p = silver_payments(spark, sf)
    return finish(p.select("receipt_id_ext", "payment_method", "amount_cents", money.cents_to_decimal("amount_cents").alias("amount"), "status"))


@register(
    "P34",
    """SELECT 'STORE' AS location_type, l_suppkey AS location_id, l_partkey AS product_id, l_shipdate AS event_ts,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS quantity FROM lineitem
UNION ALL SELECT 'DC', CAST(s_nationkey AS BIGINT), l_partkey, l_shipdate, CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT)
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
def p34_inventory_txns(spark, sf):
    """Store and DC movements in one table with a location type."""
    led = d.ledger(spark, sf)
    store = led.select(F.lit("STORE").alias("location_type"), F.col("store_id").alias("location_id"), "product_id", "event_ts", F.col("qty").alias("quantity"))
    sup = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_nationkey").cast("bigint").alias("location_id"))
    dc = led.join(sup, "store_id").select(F.lit("DC").alias("location_type"), "location_id", "product_id", "event_ts", F.col("qty").alias("quantity"))
    return store.unionByName(dc)


@register("P35", None)
def p35_oltp_reorders(spark, sf):
    return p15_silver_reorders(spark, sf).drop("event_date")


@register("P36", None)
def p36_oltp_stockouts(spark, sf):
    """Stockouts with double-typed store/DC ids narrowed to long."""
    s = p14_silver_stockouts(spark, sf).select(F.col("store_id").cast("double").alias("StoreID"), F.col("dc_id").cast("double").alias("DCID"), "product_id", "last_known_quantity", "event_ts")
    return s.select(F.col("StoreID").cast("bigint").alias("store_id"), F.col("DCID").cast("bigint").alias("dc_id"), "product_id", "last_known_quantity", "event_ts")


@register("P37", None)
def p37_shipment_movements(spark, sf):
    return nullable_ids_as_double(d.truck_moves(spark, sf).select("shipment_id", "truck_id", "dc_id", "store_id", "status", "event_ts"), ("dc_id", "store_id"))


@register("P38", "SELECT l_orderkey AS shipment_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, l_suppkey AS location_id FROM lineitem")
def p38_shipment_lines(spark, sf):
    li = d.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("shipment_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_suppkey").alias("location_id"))


@register(
    "P39",
    f"""SELECT l.receipt_id, l.line_num, l.product_id, l.store_id, l.unit_cents, CAST(round(p_retailprice * 100) AS BIGINT) AS regular_cents,
  l.unit_cents < CAST(round(p_retailprice * 100) AS BIGINT) AS is_promoted,
  round(CASE WHEN l.unit_cents < CAST(round(p_retailprice * 100) AS BIGINT) THEN (CAST(round(p_retailprice * 100) AS BIGINT) - l.unit_cents) * 100.0 / CAST(round(p_retailprice * 100) AS BIGINT) ELSE 0.0 END, 4) AS discount_pct
FROM {SQL_LINES} l JOIN part ON l.product_id = p_partkey""",
)
def p39_enrich_lines(spark, sf):
    li = d.lines(spark, sf).select("receipt_id", "line_num", "product_id", "store_id", "unit_cents")
    p = d.products(spark, sf).select("product_id", F.col("msrp_cents").alias("regular_cents"))
    x = pj.enrich_lines(li, p, "product_id", "unit_cents", "regular_cents")
    return finish(x.withColumn("discount_pct", F.when(F.col("is_promoted"), (F.col("regular_cents") - F.col("unit_cents")) * 100.0 / F.col("regular_cents")).otherwise(F.lit(0.0))), 4)


@register(
    "P40",
    f"""SELECT l.receipt_id, l.line_num, l.product_id, l.store_id, coalesce(CASE WHEN l.receipt_type = 'RETURN' THEN NULL ELSE l.event_ts END, r.event_ts) AS event_ts
FROM {SQL_LINES} l LEFT JOIN {SQL_RECEIPTS} r ON l.receipt_id = r.receipt_id""",
)
def p40_propagate_header(spark, sf):
    """Child rows missing their timestamp (returns here) take the header's."""
    li = d.lines(spark, sf).select("receipt_id", "line_num", "product_id", "store_id", F.when(F.col("receipt_type") != "RETURN", F.col("event_ts")).alias("event_ts"))
    return pj.propagate_header_fields(li, d.receipts(spark, sf), "receipt_id", ["event_ts"])


@register("P41", "SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS page_url, NULL::DOUBLE AS product_id, NULL::VARCHAR AS search_terms FROM events")
def p41_clickstream_flatten(spark, sf):
    """Unpack the JSON detail into typed columns (absent keys are NULL)."""
    e = d.table(spark, sf, "events").select("event_id", "user_id", "props")
    out = pj.clickstream_flatten(e, "props", "k long, page_url string, product_id long, search_terms string").drop("props")
    return nullable_ids_as_double(out, ("product_id",))
