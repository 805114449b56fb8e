"""The 145 BI measures (B001–B145) evaluated over the conformed star.

Channel mapping (fixed role choice): store receipts are orders with status F
or P (P = RETURN), online orders are status O; lines follow their order.
Each query below returns one row per group (or one row), one column per
measure, named ``b<id>_<name>``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from storelake.operators.measures import Measure as M, divide0, divide_blank, evaluate, evaluate_sql, sql_divide0, sql_divide_blank
from storelake.plans.common import SQL_LINES, finish
from storelake.plans.registry import register
from storelake.sources import driver as d

c = F.col

# ---------------------------------------------------------------- bases
SQL_STORE_RECEIPTS = """(SELECT o_orderkey AS receipt_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS event_date,
  CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, CASE WHEN o_orderstatus = 'P' THEN 'RETURN' ELSE 'SALE' END AS receipt_type,
  sub AS subtotal_cents, tax AS tax_cents
  FROM orders JOIN (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS sub,
    sum((CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 10000) AS BIGINT) * 100 + 500000) // 1000000) AS tax FROM lineitem GROUP BY 1)
  ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O')"""

SQL_ONLINE = """(SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS event_date, sub AS subtotal_cents, tax AS tax_cents, sub + tax AS total_cents
  FROM orders JOIN (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS sub,
    sum((CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 10000) AS BIGINT) * 100 + 500000) // 1000000) AS tax FROM lineitem GROUP BY 1)
  ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O')"""


def _lines_sql(online: bool) -> str:
    cond = "=" if online else "<>"
    return f"""(SELECT l.*, CAST(round(p_retailprice * 100 * 0.6) AS BIGINT) AS cost_cents, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents
  FROM {SQL_LINES} l JOIN orders ON l.receipt_id = o_orderkey LEFT JOIN part ON l.product_id = p_partkey WHERE o_orderstatus {cond} 'O')"""


def store_receipts(spark, sf):
    """Store receipts (status F/P) with the header total and, from the line
    rollup (R13), subtotal and basis-point tax."""
    from storelake.plans.gold import order_totals

    r = d.receipts(spark, sf).where(c("status") != "O")
    t = order_totals(spark, sf).select("receipt_id", "subtotal_cents", "tax_cents")
    return r.join(t, "receipt_id").select(
        "receipt_id", "customer_id", "event_date", "total_cents", F.when(c("status") == "P", "RETURN").otherwise("SALE").alias("receipt_type"), "subtotal_cents", "tax_cents"
    )


def online_orders(spark, sf):
    from storelake.plans.gold import order_totals

    t = order_totals(spark, sf)
    st = d.receipts(spark, sf).select("receipt_id", "status")
    return t.join(st, "receipt_id").where(c("status") == "O").select(F.col("receipt_id").alias("order_id"), F.to_date("event_ts").alias("event_date"), "subtotal_cents", "tax_cents", "total_cents")


def channel_lines(spark, sf, online: bool):
    li = d.lines(spark, sf)
    st = d.receipts(spark, sf).select("receipt_id", "status")
    p = d.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.round(c("p_retailprice") * 100 * 0.6).cast("bigint").alias("cost_cents"), d.cents("p_retailprice").alias("price_cents"))
    x = li.join(st, "receipt_id").where((c("status") == "O") if online else (c("status") != "O"))
    return x.join(p, "product_id", "left")


def _q(qid, base_fn, base_sql, measures, doc, group_by=()):
    def fn(spark, sf):
        return evaluate(base_fn(spark, sf), measures, group_by)

    fn.__doc__ = doc
    fn.__name__ = qid.lower()
    register(qid, evaluate_sql(base_sql, measures, group_by))(fn)


# ---------------------------------------------------------------- fact_receipts
RECEIPTS = [
    M("B060", "b060_total_sales", lambda: F.sum("total_cents") / 100, "CAST(sum(total_cents) AS DOUBLE) / 100"),
    M("B061", "b061_total_tax", lambda: F.sum("tax_cents") / 100, "CAST(sum(tax_cents) AS DOUBLE) / 100"),
    M("B062", "b062_total_subtotal", lambda: F.sum("subtotal_cents") / 100, "CAST(sum(subtotal_cents) AS DOUBLE) / 100"),
    M("B063", "b063_receipt_count", lambda: F.count(F.lit(1)), "count(*)"),
    M("B065", "b065_total_returns", lambda: F.coalesce(F.sum(F.when(c("receipt_type") == "RETURN", c("total_cents"))), F.lit(0)) / 100,
      "CAST(coalesce(sum(CASE WHEN receipt_type = 'RETURN' THEN total_cents END), 0) AS DOUBLE) / 100"),
    M("B064", "b064_average_basket_size", None, sql_divide0("b060_total_sales", "b063_receipt_count"), lambda: divide0(c("b060_total_sales"), c("b063_receipt_count"))),
    M("B075", "b075_return_rate_pct", None, sql_divide0("abs(b065_total_returns)", "b060_total_sales"), lambda: divide0(F.abs(c("b065_total_returns")), c("b060_total_sales"))),
]
_q("B_receipts", store_receipts, SQL_STORE_RECEIPTS, RECEIPTS, "fact_receipts measures (B060–B065, B075).")

# ---------------------------------------------------------------- fact_receipt_lines
LINES = [
    M("B052", "b052_total_units_sold", lambda: F.sum("quantity"), "CAST(sum(quantity) AS BIGINT)"),
    M("B053", "b053_line_revenue", lambda: F.sum("ext_cents") / 100, "CAST(sum(ext_cents) AS DOUBLE) / 100"),
    M("B055", "b055_total_lines", lambda: F.count(F.lit(1)), "count(*)"),
    M("B056", "b056_line_cost", lambda: F.sum(c("quantity") * F.coalesce(c("cost_cents"), F.lit(0))) / 100, "CAST(sum(quantity * coalesce(cost_cents, 0)) AS DOUBLE) / 100"),
    M("B_rc", "receipts_in_lines", lambda: F.count_distinct("receipt_id"), "count(DISTINCT receipt_id)"),
    M("B054", "b054_average_unit_price", None, sql_divide0("b053_line_revenue", "b052_total_units_sold"), lambda: divide0(c("b053_line_revenue"), c("b052_total_units_sold"))),
    M("B057", "b057_gross_profit", None, "(b053_line_revenue - b056_line_cost)", lambda: c("b053_line_revenue") - c("b056_line_cost")),
    M("B058", "b058_gross_margin_pct", None, sql_divide0("(b053_line_revenue - b056_line_cost)", "b053_line_revenue"), lambda: divide0(c("b053_line_revenue") - c("b056_line_cost"), c("b053_line_revenue"))),
    M("B059", "b059_units_per_receipt", None, sql_divide0("b052_total_units_sold", "receipts_in_lines"), lambda: divide0(c("b052_total_units_sold"), c("receipts_in_lines"))),
    M("B066", "b066_net_sales", None, "b053_line_revenue", lambda: c("b053_line_revenue")),
]
_q("B_lines", lambda s, f: channel_lines(s, f, False), _lines_sql(False), LINES, "fact_receipt_lines measures (B052–B059, B066).")

# ---------------------------------------------------------------- online
ONLINE = [
    M("B028", "b028_total_online_sales", lambda: F.sum("total_cents") / 100, "CAST(sum(total_cents) AS DOUBLE) / 100"),
    M("B029", "b029_total_online_tax", lambda: F.sum("tax_cents") / 100, "CAST(sum(tax_cents) AS DOUBLE) / 100"),
    M("B030", "b030_total_online_subtotal", lambda: F.sum("subtotal_cents") / 100, "CAST(sum(subtotal_cents) AS DOUBLE) / 100"),
    M("B031", "b031_online_order_count", lambda: F.count(F.lit(1)), "count(*)"),
    M("B032", "b032_average_online_order_value", None, sql_divide0("b028_total_online_sales", "b031_online_order_count"), lambda: divide0(c("b028_total_online_sales"), c("b031_online_order_count"))),
]
_q("B_online", online_orders, SQL_ONLINE, ONLINE, "fact_online_order_headers measures (B028–B032).")

ONLINE_LINES = [
    M("B036", "b036_total_online_units", lambda: F.sum("quantity"), "CAST(sum(quantity) AS BIGINT)"),
    M("B037", "b037_online_line_revenue", lambda: F.sum("ext_cents") / 100, "CAST(sum(ext_cents) AS DOUBLE) / 100"),
    M("B038", "b038_average_online_unit_price", None, sql_divide0("b037_online_line_revenue", "b036_total_online_units"), lambda: divide0(c("b037_online_line_revenue"), c("b036_total_online_units"))),
]
_q("B_online_lines", lambda s, f: channel_lines(s, f, True), _lines_sql(True), ONLINE_LINES, "fact_online_order_lines measures (B036–B038).")


# ---------------------------------------------------------------- omnichannel (facts aggregated separately, then combined)
def _omni(spark, sf):
    s = channel_lines(spark, sf, False).agg(F.sum("quantity").alias("su"), (F.sum("ext_cents") / 100).alias("sr"), F.count_distinct("receipt_id").alias("sn"))
    o = channel_lines(spark, sf, True).agg(F.sum("quantity").alias("ou"), (F.sum("ext_cents") / 100).alias("orv"))
    oc = online_orders(spark, sf).agg(F.count(F.lit(1)).alias("oc"))
    rc = store_receipts(spark, sf).agg(F.count(F.lit(1)).alias("rc"))
    cu = d.table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("nc"))
    stc = d.table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("ns"))
    mk = d.marketing(spark, sf).agg((F.sum("cost_cents") / 100).alias("mc"))
    x = s
    for part in (o, oc, rc, cu, stc, mk):
        x = x.withColumn("_k", F.lit(1)).join(part.withColumn("_k", F.lit(1)), "_k").drop("_k")
    omni_rev = c("sr") + c("orv")
    out = x.select(
        (c("su") + c("ou")).alias("b039_omnichannel_units"),
        divide0(c("ou"), c("su") + c("ou")).alias("b040_online_units_pct_of_omnichannel"),
        divide0(c("ou"), c("oc")).alias("b041_online_units_per_order"),
        divide0(c("sr"), c("ns")).alias("b073_sales_per_store"),
        divide0(c("sr"), c("nc")).alias("b074_sales_per_customer"),
        omni_rev.alias("b076_omnichannel_revenue"),
        (c("rc") + c("oc")).alias("b077_omnichannel_orders"),
        divide0(omni_rev, c("rc") + c("oc")).alias("b078_omnichannel_aov"),
        divide0(c("sr"), omni_rev).alias("b079_store_sales_pct_of_omnichannel"),
        divide0(c("orv"), omni_rev).alias("b080_online_sales_pct_of_omnichannel"),
        divide0(c("mc"), omni_rev).alias("b124_marketing_spend_pct_of_revenue"),
    )
    return out.select(*[F.round(col, 6).alias(col) if col not in ("b039_omnichannel_units", "b077_omnichannel_orders") else F.col(col) for col in out.columns])


_OMNI_SQL = f"""WITH s AS (SELECT sum(quantity) AS su, CAST(sum(ext_cents) AS DOUBLE) / 100 AS sr FROM {_lines_sql(False)}),
o AS (SELECT sum(quantity) AS ou, CAST(sum(ext_cents) AS DOUBLE) / 100 AS orv FROM {_lines_sql(True)}),
oc AS (SELECT count(*) AS oc FROM {SQL_ONLINE}), rc AS (SELECT count(*) AS rc FROM {SQL_STORE_RECEIPTS}),
nc AS (SELECT count(*) AS nc FROM customer), ns AS (SELECT count(*) AS ns FROM supplier),
mk AS (SELECT CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS mc FROM events WHERE event_type = 'view')
SELECT CAST(su + ou AS BIGINT) AS b039_omnichannel_units, round({sql_divide0('ou', 'su + ou')}, 6) AS b040_online_units_pct_of_omnichannel,
  round({sql_divide0('ou', 'oc')}, 6) AS b041_online_units_per_order, round({sql_divide0('sr', 'ns')}, 6) AS b073_sales_per_store,
  round({sql_divide0('sr', 'nc')}, 6) AS b074_sales_per_customer, round(sr + orv, 6) AS b076_omnichannel_revenue, rc + oc AS b077_omnichannel_orders,
  round({sql_divide0('sr + orv', 'rc + oc')}, 6) AS b078_omnichannel_aov, round({sql_divide0('sr', 'sr + orv')}, 6) AS b079_store_sales_pct_of_omnichannel,
  round({sql_divide0('orv', 'sr + orv')}, 6) AS b080_online_sales_pct_of_omnichannel, round({sql_divide0('mc', 'sr + orv')}, 6) AS b124_marketing_spend_pct_of_revenue
FROM s, o, oc, rc, nc, ns, mk"""


@register("B_omni", _OMNI_SQL)
def b_omnichannel(spark, sf):
    """Cross-fact measures (B039–B041, B073, B074, B076–B080, B124): each fact
    aggregated on its own to one row, then combined."""
    return _omni(spark, sf)


# ---------------------------------------------------------------- payments
SQL_PAYMENTS = """(SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, CASE WHEN o_orderstatus = 'P' THEN 'DECLINED' ELSE 'APPROVED' END AS status,
  CAST(o_orderkey % 997 AS BIGINT) AS processing_time_ms FROM orders)"""


def payments(spark, sf):
    o = d.table(spark, sf, "orders")
    return o.select(d.cents("o_totalprice").alias("amount_cents"), F.when(c("o_orderstatus") == "P", "DECLINED").otherwise("APPROVED").alias("status"), F.pmod(c("o_orderkey"), F.lit(997)).alias("processing_time_ms"))


PAYMENTS = [
    M("B042", "b042_total_amounts", lambda: F.sum("amount_cents") / 100, "CAST(sum(amount_cents) AS DOUBLE) / 100"),
    M("B043", "b043_payment_count", lambda: F.count(F.lit(1)), "count(*)"),
    M("B044", "b044_approved_payment_count", lambda: F.count_if(c("status") == "APPROVED"), "CAST(count_if(status = 'APPROVED') AS BIGINT)"),
    M("B045", "b045_declined_payment_count", lambda: F.count_if(c("status") == "DECLINED"), "CAST(count_if(status = 'DECLINED') AS BIGINT)"),
    M("B047", "b047_avg_payment_processing_ms", lambda: F.avg("processing_time_ms"), "avg(processing_time_ms)"),
    M("B046", "b046_payment_decline_rate_pct", None, sql_divide0("b045_declined_payment_count", "b043_payment_count"), lambda: divide0(c("b045_declined_payment_count"), c("b043_payment_count"))),
]
_q("B_payments", payments, SQL_PAYMENTS, PAYMENTS, "fact_payments measures (B042–B047); processing ms is a role stand-in (order key mod 997).")

# ---------------------------------------------------------------- promotions
SQL_PROMO_LINES = f"""(SELECT receipt_id, promo_code, quantity, CAST(round(ext_cents * discount) AS BIGINT) AS discount_cents FROM {SQL_LINES} WHERE promo_code IS NOT NULL)"""


def promo_lines(spark, sf):
    li = d.lines(spark, sf).where(c("promo_code").isNotNull())
    return li.select("receipt_id", "promo_code", "quantity", F.round(c("ext_cents") * c("discount")).cast("bigint").alias("discount_cents"))


PROMO = [
    M("B048", "b048_promo_line_quantity", lambda: F.sum("quantity"), "CAST(sum(quantity) AS BIGINT)"),
    M("B049", "b049_promo_line_discount_amount", lambda: F.sum("discount_cents") / 100, "CAST(sum(discount_cents) AS DOUBLE) / 100"),
    M("B050", "b050_promotion_count", lambda: F.count_distinct("receipt_id", "promo_code"), "count(DISTINCT (receipt_id, promo_code))"),
    M("B051", "b051_promotion_discount_amount", lambda: F.sum("discount_cents") / 100, "CAST(sum(discount_cents) AS DOUBLE) / 100"),
]
_q("B_promotions", promo_lines, SQL_PROMO_LINES, PROMO, "fact_promo_lines / fact_promotions measures (B048–B051).")


# ---------------------------------------------------------------- dimensions
@register(
    "B_dims",
    """SELECT (SELECT count(*) FROM customer) AS b017_customers, (SELECT count(*) FROM nation) AS b018_distribution_centers,
  (SELECT count(*) FROM nation) AS b019_locations, (SELECT count(*) FROM part) AS b020_products,
  (SELECT round(avg(round(p_retailprice * 100 * 0.6)) / 100, 6) FROM part) AS b021_average_product_cost,
  (SELECT round(avg(p_retailprice), 6) FROM part) AS b022_average_product_price, (SELECT count(*) FROM supplier) AS b023_stores,
  (SELECT count(DISTINCT o_custkey) FROM orders) AS b024_trucks""",
)
def b_dims(spark, sf):
    """Dimension counts and averages (B017–B024)."""
    t = lambda n: d.table(spark, sf, n)
    parts = [
        t("customer").agg(F.count(F.lit(1)).alias("b017_customers")),
        t("nation").agg(F.count(F.lit(1)).alias("b018_distribution_centers")),
        t("nation").agg(F.count(F.lit(1)).alias("b019_locations")),
        t("part").agg(F.count(F.lit(1)).alias("b020_products"), F.round(F.avg(F.round(c("p_retailprice") * 100 * 0.6)) / 100, 6).alias("b021_average_product_cost"), F.round(F.avg("p_retailprice"), 6).alias("b022_average_product_price")),
        t("supplier").agg(F.count(F.lit(1)).alias("b023_stores")),
        t("orders").agg(F.count_distinct("o_custkey").alias("b024_trucks")),
    ]
    x = parts[0]
    for p in parts[1:]:
        x = x.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return x


# ---------------------------------------------------------------- foot traffic
@register(
    "B_traffic",
    f"""WITH t AS (SELECT count(*) AS cnt, sum(value) AS dwell FROM events), r AS (SELECT count(*) AS rc FROM {SQL_STORE_RECEIPTS})
SELECT cnt AS b025_foot_traffic_count, round({sql_divide0('dwell', 'cnt * 60')}, 6) AS b026_avg_foot_traffic_dwell_minutes,
  round({sql_divide0('rc', 'cnt')}, 6) AS b027_traffic_conversion_proxy_pct FROM t, r""",
)
def b_traffic(spark, sf):
    """Foot traffic measures (B025–B027), receipts combined from their own fact."""
    t = d.sensors(spark, sf).agg(F.count(F.lit(1)).alias("cnt"), F.sum("dwell_seconds").alias("dwell"))
    r = store_receipts(spark, sf).agg(F.count(F.lit(1)).alias("rc"))
    x = t.withColumn("_k", F.lit(1)).join(r.withColumn("_k", F.lit(1)), "_k")
    return x.select(
        c("cnt").alias("b025_foot_traffic_count"), F.round(divide0(c("dwell"), c("cnt") * 60), 6).alias("b026_avg_foot_traffic_dwell_minutes"),
        F.round(divide0(c("rc"), c("cnt")), 6).alias("b027_traffic_conversion_proxy_pct"),
    )


# ---------------------------------------------------------------- inventory
def _positions(spark, sf):
    from storelake.plans.gold import _store_positions

    p = d.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.round(c("p_retailprice") * 100 * 0.6).cast("bigint").alias("cost_cents"), d.cents("p_retailprice").alias("price_cents"))
    return _store_positions(spark, sf).join(p, "product_id", "left")


def _sql_positions():
    from storelake.plans.gold import _SQL_POSITIONS

    return f"""(SELECT x.*, CAST(round(p_retailprice * 100 * 0.6) AS BIGINT) AS cost_cents, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents
  FROM {_SQL_POSITIONS} x LEFT JOIN part ON x.product_id = p_partkey)"""


INVENTORY = [
    M("B111", "b111_total_units_on_hand", lambda: F.sum("on_hand"), "CAST(sum(on_hand) AS BIGINT)"),
    M("B112", "b112_total_inventory_value", lambda: F.sum(c("on_hand") * F.coalesce(c("cost_cents"), F.lit(0))) / 100, "CAST(sum(on_hand * coalesce(cost_cents, 0)) AS DOUBLE) / 100"),
    M("B113", "b113_total_inventory_retail_value", lambda: F.sum(c("on_hand") * F.coalesce(c("price_cents"), F.lit(0))) / 100, "CAST(sum(on_hand * coalesce(price_cents, 0)) AS DOUBLE) / 100"),
    M("B114", "b114_store_sku_count", lambda: F.count_distinct("product_id"), "count(DISTINCT product_id)"),
    M("B105", "b105_total_inventory_transactions", lambda: F.sum(F.lit(0)), "CAST(0 AS BIGINT)"),
    M("B115", "b115_avg_store_units_per_sku", None, sql_divide0("b111_total_units_on_hand", "b114_store_sku_count"), lambda: divide0(c("b111_total_units_on_hand"), c("b114_store_sku_count"))),
    M("B116", "b116_inventory_margin_value", None, "(b113_total_inventory_retail_value - b112_total_inventory_value)", lambda: c("b113_total_inventory_retail_value") - c("b112_total_inventory_value")),
    M("B117", "b117_inventory_margin_pct", None, sql_divide0("(b113_total_inventory_retail_value - b112_total_inventory_value)", "b113_total_inventory_retail_value"),
      lambda: divide0(c("b113_total_inventory_retail_value") - c("b112_total_inventory_value"), c("b113_total_inventory_retail_value"))),
]
INVENTORY = [m for m in INVENTORY if m.mid != "B105"]
_q("B_inventory", _positions, _sql_positions(), INVENTORY, "inventory_position_current measures (B111–B117).")


@register(
    "B_inventory_txn",
    f"""SELECT count(*) AS b105_total_inventory_transactions, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END) AS BIGINT) AS b106_total_quantity_delta FROM lineitem""",
)
def b_inventory_txn(spark, sf):
    """fact_store_inventory_txn measures (B105, B106)."""
    led = d.ledger(spark, sf)
    return led.agg(F.count(F.lit(1)).alias("b105_total_inventory_transactions"), F.sum("qty").alias("b106_total_quantity_delta"))


@register(
    "B_dc_inventory",
    """WITH x AS (SELECT dc_id, product_id, on_hand FROM (SELECT CAST(s_nationkey AS BIGINT) AS dc_id, l_partkey AS product_id, l_shipdate AS ts,
    concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS txn_id,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END) OVER (PARTITION BY s_nationkey, l_partkey ORDER BY l_shipdate,
      concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS on_hand
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) QUALIFY row_number() OVER (PARTITION BY dc_id, product_id ORDER BY ts DESC, txn_id DESC) = 1)
SELECT CAST(sum(on_hand) AS BIGINT) AS b010_dc_units_on_hand, count(DISTINCT product_id) AS b011_dc_sku_count,
  round(coalesce(CAST(sum(on_hand) AS DOUBLE) / nullif(count(DISTINCT product_id), 0), 0.0), 6) AS b012_avg_dc_units_per_sku FROM x""",
)
def b_dc_inventory(spark, sf):
    """dc_inventory_position_current measures (B010–B012) over A05."""
    from storelake.plans.gold import a05_dc_inventory_position_current

    x = a05_dc_inventory_position_current(spark, sf)
    g = x.agg(F.sum("on_hand").alias("b010_dc_units_on_hand"), F.count_distinct("product_id").alias("b011_dc_sku_count"))
    return g.withColumn("b012_avg_dc_units_per_sku", F.round(divide0(c("b010_dc_units_on_hand"), c("b011_dc_sku_count")), 6))


def _sql_dc_positions() -> str:
    from storelake.plans.registry import ORACLES

    return ORACLES["A05"]


@register(
    "B_network",
    f"""WITH s AS (SELECT CAST(sum(on_hand) AS BIGINT) AS su, CAST(sum(on_hand * coalesce(price_cents, 0)) AS DOUBLE) / 100 AS rv FROM {_sql_positions()}),
n AS (SELECT CAST(sum(ext_cents) AS DOUBLE) / 100 AS ns FROM {_lines_sql(False)})
SELECT su + (SELECT CAST(sum(on_hand) AS BIGINT) FROM ({_sql_dc_positions()})) AS b118_network_units_on_hand, round({sql_divide0('rv', 'ns')}, 6) AS b119_inventory_to_sales_ratio FROM s, n""",
)
def b_network(spark, sf):
    """B118 (units in stores and DCs) and B119 inventory-to-sales."""
    from storelake.plans.gold import a05_dc_inventory_position_current

    dc = a05_dc_inventory_position_current(spark, sf).agg(F.sum("on_hand").alias("du"))
    s = _positions(spark, sf).agg(F.sum("on_hand").alias("su"), (F.sum(c("on_hand") * F.coalesce(c("price_cents"), F.lit(0))) / 100).alias("rv"))
    n = channel_lines(spark, sf, False).agg((F.sum("ext_cents") / 100).alias("ns"))
    x = s.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").join(dc.withColumn("_k", F.lit(1)), "_k")
    return x.select((c("su") + c("du")).alias("b118_network_units_on_hand"), F.round(divide0(c("rv"), c("ns")), 6).alias("b119_inventory_to_sales_ratio"))


# ---------------------------------------------------------------- reorders / stockouts / ops / trucks
def _reorders_sql():
    from storelake.plans.reaimed import _SQL_REORDERS

    return f"""SELECT CAST(sum(reorder_quantity) AS BIGINT) AS b098_total_reorder_quantity, count(*) AS b099_reorder_events,
  round({sql_divide0('sum(reorder_quantity)', 'count(*)')}, 6) AS b100_avg_reorder_quantity,
  CAST(coalesce(sum(CASE WHEN priority IN ('HIGH', 'URGENT') THEN reorder_quantity END), 0) AS BIGINT) AS b101_high_priority_reorder_quantity,
  CAST(sum(reorder_point - current_quantity) AS BIGINT) AS b102_reorder_fill_gap FROM {_SQL_REORDERS} r"""


def b_reorders(spark, sf):
    """fact_reorders measures (B098–B102); high priority = HIGH and URGENT."""
    from storelake.plans.reaimed import reorder_signals

    r = reorder_signals(spark, sf)
    g = r.agg(
        F.sum("reorder_quantity").alias("b098_total_reorder_quantity"), F.count(F.lit(1)).alias("b099_reorder_events"),
        F.coalesce(F.sum(F.when(c("priority").isin("HIGH", "URGENT"), c("reorder_quantity"))), F.lit(0)).alias("b101_high_priority_reorder_quantity"),
        F.sum(c("reorder_point") - c("current_quantity")).alias("b102_reorder_fill_gap"),
    )
    return g.withColumn("b100_avg_reorder_quantity", F.round(divide0(c("b098_total_reorder_quantity"), c("b099_reorder_events")), 6))


def b_stockouts(spark, sf):
    """fact_stockouts measures (B103, B104)."""
    from storelake.plans.named import stockouts

    return stockouts(spark, sf).agg(F.count(F.lit(1)).alias("b103_stockout_events"), F.round(F.avg("last_known_quantity"), 6).alias("b104_avg_last_known_stockout_qty"))


def _stockouts_sql():
    from storelake.plans.named import _SQL_STOCKOUTS

    return f"SELECT count(*) AS b103_stockout_events, round(avg(last_known_quantity), 6) AS b104_avg_last_known_stockout_qty FROM {_SQL_STOCKOUTS} s"


def b_ops(spark, sf):
    """Store operations and truck moves (B107–B110)."""
    from storelake.plans.silver import p16_store_ops

    ops = p16_store_ops(spark, sf).agg(F.count(F.lit(1)).alias("b107_store_operation_events"))
    st = d.table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("ns"))
    mv = d.truck_moves(spark, sf).agg(F.count(F.lit(1)).alias("b109_truck_move_count"), F.round(F.avg(F.datediff(F.to_date("etd"), F.to_date("eta"))), 6).alias("b110_avg_unload_duration"))
    x = ops.withColumn("_k", F.lit(1)).join(st.withColumn("_k", F.lit(1)), "_k").join(mv.withColumn("_k", F.lit(1)), "_k")
    return x.select("b107_store_operation_events", F.round(divide0(c("b107_store_operation_events"), c("ns")), 6).alias("b108_store_operation_events_per_store"), "b109_truck_move_count", "b110_avg_unload_duration")


def _ops_sql():
    from storelake.plans.common import SQL_RECEIPTS_STORE
    from storelake.plans.gold import SQL_TRUCK_MOVES

    return f"""WITH o AS (SELECT count(*) * 2 AS n FROM (SELECT DISTINCT store_id, event_date FROM {SQL_RECEIPTS_STORE} r)), s AS (SELECT count(*) AS ns FROM supplier),
m AS (SELECT count(*) AS mc, round(avg(date_diff('day', CAST(eta AS DATE), CAST(etd AS DATE))), 6) AS ad FROM {SQL_TRUCK_MOVES} t)
SELECT n AS b107_store_operation_events, round({sql_divide0('n', 'ns')}, 6) AS b108_store_operation_events_per_store, mc AS b109_truck_move_count,
  ad AS b110_avg_unload_duration FROM o, s, m"""


# ---------------------------------------------------------------- marketing
def b_marketing(spark, sf):
    """marketing_cost_daily measures (B120–B123); B120 restricts campaigns to
    those present in the conversion fact (TREATAS as left_semi)."""
    from storelake.operators import aggs

    m = aggs.marketing_cost_daily(d.marketing(spark, sf), "campaign_id", "event_ts", "cost_cents")
    conv = d.events(spark, sf).where(c("event_type") == "purchase").select(F.col("k").alias("campaign_id")).distinct()
    ch = m.join(conv, "campaign_id", "left_semi").agg(F.round(F.sum("cost"), 6).alias("b120_marketing_spend_channel"))
    g = m.agg(F.round(F.sum("cost"), 6).alias("b121_total_marketing_cost"), F.sum("impressions").alias("b122_total_marketing_impressions"))
    x = g.withColumn("_k", F.lit(1)).join(ch.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return x.withColumn("b123_marketing_cpm", F.round(divide0(c("b121_total_marketing_cost") * 1000, c("b122_total_marketing_impressions")), 6))


_MKT_SQL = """WITH m AS (SELECT k AS campaign_id, CAST(ts AS DATE) AS day, count(*) AS impressions, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS cost
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'view' GROUP BY ALL),
conv AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS campaign_id FROM events WHERE event_type = 'purchase')
SELECT round(sum(cost), 6) AS b121_total_marketing_cost, CAST(sum(impressions) AS BIGINT) AS b122_total_marketing_impressions,
  (SELECT round(sum(cost), 6) FROM m WHERE campaign_id IN (SELECT campaign_id FROM conv)) AS b120_marketing_spend_channel,
  round(coalesce(round(sum(cost), 6) * 1000 / nullif(sum(impressions), 0), 0.0), 6) AS b123_marketing_cpm FROM m"""


# ---------------------------------------------------------------- gold-table measures
def b_gold(spark, sf):
    """Measures over the gold aggregates (B125–B130, B136–B145); averages of
    averages kept literal (G29); breach threshold 45 min as in the model (G23)."""
    from storelake.plans import gold

    osd = gold.a08_online_sales_daily(spark, sf).agg(F.sum("total").alias("b125_online_revenue"), F.sum("orders").alias("b126_online_orders"))
    sms = gold.a01_sales_minute_store(spark, sf).agg(F.sum("total_sales").alias("b128_total_store_sales"), F.sum("receipts").alias("b129_total_store_receipts"), F.avg("avg_basket").alias("b130_avg_store_basket"))
    tmd = gold.a11_tender_mix_daily(spark, sf).agg(F.sum("total_amount").alias("b136_tender_amount"), F.sum("transactions").alias("b137_tender_transactions"))
    tp = gold.a02_top_products_15m(spark, sf).agg(F.sum("revenue").alias("b138_top_product_revenue"), F.sum("units").alias("b139_top_product_units"))
    tdd = gold.a07_truck_dwell_daily_v2(spark, sf)
    td = tdd.agg(F.sum("trucks").alias("b140_total_trucks"), F.avg("avg_dwell_min").alias("b141_avg_truck_dwell_minutes"), F.count_if(c("avg_dwell_min") > 45).alias("b142_truck_dwell_breach_days"), F.count_distinct("site").alias("_sites"))
    zd = gold.a09_zone_dwell_minute(spark, sf).agg(F.sum("customers").alias("b144_zone_customers"), F.avg("avg_dwell").alias("b145_avg_zone_dwell"))
    x = osd
    for p in (sms, tmd, tp, td, zd):
        x = x.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k")
    x = x.withColumn("b127_online_average_order_value", divide0(c("b125_online_revenue"), c("b126_online_orders"))).withColumn(
        "b143_trucks_per_site", divide0(c("b140_total_trucks"), c("_sites"))
    ).drop("_sites")
    return x.select(*[F.round(F.col(k), 4).alias(k) if dict(x.dtypes)[k] == "double" else F.col(k) for k in x.columns])


def _gold_sql():
    from storelake.plans.registry import ORACLES

    a = lambda k: f"({ORACLES[k]})"
    return f"""WITH osd AS (SELECT sum(total) AS b125_online_revenue, sum(orders) AS b126_online_orders FROM {a('A08')} x),
sms AS (SELECT sum(total_sales) AS b128_total_store_sales, sum(receipts) AS b129_total_store_receipts, avg(avg_basket) AS b130_avg_store_basket FROM {a('A01')} x),
tmd AS (SELECT sum(total_amount) AS b136_tender_amount, sum(transactions) AS b137_tender_transactions FROM {a('A11')} x),
tp AS (SELECT sum(revenue) AS b138_top_product_revenue, sum(units) AS b139_top_product_units FROM {a('A02')} x),
td AS (SELECT sum(trucks) AS b140_total_trucks, avg(avg_dwell_min) AS b141_avg_truck_dwell_minutes, count_if(avg_dwell_min > 45) AS b142_truck_dwell_breach_days,
  count(DISTINCT site) AS sites FROM {a('A07')} x),
zd AS (SELECT sum(customers) AS b144_zone_customers, avg(avg_dwell) AS b145_avg_zone_dwell FROM {a('A09')} x)
SELECT round(b125_online_revenue, 4) AS b125_online_revenue, CAST(b126_online_orders AS BIGINT) AS b126_online_orders,
  round(b128_total_store_sales, 4) AS b128_total_store_sales, CAST(b129_total_store_receipts AS BIGINT) AS b129_total_store_receipts,
  round(b130_avg_store_basket, 4) AS b130_avg_store_basket, round(b136_tender_amount, 4) AS b136_tender_amount,
  CAST(b137_tender_transactions AS BIGINT) AS b137_tender_transactions, round(b138_top_product_revenue, 4) AS b138_top_product_revenue,
  CAST(b139_top_product_units AS BIGINT) AS b139_top_product_units, CAST(b140_total_trucks AS BIGINT) AS b140_total_trucks,
  round(b141_avg_truck_dwell_minutes, 4) AS b141_avg_truck_dwell_minutes, CAST(b142_truck_dwell_breach_days AS BIGINT) AS b142_truck_dwell_breach_days,
  CAST(b144_zone_customers AS BIGINT) AS b144_zone_customers, round(b145_avg_zone_dwell, 4) AS b145_avg_zone_dwell,
  round({sql_divide0('b125_online_revenue', 'b126_online_orders')}, 4) AS b127_online_average_order_value,
  round({sql_divide0('b140_total_trucks', 'sites')}, 4) AS b143_trucks_per_site
FROM osd, sms, tmd, tp, td, zd"""


register("B_reorders", _reorders_sql())(b_reorders)
register("B_stockouts", _stockouts_sql())(b_stockouts)
register("B_ops", _ops_sql())(b_ops)
register("B_marketing", _MKT_SQL)(b_marketing)
register("B_gold", _gold_sql())(b_gold)


# ---------------------------------------------------------------- time intelligence
def daily_channels(spark, sf):
    """Dense daily series (R01) of store net sales, online line revenue,
    store receipts and online order value, in cents."""
    from storelake.functions import calendar

    s = channel_lines(spark, sf, False).groupBy(F.col("event_date").alias("d")).agg(F.sum("ext_cents").alias("net_cents"))
    o = channel_lines(spark, sf, True).groupBy(F.col("event_date").alias("d")).agg(F.sum("ext_cents").alias("online_line_cents"))
    r = store_receipts(spark, sf).groupBy(F.col("event_date").alias("d")).agg(F.count(F.lit(1)).alias("receipts"))
    oo = online_orders(spark, sf).groupBy(F.col("event_date").alias("d")).agg(F.sum("total_cents").alias("online_cents"))
    x = s.join(o, "d", "full_outer").join(r, "d", "full_outer").join(oo, "d", "full_outer").withColumn("_all", F.lit(1))
    x = calendar.densify(x, ["_all"], "d", ["net_cents", "online_line_cents", "receipts", "online_cents"]).drop("_all")
    return x.withColumn("omni_cents", F.col("net_cents") + F.col("online_line_cents"))


def time_intelligence(spark, sf):
    from storelake.operators import windows
    from storelake.session import ensure_checkpoint_dir

    # The daily series (one row per calendar day) feeds six self-joins: cut
    # its lineage once with a reliable checkpoint in the shared folder
    # (spark.checkpoint.dir) instead of recomputing the fact scans six times.
    ensure_checkpoint_dir(spark)
    x = daily_channels(spark, sf).checkpoint(eager=True)
    x = windows.period_to_date(x, [], "d", "net_cents", "month", "b067_store_sales_mtd")
    x = windows.period_to_date(x, [], "d", "net_cents", "quarter", "b068_store_sales_qtd")
    x = windows.period_to_date(x, [], "d", "net_cents", "year", "b069_store_sales_ytd")
    x = windows.period_to_date(x, [], "d", "receipts", "year", "b072_receipt_count_ytd")
    x = windows.period_to_date(x, [], "d", "online_cents", "year", "b033_online_sales_ytd")
    x = windows.period_to_date(x, [], "d", "omni_cents", "year", "b081_omnichannel_revenue_ytd")
    base = x
    for col, months, days, out in (
        ("online_cents", 12, 0, "b034_online_sales_py"), ("net_cents", 12, 0, "b070_store_sales_py"), ("omni_cents", 12, 0, "b082_omnichannel_revenue_py"),
        ("net_cents", 1, 0, "b084_store_sales_pm"), ("net_cents", 3, 0, "b086_store_sales_pq"), ("net_cents", 0, 1, "b088_store_sales_pd"),
    ):
        base = windows.prior_period(base, [], "d", col, months=months, days=days, out=out)
    day = F.unix_date("d")
    w = windows.Window.orderBy(day)
    base = base.withColumn("b090_store_sales_7d", F.sum("net_cents").over(w.rangeBetween(-6, 0))).withColumn("b091_store_sales_7d_pw", F.sum("net_cents").over(w.rangeBetween(-13, -7)))
    chg = lambda cur, prev: F.round(divide_blank(F.col(cur) - F.col(prev), F.col(prev)), 6)
    base = (
        base.withColumn("b035_online_sales_yoy_pct", chg("online_cents", "b034_online_sales_py"))
        .withColumn("b071_store_sales_yoy_pct", chg("net_cents", "b070_store_sales_py"))
        .withColumn("b083_omnichannel_revenue_yoy_pct", chg("omni_cents", "b082_omnichannel_revenue_py"))
        .withColumn("b085_store_sales_mom_pct", chg("net_cents", "b084_store_sales_pm"))
        .withColumn("b087_store_sales_qoq_pct", chg("net_cents", "b086_store_sales_pq"))
        .withColumn("b089_store_sales_dod_pct", chg("net_cents", "b088_store_sales_pd"))
        .withColumn("b092_store_sales_wow_pct", chg("b090_store_sales_7d", "b091_store_sales_7d_pw"))
    )
    prior = [c_ for c_ in base.columns if c_.endswith(("_py", "_pm", "_pq", "_pd", "_pw"))]
    return base.select(*[F.col(k).cast("double").alias(k) if k in prior else F.col(k) for k in base.columns])


def _ti_sql():
    dense = f"""(WITH s AS (SELECT event_date AS d, sum(ext_cents) AS net_cents FROM {_lines_sql(False)} x GROUP BY 1),
o AS (SELECT event_date AS d, sum(ext_cents) AS online_line_cents FROM {_lines_sql(True)} x GROUP BY 1),
r AS (SELECT event_date AS d, count(*) AS receipts FROM {SQL_STORE_RECEIPTS} x GROUP BY 1),
oo AS (SELECT event_date AS d, sum(total_cents) AS online_cents FROM {SQL_ONLINE} x GROUP BY 1),
u AS (SELECT d FROM s UNION SELECT d FROM o UNION SELECT d FROM r UNION SELECT d FROM oo),
g AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM u)
SELECT g.d, CAST(coalesce(net_cents, 0) AS BIGINT) AS net_cents, CAST(coalesce(online_line_cents, 0) AS BIGINT) AS online_line_cents,
  CAST(coalesce(receipts, 0) AS BIGINT) AS receipts, CAST(coalesce(online_cents, 0) AS BIGINT) AS online_cents,
  CAST(coalesce(net_cents, 0) + coalesce(online_line_cents, 0) AS BIGINT) AS omni_cents
FROM g LEFT JOIN s USING (d) LEFT JOIN o USING (d) LEFT JOIN r USING (d) LEFT JOIN oo USING (d))"""
    ytd = lambda col, unit, out: f"CAST(sum({col}) OVER (PARTITION BY date_trunc('{unit}', x.d) ORDER BY x.d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {out}"
    prev = lambda alias, col, shift, out: f"CAST({alias}.{col} AS DOUBLE) AS {out}"
    chg = lambda cur, prv, out: f"round(CAST({cur} - {prv} AS DOUBLE) / nullif({prv}, 0), 6) AS {out}"
    return f"""WITH x AS {dense}
SELECT x.*, {ytd('x.net_cents', 'month', 'b067_store_sales_mtd')}, {ytd('x.net_cents', 'quarter', 'b068_store_sales_qtd')},
  {ytd('x.net_cents', 'year', 'b069_store_sales_ytd')}, {ytd('x.receipts', 'year', 'b072_receipt_count_ytd')},
  {ytd('x.online_cents', 'year', 'b033_online_sales_ytd')}, {ytd('x.omni_cents', 'year', 'b081_omnichannel_revenue_ytd')},
  CAST(py.online_cents AS DOUBLE) AS b034_online_sales_py, CAST(py.net_cents AS DOUBLE) AS b070_store_sales_py, CAST(py.omni_cents AS DOUBLE) AS b082_omnichannel_revenue_py,
  CAST(pm.net_cents AS DOUBLE) AS b084_store_sales_pm, CAST(pq.net_cents AS DOUBLE) AS b086_store_sales_pq, CAST(pd.net_cents AS DOUBLE) AS b088_store_sales_pd,
  CAST(sum(x.net_cents) OVER (ORDER BY x.d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS b090_store_sales_7d,
  CAST(sum(x.net_cents) OVER (ORDER BY x.d RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING) AS DOUBLE) AS b091_store_sales_7d_pw,
  {chg('x.online_cents', 'py.online_cents', 'b035_online_sales_yoy_pct')}, {chg('x.net_cents', 'py.net_cents', 'b071_store_sales_yoy_pct')},
  {chg('x.omni_cents', 'py.omni_cents', 'b083_omnichannel_revenue_yoy_pct')}, {chg('x.net_cents', 'pm.net_cents', 'b085_store_sales_mom_pct')},
  {chg('x.net_cents', 'pq.net_cents', 'b087_store_sales_qoq_pct')}, {chg('x.net_cents', 'pd.net_cents', 'b089_store_sales_dod_pct')},
  round((sum(x.net_cents) OVER (ORDER BY x.d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)
         - sum(x.net_cents) OVER (ORDER BY x.d RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING))
        / nullif(CAST(sum(x.net_cents) OVER (ORDER BY x.d RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING) AS DOUBLE), 0), 6) AS b092_store_sales_wow_pct
FROM x LEFT JOIN x py ON py.d = CAST(x.d - INTERVAL 12 MONTH AS DATE) LEFT JOIN x pm ON pm.d = CAST(x.d - INTERVAL 1 MONTH AS DATE)
LEFT JOIN x pq ON pq.d = CAST(x.d - INTERVAL 3 MONTH AS DATE) LEFT JOIN x pd ON pd.d = x.d - INTERVAL 1 DAY"""


@register("B_time", _ti_sql())
def b_time(spark, sf):
    """Time intelligence per day (B033–B035, B067–B072, B081–B092): running
    sums in calendar partitions, prior periods by equi self-join on the
    shifted date (NULL outside the data), growth % NULL on a 0/absent prior."""
    return time_intelligence(spark, sf)


@register(
    "B_latest_year",
    f"""WITH x AS {_ti_sql().split('WITH x AS ', 1)[1].split(chr(10) + 'SELECT x.*', 1)[0]},
y AS (SELECT max(year(d)) AS yr FROM x WHERE net_cents > 0)
SELECT CAST((SELECT yr FROM y) AS INTEGER) AS b093_latest_sales_year,
  CAST(sum(CASE WHEN year(d) = (SELECT yr FROM y) THEN net_cents ELSE 0 END) AS BIGINT) AS b094_net_sales_latest_year,
  CAST(sum(CASE WHEN year(d) = (SELECT yr FROM y) - 1 THEN net_cents ELSE 0 END) AS BIGINT) AS b095_net_sales_prior_year,
  CAST(sum(CASE WHEN year(d) = (SELECT yr FROM y) THEN omni_cents ELSE 0 END) AS BIGINT) AS b096_omnichannel_revenue_latest_year,
  CAST(sum(CASE WHEN year(d) = (SELECT yr FROM y) - 1 THEN omni_cents ELSE 0 END) AS BIGINT) AS b097_omnichannel_revenue_prior_year FROM x""",
)
def b_latest_year(spark, sf):
    """B093–B097: the latest sales year (one scalar) and conditional sums for it
    and the year before."""
    from storelake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    x = daily_channels(spark, sf).checkpoint(eager=True)  # one row a day, read for the year and for the sums
    yr = x.where(F.col("net_cents") > 0).agg(F.max(F.year("d"))).first()[0]
    y = F.year("d")
    s = lambda col, yy: F.sum(F.when(y == yy, F.col(col)).otherwise(F.lit(0)))
    return x.agg(
        F.lit(yr).cast("int").alias("b093_latest_sales_year"), s("net_cents", yr).alias("b094_net_sales_latest_year"), s("net_cents", yr - 1).alias("b095_net_sales_prior_year"),
        s("omni_cents", yr).alias("b096_omnichannel_revenue_latest_year"), s("omni_cents", yr - 1).alias("b097_omnichannel_revenue_prior_year"),
    )


# ---------------------------------------------------------------- model tables
@register(
    "B_segments",
    """WITH a AS (SELECT max(CAST(o_orderdate AS DATE)) AS as_of FROM orders),
r AS (SELECT o_custkey AS customer_id, date_diff('day', max(CAST(o_orderdate AS DATE)), (SELECT as_of FROM a)) AS recency_days, count(DISTINCT o_orderkey) AS frequency,
  sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS monetary_cents FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING sum(CAST(round(o_totalprice * 100) AS BIGINT)) > 0)
SELECT count(DISTINCT customer_id) AS b005_segmented_customer_count, round(avg(recency_days), 6) AS b006_avg_recency_days, round(avg(frequency), 6) AS b007_avg_frequency,
  round(CAST(sum(monetary_cents) AS DOUBLE) / 100, 6) AS b008_segmented_monetary_value, round(avg(CAST(monetary_cents AS DOUBLE) / 100 / frequency), 6) AS b009_segmented_avg_order_value FROM r""",
)
def b_segments(spark, sf):
    """customer_segments measures (B005–B009) over the RFM frame."""
    from storelake.plans.analytics import rfm_frame

    r = rfm_frame(spark, sf)
    return r.agg(
        F.count_distinct("customer_id").alias("b005_segmented_customer_count"), F.round(F.avg("recency_days"), 6).alias("b006_avg_recency_days"),
        F.round(F.avg("frequency"), 6).alias("b007_avg_frequency"), F.round(F.sum("monetary_cents") / 100, 6).alias("b008_segmented_monetary_value"),
        F.round(F.avg("avg_order_value"), 6).alias("b009_segmented_avg_order_value"),
    )


@register("B_churn")
def b_churn(spark, sf):
    """churn_predictions measures (B001–B004), literal 'High' band (G22) plus
    the inclusive High + Very High variant."""
    from storelake.plans.analytics import m21_churn_scoring

    p = m21_churn_scoring(spark, sf)
    at_risk = F.count_distinct(F.when(F.col("churn_prediction") == 1, F.col("customer_id")))
    return p.agg(
        at_risk.alias("b001_customers_at_risk"), F.avg("churn_probability").alias("b002_avg_churn_probability"),
        divide0(at_risk, F.count_distinct("customer_id")).alias("b003_predicted_churn_rate_pct"),
        F.count_distinct(F.when(F.upper("risk_category") == "HIGH", F.col("customer_id"))).alias("b004_high_risk_customers"),
        F.count_distinct(F.when(F.upper("risk_category").isin("HIGH", "VERY HIGH"), F.col("customer_id"))).alias("b004_high_risk_customers_inclusive"),
    )


@register("B_forecast")
def b_forecast(spark, sf):
    """demand_forecast measures (B013–B016)."""
    from storelake.plans.analytics import m11_forecast_metrics, m12_recursive_forecast

    f = m12_recursive_forecast(spark, sf).agg(F.sum("predicted_units").alias("b013_forecasted_units"), F.sum("lower_bound").alias("b014_forecast_lower_bound"), F.sum("upper_bound").alias("b015_forecast_upper_bound"))
    m = m11_forecast_metrics(spark, sf).select(F.col("mape_overall").alias("b016_forecast_mape"))
    return f.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k").drop("_k")


@register("B_stockout_risk")
def b_stockout_risk(spark, sf):
    """stockout_risk measures (B131–B135)."""
    from storelake.operators import ml
    from storelake.plans.analytics import staged_snapshots, stockout_scores, with_rates

    snaps = staged_snapshots(spark, sf)  # M31's, for the model and the averages
    r = ml.staged(stockout_scores(spark, sf, snaps), "risk")
    f = finish(with_rates(snaps), 4)
    latest = f.join(r.select("store_id", "product_id", "day"), ["store_id", "product_id", "day"], "left_semi")
    a = r.agg(
        F.count_distinct("product_id").alias("b131_stockout_risk_sku_count"), F.avg("stockout_probability").alias("b132_avg_stockout_probability"),
        F.count_distinct(F.when(F.upper("risk_level") == "HIGH", F.col("product_id"))).alias("b133_high_risk_skus"),
    )
    b = latest.agg(F.avg("days_of_inventory").alias("b134_avg_days_of_inventory"), F.avg("velocity").alias("b135_avg_daily_demand_velocity"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
