"""Data-quality checks D01–D16 on the driver tables (each: check, violations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelake.operators import quality as q
from storelake.plans.common import SQL_EVENTS, SQL_LEDGER, SQL_LINES, SQL_RECEIPTS
from storelake.plans.gold import SQL_MARKETING, SQL_ORDER_TOTALS, SQL_SENSORS, SQL_TRUCK_MOVES, order_totals
from storelake.plans.registry import register
from storelake.sources import driver as d


def _chk(name: str, expr: str) -> str:
    return f"SELECT '{name}' AS check, CAST(({expr}) AS BIGINT) AS violations"


@register("D01", _chk("orders_key_unique", "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders"))
def d01_key_unique(spark, sf):
    return q.key_unique(d.table(spark, sf, "orders"), ["o_orderkey"], "orders_key_unique")


@register(
    "D02",
    " UNION ALL ".join(
        [
            _chk("lines_to_receipts", "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
            _chk("receipts_to_customers", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
            _chk("lines_to_products", "SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"),
            _chk("lines_to_stores", "SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)"),
            _chk("customers_to_geographies", "SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)"),
            _chk("events_to_customers", "SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)"),
        ]
    ),
)
def d02_orphans(spark, sf):
    """Foreign-key orphans per relationship (left_anti counts)."""
    t = lambda n: d.table(spark, sf, n)
    return q.report(
        [
            q.orphans(t("lineitem"), t("orders"), ["l_orderkey"], ["o_orderkey"], "lines_to_receipts"),
            q.orphans(t("orders"), t("customer"), ["o_custkey"], ["c_custkey"], "receipts_to_customers"),
            q.orphans(t("lineitem"), t("part"), ["l_partkey"], ["p_partkey"], "lines_to_products"),
            q.orphans(t("lineitem"), t("supplier"), ["l_suppkey"], ["s_suppkey"], "lines_to_stores"),
            q.orphans(t("customer"), t("nation"), ["c_nationkey"], ["n_nationkey"], "customers_to_geographies"),
            q.orphans(t("events"), t("customer"), ["user_id"], ["c_custkey"], "events_to_customers"),
        ]
    )


@register("D03", _chk("moves_store_xor_dc", f"SELECT count(*) FROM {SQL_TRUCK_MOVES} m WHERE (store_id IS NULL) = (dc_id IS NULL)"))
def d03_exactly_one(spark, sf):
    return q.exactly_one(d.truck_moves(spark, sf), "store_id", "dc_id", "moves_store_xor_dc")


# Every fact and its date or time column.
_FACT_DATES = {"lines": (SQL_LINES, "event_date"), "receipts": (SQL_RECEIPTS, "event_date"), "sensors": (SQL_SENSORS, "event_ts"), "ledger": (SQL_LEDGER, "event_ts"), "truck_moves": (SQL_TRUCK_MOVES, "event_ts"), "marketing": (SQL_MARKETING, "event_ts"), "order_totals": (SQL_ORDER_TOTALS, "event_ts")}


@register("D04", " UNION ALL ".join(_chk(f"{name}_{c}", f"SELECT count(*) FROM {sql} x WHERE {c} IS NULL") for name, (sql, c) in _FACT_DATES.items()))
def d04_not_null_dates(spark, sf):
    """The date of every row of every fact is set."""
    facts = {"lines": d.lines, "receipts": d.receipts, "sensors": d.sensors, "ledger": d.ledger, "truck_moves": d.truck_moves, "marketing": d.marketing, "order_totals": order_totals}
    return q.report([q.not_null(fact(spark, sf), _FACT_DATES[name][1], f"{name}_{_FACT_DATES[name][1]}") for name, fact in facts.items()])


@register(
    "D05",
    _chk(
        "promo_discount_reconciles",
        f"""SELECT count(*) FROM (SELECT receipt_id, sum(CAST(round(ext_cents * discount) AS BIGINT)) AS a FROM {SQL_LINES} WHERE promo_code IS NOT NULL GROUP BY 1) x
  JOIN (SELECT receipt_id, sum(discount_cents) AS b FROM (SELECT receipt_id, promo_code, sum(CAST(round(ext_cents * discount) AS BIGINT)) AS discount_cents
    FROM {SQL_LINES} WHERE promo_code IS NOT NULL GROUP BY ALL) GROUP BY 1) y USING (receipt_id) WHERE a <> b""",
    ),
)
def d05_discount_reconciliation(spark, sf):
    """Promo rollup (A29) discounts equal the line discounts per receipt."""
    from storelake.operators import aggs

    li = d.lines(spark, sf).withColumn("disc", F.round(F.col("ext_cents") * F.col("discount")).cast("bigint"))
    a = li.where(F.col("promo_code").isNotNull()).groupBy("receipt_id").agg(F.sum("disc").alias("a"))
    b = aggs.promo_rollup(li, "receipt_id", "promo_code", "product_id", "disc", "quantity").groupBy("receipt_id").agg(F.sum("discount_cents").alias("b"))
    return q._row(a.join(b, "receipt_id"), "promo_discount_reconciles", F.count_if(F.col("a") != F.col("b")))


@register("D06", _chk("ship_after_order", "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate"))
def d06_temporal_order(spark, sf):
    """Ship date before order date (the driver data has many: SURVEY §7.2)."""
    li = d.table(spark, sf, "lineitem").join(d.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return q.ordered(li, "o_orderdate", "l_shipdate", "ship_after_order")


@register(
    "D07",
    _chk("price_bounds", "SELECT count(*) FROM (SELECT round(p_retailprice * 100) AS s FROM part) WHERE NOT (0 < round(s * 0.6) AND round(s * 0.6) < s AND s <= round(s * 1.1))"),
)
def d07_price_bounds(spark, sf):
    """0 < cost < sale price <= MSRP."""
    p = d.table(spark, sf, "part").select(d.cents("p_retailprice").alias("s"))
    cost, msrp = F.round(F.col("s") * 0.6), F.round(F.col("s") * 1.1)
    return q._row(p, "price_bounds", F.count_if(~((F.lit(0) < cost) & (cost < F.col("s")) & (F.col("s") <= msrp))))


@register(
    "D08",
    _chk("header_total_matches_lines", f"SELECT count(*) FROM {SQL_ORDER_TOTALS} t JOIN {SQL_RECEIPTS} r USING (receipt_id) WHERE t.total_cents <> r.total_cents"),
)
def d08_header_vs_lines(spark, sf):
    """Header total vs lines subtotal + line tax (driver totals are random,
    so this reports the mismatch count)."""
    t = order_totals(spark, sf).select("receipt_id", F.col("total_cents").alias("lines_total"))
    r = d.receipts(spark, sf).select("receipt_id", "total_cents")
    return q._row(t.join(r, "receipt_id"), "header_total_matches_lines", F.count_if(F.col("lines_total") != F.col("total_cents")))


@register("D09", _chk("one_payment_per_receipt", f"SELECT count(*) FROM (SELECT receipt_id, count(*) AS n FROM {SQL_RECEIPTS} GROUP BY 1) WHERE n <> 1"))
def d09_one_payment(spark, sf):
    """Exactly one payment (P11) per receipt with the receipt's amount."""
    from storelake.plans.silver import silver_payments

    p = silver_payments(spark, sf).groupBy("receipt_id_ext").agg(F.count(F.lit(1)).alias("n"), F.max("amount_cents").alias("amt"))
    r = d.receipts(spark, sf).select(F.concat(F.lit("RCP-"), F.lpad(F.col("receipt_id").cast("string"), 10, "0")).alias("receipt_id_ext"), "total_cents")
    return q._row(r.join(p, "receipt_id_ext", "left"), "one_payment_per_receipt", F.count_if(F.coalesce(F.col("n"), F.lit(0)) != 1) + F.count_if(F.col("amt") != F.col("total_cents")))


@register("D10", _chk("running_balance_consistent", "SELECT 0"))
def d10_balance_consistency(spark, sf):
    from storelake.plans.windows import balances

    return q.running_consistent(balances(spark, sf), ["store_id", "product_id"], ["event_ts", "txn_id"], "qty", "balance", "running_balance_consistent")


@register(
    "D11",
    _chk("lifecycle_complete", f"SELECT count(*) FROM (SELECT shipment_id, count(DISTINCT status) AS n FROM {SQL_TRUCK_MOVES} m GROUP BY 1) WHERE n <> 2"),
)
def d11_lifecycle_complete(spark, sf):
    """Every shipment has both ARRIVED and DEPARTED statuses."""
    m = d.truck_moves(spark, sf).groupBy("shipment_id").agg(F.size(F.collect_set("status")).alias("n"))
    return q._row(m, "lifecycle_complete", F.count_if(F.col("n") != 2))


@register(
    "D11_states",
    f"""WITH m AS (SELECT l_orderkey AS shipment_id, l_linenumber AS line, o_orderdate AS a, l_shipdate AS d, l_partkey AS p, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT shipment_id, min(a) AS a, max(d) AS d FROM m GROUP BY 1)
SELECT 'statuses_in_order' AS check, CAST(count_if(d <= a) AS BIGINT) AS violations FROM r
UNION ALL SELECT 'all_six_statuses', CAST(count_if(a IS NULL OR d IS NULL) AS BIGINT) FROM r
UNION ALL SELECT 'unload_has_load', CAST(0 AS BIGINT)
UNION ALL SELECT 'load_is_unloaded', CAST((SELECT count(*) FROM (SELECT shipment_id, p FROM m GROUP BY ALL HAVING sum(CASE WHEN d > a THEN q ELSE 0 END) < sum(q))) AS BIGINT)""",
)
def d11_lifecycle_states(spark, sf):
    """The six-status lifecycle of every shipment (= order): scheduled, loading and in transit an hour
    apart up to the order date, unloading and completed up to the last ship date; goods shipped after
    the order date are unloaded. A shipment with no ship date after its order date goes backwards."""
    li = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("shipment_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"), "l_shipdate")
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("shipment_id"), "o_orderdate")
    x = li.join(o, "shipment_id")
    ends = x.groupBy("shipment_id").agg(F.min("o_orderdate").alias("a"), F.max("l_shipdate").alias("d"))
    at = lambda c, hours: F.col(c) + F.expr(f"INTERVAL {hours} HOURS")
    times = [at("a", -3), at("a", -2), at("a", -1), F.col("a"), at("d", -1), F.col("d")]
    st = F.explode(F.array(*[F.struct(F.lit(n).alias("status"), t.alias("event_ts")) for n, t in zip(q.STATUSES, times, strict=True)])).alias("s")
    statuses = ends.select("shipment_id", st).select("shipment_id", "s.*").where(F.col("event_ts").isNotNull())
    load = x.select("shipment_id", "product_id", "quantity", F.lit("LOAD").alias("action"))
    unload = x.where(F.col("l_shipdate") > F.col("o_orderdate")).select("shipment_id", "product_id", "quantity", F.lit("UNLOAD").alias("action"))
    return q.lifecycle_checks(statuses, load.unionByName(unload))


@register(
    "D12",
    _chk("duplicate_line_keys_before", "SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
    + " UNION ALL "
    + _chk("duplicate_line_keys_after", "SELECT 0"),
)
def d12_duplicate_report(spark, sf):
    """Duplicate business keys before and after the W02 dedupe."""
    from storelake.operators import windows

    li = d.table(spark, sf, "lineitem")
    before = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    after = windows.dedupe_earliest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return q.report([q._row(before, "duplicate_line_keys_before", F.count_if(F.col("n") > 1)), q._row(after, "duplicate_line_keys_after", F.count_if(F.col("n") > 1))])


@register(
    "D13",
    """SELECT 'orders' AS source, CAST(count_if(o_orderdate IS NULL) AS BIGINT) AS nulls, CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date FROM orders
UNION ALL SELECT 'lineitem', CAST(count_if(l_shipdate IS NULL) AS BIGINT), CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) FROM lineitem
UNION ALL SELECT 'events', CAST(count_if(ts IS NULL) AS BIGINT), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""",
)
def d13_date_profile(spark, sf):
    t = lambda n: d.table(spark, sf, n)
    parts = []
    for name, df, c in (("orders", t("orders"), "o_orderdate"), ("lineitem", t("lineitem"), "l_shipdate"), ("events", t("events"), "ts")):
        parts.append(df.agg(F.count_if(F.col(c).isNull()).alias("nulls"), F.to_date(F.min(c)).alias("min_date"), F.to_date(F.max(c)).alias("max_date")).select(F.lit(name).alias("source"), "*"))
    return q.report(parts)


@register(
    "D14",
    _chk("lines_rowcount_parity", f"SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM {SQL_LINES} x WHERE receipt_type IN ('SALE', 'RETURN'))"),
)
def d14_rowcount_parity(spark, sf):
    """Row counts of lineitem vs its Silver projection (sales UNION returns)."""
    from storelake.plans.sets import u01_union_by_name

    a = d.table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))
    b = u01_union_by_name(spark, sf).agg(F.count(F.lit(1)).alias("d"))
    return q._pair(a, b, "lines_rowcount_parity")


@register(
    "D15",
    _chk("gold_tender_reconciles", f"SELECT (SELECT sum(total_cents) FROM {SQL_RECEIPTS} r) - (SELECT sum(c) FROM (SELECT sum(total_cents) AS c FROM {SQL_RECEIPTS} r GROUP BY CAST(event_ts AS DATE), tender_type))")
    + " UNION ALL "
    + _chk("gold_tender_count_reconciles", f"SELECT (SELECT count(*) FROM orders) - (SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE), o_orderpriority))"),
)
def d15_gold_reconciles(spark, sf):
    """Gold tender mix (A11) reconciles to its source in amount and count."""
    from storelake.operators import aggs

    r = d.receipts(spark, sf)
    g = aggs.tender_mix(r, "event_ts", "tender_type", "total_cents")
    src = r.agg(F.sum("total_cents").alias("n"), F.count(F.lit(1)).alias("cnt"))
    gold = g.agg(F.round(F.sum("total_amount") * 100).cast("bigint").alias("d"), F.sum("transactions").alias("gcnt"))
    a = q._pair(src.select("n"), gold.select("d"), "gold_tender_reconciles")
    b = q._pair(src.select(F.col("cnt").alias("n")), gold.select(F.col("gcnt").alias("d")), "gold_tender_count_reconciles")
    return q.report([a, b])


@register(
    "D16",
    _chk(
        "traffic_covers_purchases",
        f"""SELECT count(*) FROM (SELECT k, date_trunc('hour', ts) AS h, count(*) AS traffic, count_if(event_type = 'purchase') AS purchases
  FROM {SQL_EVENTS} GROUP BY ALL) WHERE traffic < purchases""",
    ),
)
def d16_traffic_vs_receipts(spark, sf):
    """Sensor traffic >= purchases per store-hour."""
    from storelake.operators import aggs

    e = d.events(spark, sf)
    g = e.groupBy("k", aggs.bucket_ts("ts", "hour")).agg(F.count(F.lit(1)).alias("traffic"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return q._row(g, "traffic_covers_purchases", F.count_if(F.col("traffic") < F.col("purchases")))
