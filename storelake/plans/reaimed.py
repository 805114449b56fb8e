"""Re-aimed simulator/engine-side operators (§2.13, R02–R22) on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

import storelake.plans.joins  # noqa: F401  # oracles that this module shares
import storelake.plans.silver  # noqa: F401
from storelake.functions.hashing import md5_unit_sql, seeded_sample
from storelake.operators import aggs, joins, windows
from storelake.plans.common import SQL_EVENTS, SQL_LINES, SQL_RECEIPTS, finish
from storelake.plans.gold import SQL_ORDER_TOTALS, SQL_TRUCK_MOVES, order_totals
from storelake.plans.named import _SQL_STOCKOUTS, stockouts
from storelake.plans.registry import ORACLES, register
from storelake.plans.windows import _SQL_BALANCES, balances
from storelake.sources import driver as d

# Reorder rule (deficit % thresholds) and point.
REORDER_POINT = 20
URGENT_PCT = 50
HIGH_PCT = 25


def reorder_signals(spark, sf, point: int = REORDER_POINT, top: int = 5, tail=None):
    """Per store and day, the top-5 products by that day's demand whose
    end-of-day balance is below the reorder point; quantity to refill to
    2 x point; priority by deficit % = (point - current) / point * 100:
    >= 50 URGENT, >= 25 HIGH, else NORMAL. With ``tail`` those of its days."""
    from storelake.plans.analytics import stock_daily

    x = stock_daily(spark, sf, tail=tail).withColumnRenamed("sold", "demand").where(F.col("demand") > 0)
    x = windows.top_n_per_group(x, ["store_id", "day"], [F.desc("demand"), F.asc("product_id")], top, "demand_rank")
    x = x.where(F.col("balance") < point)
    deficit = (F.lit(point) - F.col("balance")) / F.lit(point) * 100
    return x.select(
        "store_id",
        "product_id",
        "day",
        "event_ts",
        F.col("balance").alias("current_quantity"),
        F.lit(point).alias("reorder_point"),
        (F.lit(2 * point) - F.col("balance")).alias("reorder_quantity"),
        "demand",
        F.when(deficit >= URGENT_PCT, F.lit("URGENT")).when(deficit >= HIGH_PCT, F.lit("HIGH")).otherwise(F.lit("NORMAL")).alias("priority"),
    )


_SQL_REORDERS = f"""(WITH b AS (SELECT *, CAST(event_ts AS DATE) AS day FROM {_SQL_BALANCES}),
eod AS (SELECT store_id, product_id, day, balance, event_ts FROM b
        QUALIFY row_number() OVER (PARTITION BY store_id, product_id, day ORDER BY event_ts DESC, txn_id DESC) = 1),
dem AS (SELECT store_id, product_id, day, CAST(sum(CASE WHEN qty < 0 THEN -qty ELSE 0 END) AS BIGINT) AS demand FROM b GROUP BY ALL),
x AS (SELECT eod.*, demand, row_number() OVER (PARTITION BY eod.store_id, eod.day ORDER BY demand DESC, eod.product_id) AS rk
      FROM eod JOIN dem USING (store_id, product_id, day) WHERE demand > 0)
SELECT store_id, product_id, day, event_ts, balance AS current_quantity, {REORDER_POINT} AS reorder_point,
  {2 * REORDER_POINT} - balance AS reorder_quantity, demand,
  CASE WHEN ({REORDER_POINT} - balance) * 100.0 / {REORDER_POINT} >= {URGENT_PCT} THEN 'URGENT'
       WHEN ({REORDER_POINT} - balance) * 100.0 / {REORDER_POINT} >= {HIGH_PCT} THEN 'HIGH' ELSE 'NORMAL' END AS priority
FROM x WHERE rk <= 5 AND balance < {REORDER_POINT})"""


# R02 ---------------------------------------------------------------------------
@register(
    "R02",
    f"""SELECT * FROM lineitem WHERE {md5_unit_sql(['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey'], 11)} < 0.1""",
)
def r02_seeded_sample(spark, sf):
    """10 % line sample from an md5 draw of the line key: the same rows under
    any partitioning or re-run."""
    return seeded_sample(d.table(spark, sf, "lineitem"), list(d.LINE_KEY), 0.1, seed=11)


# R03 ---------------------------------------------------------------------------
@register("R03", None)
def r03_capped_group_sample(spark, sf):
    from storelake.plans.windows import w15_capped_group_sample

    return w15_capped_group_sample(spark, sf)


# R04 ---------------------------------------------------------------------------
@register("R04", None)
def r04_mirror_reversal(spark, sf):
    """Negated copies of the sampled receipts (returns), linked to the
    original, dated one day later."""
    from storelake.plans.windows import w15_capped_group_sample

    s = w15_capped_group_sample(spark, sf)
    r = d.receipts(spark, sf).select("receipt_id", "customer_id", "event_ts")
    return s.join(r, "receipt_id").select(
        F.concat(F.lit("RET-"), F.col("receipt_id").cast("string")).alias("return_id"),
        F.col("receipt_id").alias("original_receipt_id"),
        F.lit(None).cast("bigint").alias("customer_id"),
        "store_id",
        (F.col("event_ts") + F.expr("INTERVAL 1 DAY")).alias("event_ts"),
        (-F.col("total_cents")).alias("total_cents"),
        F.lit("RETURN").alias("receipt_type"),
    )


# R05 ---------------------------------------------------------------------------
@register(
    "R05",
    """SELECT l_suppkey AS store_id, l_partkey AS product_id, l_shipdate AS event_ts,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS qty,
  CASE WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'SALE' END AS txn_type FROM lineitem""",
)
def r05_inventory_ledger(spark, sf):
    """Sales (-qty) and returns (+qty) as signed movements on one ledger."""
    led = d.ledger(spark, sf)
    return led.select("store_id", "product_id", "event_ts", "qty", F.when(F.col("reason") == "R", F.lit("RETURN")).otherwise(F.lit("SALE")).alias("txn_type"))


# R06 ---------------------------------------------------------------------------
@register("R06", f"SELECT * FROM {_SQL_REORDERS}")
def r06_reorder_signals(spark, sf):
    return reorder_signals(spark, sf)


# R07 ---------------------------------------------------------------------------
@register("R07", None)
def r07_nearest_node(spark, sf):
    from storelake.plans.joins import j08_best_match

    return j08_best_match(spark, sf)


# R08 ---------------------------------------------------------------------------
@register("R08", None)
def r08_capacity_legs(spark, sf):
    from storelake.plans.windows import w14_capacity_legs

    return w14_capacity_legs(spark, sf)


# R09 ---------------------------------------------------------------------------
@register(
    "R09",
    f"""SELECT truck_id, CAST(dc_id AS DOUBLE) AS dc_id, CAST(store_id AS DOUBLE) AS store_id, shipment_id, eta, etd, status, event_ts
FROM {SQL_TRUCK_MOVES}""",
)
def r09_unpivot_lifecycle(spark, sf):
    """One wide (arrival, departure) row per line -> one row per status."""
    from storelake.plans.common import nullable_ids_as_double

    return nullable_ids_as_double(d.truck_moves(spark, sf), ("dc_id", "store_id"))


# R10 ---------------------------------------------------------------------------
@register(
    "R10",
    """WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rk,
             count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT o_orderkey, c_nationkey, s_suppkey AS assigned_supplier FROM orders JOIN customer ON o_custkey = c_custkey
JOIN s ON s.s_nationkey = c_nationkey AND s.rk = 1 + (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) % s.n)""",
)
def r10_round_robin(spark, sf):
    """Each order goes to supplier slot (day number mod pool size) of its
    customer's nation: a round robin over the pool by day."""
    sup = d.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"))
    n = sup.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("_n"))
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    left = o.join(c, "o_custkey").join(n, "c_nationkey")
    out = joins.rank_to_rank(left, sup, "c_nationkey", F.pmod(F.unix_date(F.to_date("o_orderdate")), F.col("_n")) + 1, [F.col("s_suppkey")])
    return out.select("o_orderkey", "c_nationkey", F.col("s_suppkey").alias("assigned_supplier"))


# R11 ---------------------------------------------------------------------------
@register("R11", f"SELECT * FROM {_SQL_STOCKOUTS}")
def r11_stockout_events(spark, sf):
    """Running balance (W05) then first crossing to <= 0 per key-day."""
    return stockouts(spark, sf)


# R12 ---------------------------------------------------------------------------
@register(
    "R12",
    f"""SELECT receipt_id, count(*) AS promo_codes, CAST(sum(discount_cents) AS BIGINT) AS discount_cents,
  CAST(sum(product_count) AS BIGINT) AS promoted_products FROM (
  SELECT receipt_id, promo_code, CAST(sum(CAST(round(ext_cents * discount) AS BIGINT)) AS BIGINT) AS discount_cents,
    count(DISTINCT product_id) AS product_count FROM {SQL_LINES} WHERE promo_code IS NOT NULL GROUP BY ALL) GROUP BY 1""",
)
def r12_promo_facts(spark, sf):
    """Promo lines rolled up per (receipt, code) (A29), then per receipt header."""
    li = d.lines(spark, sf).withColumn("disc", F.round(F.col("ext_cents") * F.col("discount")).cast("bigint"))
    pl = aggs.promo_rollup(li, "receipt_id", "promo_code", "product_id", "disc", "quantity")
    return pl.groupBy("receipt_id").agg(
        F.count(F.lit(1)).alias("promo_codes"), F.sum("discount_cents").alias("discount_cents"), F.sum("product_count").alias("promoted_products")
    )


# R13 ---------------------------------------------------------------------------
@register("R13", f"SELECT * FROM {SQL_ORDER_TOTALS}")
def r13_order_totals(spark, sf):
    """Header totals from lines with basis-point tax."""
    return order_totals(spark, sf)


# R14 ---------------------------------------------------------------------------
@register(
    "R14",
    """WITH t AS (SELECT s_nationkey, n_regionkey, l_tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
bn AS (SELECT s_nationkey, avg(l_tax) AS r FROM t GROUP BY 1), br AS (SELECT n_regionkey, avg(l_tax) AS r FROM t GROUP BY 1)
SELECT c_custkey, round(coalesce(bn.r, br.r, (SELECT avg(l_tax) FROM lineitem)), 6) AS tax_rate,
  CASE WHEN bn.r IS NOT NULL THEN 'nation' WHEN br.r IS NOT NULL THEN 'region' ELSE 'network' END AS rate_source
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN bn ON c_nationkey = bn.s_nationkey LEFT JOIN br ON nation.n_regionkey = br.n_regionkey""",
)
def r14_destination_tax_rate(spark, sf):
    """Destination tax rate per customer: mean line tax of suppliers in the
    customer's nation, else its region, else the network mean."""
    n = d.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    t = d.table(spark, sf, "lineitem").select("l_suppkey", "l_tax").join(
        d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"
    ).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    bn = t.groupBy("s_nationkey").agg(F.avg("l_tax").alias("_rn"))
    br = t.groupBy(F.col("n_regionkey").alias("_reg")).agg(F.avg("l_tax").alias("_rr"))
    net = t.agg(F.avg("l_tax")).first()[0]
    c = d.table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    x = c.join(bn, F.col("c_nationkey") == F.col("s_nationkey"), "left").join(br, F.col("n_regionkey") == F.col("_reg"), "left")
    return finish(
        x.select(
            "c_custkey",
            F.coalesce("_rn", "_rr", F.lit(net)).alias("tax_rate"),
            F.when(F.col("_rn").isNotNull(), F.lit("nation")).when(F.col("_rr").isNotNull(), F.lit("region")).otherwise(F.lit("network")).alias("rate_source"),
        ),
        6,
    )


# R15 ---------------------------------------------------------------------------
@register("R15", None)
def r15_zone_changes(spark, sf):
    from storelake.plans.windows import w10_zone_changes

    return w10_zone_changes(spark, sf)


# Conversion assumptions of the visitor estimate.
WEEKDAY_CONVERSION = 0.25
WEEKEND_CONVERSION = 0.20
BASELINE_VISITORS = 10


# R16 ---------------------------------------------------------------------------
@register(
    "R16",
    f"""WITH p AS (SELECT k AS store_id, date_trunc('hour', ts) AS hour, count(*) AS purchases FROM {SQL_EVENTS} WHERE event_type = 'purchase' GROUP BY ALL),
v AS (SELECT store_id, hour, CASE WHEN purchases = 0 THEN {BASELINE_VISITORS}
        ELSE CAST(ceil(purchases / CASE WHEN isodow(hour) >= 6 THEN {WEEKEND_CONVERSION} ELSE {WEEKDAY_CONVERSION} END) AS BIGINT) END AS visitors FROM p),
z AS (SELECT k AS store_id, event_type AS zone, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY k) AS share FROM {SQL_EVENTS} GROUP BY k, event_type)
SELECT v.store_id, v.hour, z.zone, v.visitors, round(v.visitors * z.share, 4) AS zone_visitors FROM v JOIN z ON v.store_id = z.store_id""",
)
def r16_visitor_estimate(spark, sf):
    """Visitors per store-hour = purchases / conversion (weekend vs weekday),
    baseline when zero, split over zones by each store's zone share."""
    e = d.events(spark, sf)
    p = e.where(F.col("event_type") == "purchase").groupBy(F.col("k").alias("store_id"), aggs.bucket_ts("ts", "hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("purchases")
    )
    weekend = F.dayofweek("hour").isin(1, 7)
    conv = F.when(weekend, F.lit(WEEKEND_CONVERSION)).otherwise(F.lit(WEEKDAY_CONVERSION))
    v = p.select("store_id", "hour", F.when(F.col("purchases") == 0, F.lit(BASELINE_VISITORS)).otherwise(F.ceil(F.col("purchases") / conv)).cast("bigint").alias("visitors"))
    z = e.groupBy(F.col("k").alias("store_id"), F.col("event_type").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    z = windows.share_of_total(z, ["store_id"], "n", "share")
    return finish(v.join(z, "store_id").select("store_id", "hour", "zone", "visitors", (F.col("visitors") * F.col("share")).alias("zone_visitors")), 4)


# R17 ---------------------------------------------------------------------------
@register(
    "R17",
    f"""SELECT event_id, k AS campaign_id, ts, CAST(floor(date_diff('day', min(CAST(ts AS DATE)) OVER (PARTITION BY k), CAST(ts AS DATE)) / 7) AS BIGINT) AS window_no
FROM {SQL_EVENTS} WHERE event_type = 'view'""",
)
def r17_campaign_window(spark, sf):
    """Campaign flight bucket: floor(days since the campaign's first
    impression / 7)."""
    m = d.marketing(spark, sf)
    start = m.groupBy("campaign_id").agg(F.min(F.to_date("event_ts")).alias("_start"))
    x = m.join(start, "campaign_id")
    return x.select(
        F.col("impression_id").alias("event_id"), "campaign_id", F.col("event_ts").alias("ts"), F.floor(F.datediff(F.to_date("event_ts"), "_start") / 7).cast("bigint").alias("window_no")
    )


# R19 ---------------------------------------------------------------------------
@register(
    "R19",
    """WITH m AS (SELECT p_type AS category, month(l_shipdate) AS month, sum(l_quantity) AS units FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT category, CAST(month AS INTEGER) AS month, CAST(units AS BIGINT) AS units, round(units / avg(units) OVER (PARTITION BY category), 6) AS seasonal_index FROM m""",
)
def r19_seasonal_index(spark, sf):
    """Demand per category and calendar month relative to the category's mean month."""
    li = d.table(spark, sf, "lineitem").join(d.table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    m = li.groupBy(F.col("p_type").alias("category"), F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("units"))
    w = windows.Window.partitionBy("category")
    return finish(m.withColumn("seasonal_index", F.col("units") / F.avg("units").over(w)).withColumn("units", F.col("units").cast("bigint")), 6)


# R21 ---------------------------------------------------------------------------
@register(
    "R21_nodes",
    """SELECT 'region' AS entity, CAST(r_regionkey AS BIGINT) AS id, r_name AS label FROM region
UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation
UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
UNION ALL SELECT 'part', p_partkey, p_name FROM part""",
)
def r21_graph_nodes(spark, sf):
    """Entity nodes (entity, id, label) from per-entity projections."""
    t = lambda n: d.table(spark, sf, n)
    specs = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
    out = None
    for ent, idc, lab in specs:
        part = t(ent).select(F.lit(ent).alias("entity"), F.col(idc).cast("bigint").alias("id"), F.col(lab).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


@register("R21", ORACLES["R21_nodes"])
def r21_graph(spark, sf):
    """Graph nodes (entity, id, label); edges are R21_edges."""
    return r21_graph_nodes(spark, sf)


@register(
    "R21_edges",
    """SELECT DISTINCT * FROM (
  SELECT 'in_region' AS name, 'nation' AS src_entity, CAST(n_nationkey AS BIGINT) AS src, 'region' AS dst_entity, CAST(n_regionkey AS BIGINT) AS dst FROM nation
  UNION ALL SELECT 'lives_in', 'customer', c_custkey, 'nation', c_nationkey FROM customer
  UNION ALL SELECT 'based_in', 'supplier', s_suppkey, 'nation', s_nationkey FROM supplier
  UNION ALL SELECT 'supplies', 'supplier', l_suppkey, 'part', l_partkey FROM lineitem
  UNION ALL SELECT 'buys', 'customer', o_custkey, 'part', l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
)
def r21_graph_edges(spark, sf):
    """Relationship edges from relationship configs: per-config select + union + distinct."""
    t = lambda n: d.table(spark, sf, n)
    e = lambda df, name, se, s, de, dd: df.select(F.lit(name).alias("name"), F.lit(se).alias("src_entity"), F.col(s).cast("bigint").alias("src"), F.lit(de).alias("dst_entity"), F.col(dd).cast("bigint").alias("dst"))
    li, o = t("lineitem"), t("orders")
    parts = [
        e(t("nation"), "in_region", "nation", "n_nationkey", "region", "n_regionkey"),
        e(t("customer"), "lives_in", "customer", "c_custkey", "nation", "c_nationkey"),
        e(t("supplier"), "based_in", "supplier", "s_suppkey", "nation", "s_nationkey"),
        e(li, "supplies", "supplier", "l_suppkey", "part", "l_partkey"),
        e(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "buys", "customer", "o_custkey", "part", "l_partkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# R22 ---------------------------------------------------------------------------
# Bindings of the timeline: entity, source, and the source's key, time, kind and reference.
TIMELINE_BINDINGS = [
    ("customer", "orders", "o_custkey", "o_orderdate", "'order'", "o_orderkey"),
    ("customer", "events", "user_id", "ts", "concat('event_', event_type)", "event_id"),
    ("supplier", "lineitem", "l_suppkey", "l_shipdate", "CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'shipment' END", "l_orderkey"),
    ("product", "lineitem", "l_partkey", "l_shipdate", "CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'sold' END", "l_orderkey"),
]


@register(
    "R22",
    "SELECT entity, entity_id, ts, kind, ref, row_number() OVER (PARTITION BY entity, entity_id ORDER BY ts, kind, ref) AS seq FROM ("
    + " UNION ALL ".join(f"SELECT '{entity}' AS entity, CAST({key} AS BIGINT) AS entity_id, {ts} AS ts, {kind} AS kind, CAST({ref} AS BIGINT) AS ref FROM {source}" for entity, source, key, ts, kind, ref in TIMELINE_BINDINGS)
    + ")",
)
def r22_entity_timeline(spark, sf):
    """Timeline of every entity from all its bound sources, numbered in time order. Every row of a
    bound source is there, whether or not the entity has rows in another one."""
    parts = [
        d.table(spark, sf, source).select(F.lit(entity).alias("entity"), F.col(key).cast("bigint").alias("entity_id"), F.col(ts).alias("ts"), F.expr(kind).alias("kind"), F.col(ref).cast("bigint").alias("ref"))
        for entity, source, key, ts, kind, ref in TIMELINE_BINDINGS
    ]
    x = reduce(lambda a, b: a.unionByName(b), parts)
    numbered = windows.bucketed_row_number(x, ["entity", "entity_id"], [F.col("ts"), F.col("kind"), F.col("ref")], F.to_date("ts"), "seq")
    return numbered.withColumn("seq", F.col("seq").cast("bigint"))


# Ids whose query is another id's query share its oracle.
for _alias, _src in (("R03", "W15"), ("R07", "J08"), ("R08", "W14"), ("R15", "W10")):
    if _src in ORACLES:
        ORACLES[_alias] = ORACLES[_src]

ORACLES["AL02"] = f"""SELECT * FROM {_SQL_REORDERS} r WHERE priority = 'URGENT'
  AND event_ts > (SELECT max(event_ts) FROM {_SQL_REORDERS}) - INTERVAL 600 SECOND"""
ORACLES["PJ04"] = f"""SELECT signal, store_id, product_id, count(*) AS signals, max(event_ts) AS latest FROM (
  SELECT 'reorder' AS signal, store_id, product_id, event_ts FROM {_SQL_REORDERS}
  UNION ALL SELECT 'stockout', store_id, product_id, event_ts FROM {_SQL_STOCKOUTS})
WHERE event_ts > (SELECT greatest((SELECT max(event_ts) FROM {_SQL_REORDERS}), (SELECT max(event_ts) FROM {_SQL_STOCKOUTS}))) - INTERVAL 1800 SECOND
GROUP BY ALL ORDER BY latest DESC, signal, store_id, product_id LIMIT 25"""

# Oracles of projections over the views defined in several modules.
_SQL_P15 = f"""SELECT store_id, CAST(NULL AS DOUBLE) AS dc_id, product_id, current_quantity, reorder_quantity, reorder_point, priority, event_ts, day AS event_date
FROM {_SQL_REORDERS} r"""
ORACLES["P15"] = _SQL_P15
ORACLES["P35"] = f"SELECT * EXCLUDE (event_date) FROM ({_SQL_P15})"
ORACLES["P36"] = f"SELECT store_id, CAST(dc_id AS DOUBLE) AS dc_id, product_id, last_known_quantity, event_ts FROM ({ORACLES['P14']})"
ORACLES["P37"] = f"SELECT shipment_id, truck_id, CAST(dc_id AS DOUBLE) AS dc_id, CAST(store_id AS DOUBLE) AS store_id, status, event_ts FROM {SQL_TRUCK_MOVES}"
ORACLES["P21"] = f"""SELECT 'ORD-' || CAST(receipt_id AS VARCHAR) AS order_id_ext, customer_id, subtotal_cents, tax_cents, total_cents,
  printf('%d.%02d', subtotal_cents // 100, subtotal_cents % 100) AS subtotal_amount, printf('%d.%02d', tax_cents // 100, tax_cents % 100) AS tax_amount,
  printf('%d.%02d', total_cents // 100, total_cents % 100) AS total_amount, tender_type AS payment_method, event_ts, CAST(event_ts AS DATE) AS event_date
FROM {SQL_ORDER_TOTALS}"""
ORACLES["R04"] = f"""SELECT 'RET-' || CAST(s.receipt_id AS VARCHAR) AS return_id, s.receipt_id AS original_receipt_id, CAST(NULL AS DOUBLE) AS customer_id, store_id,
  o_orderdate + INTERVAL 1 DAY AS event_ts, -total_cents AS total_cents, 'RETURN' AS receipt_type FROM ({ORACLES['W15']}) s JOIN orders ON s.receipt_id = o_orderkey"""
