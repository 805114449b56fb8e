"""Join operators J01–J24 bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelake.operators import aggs, joins, windows
from storelake.plans.common import SQL_EVENTS, SQL_LINES, SQL_RECEIPTS, finish, nullable_ids_as_double, scalar
from storelake.plans.gold import SQL_LIFECYCLES, lifecycles
from storelake.plans.named import _SQL_DECISIONS, _SQL_RECS, decisions, recommendations
from storelake.plans.registry import register
from storelake.plans.windows import _SQL_SESSIONS, SESSION_GAP_S, sessions
from storelake.sources import driver as d


# J01 ---------------------------------------------------------------------------
@register(
    "J01",
    f"""SELECT l.receipt_id, l.line_num, l.product_id, l.store_id, l.quantity, l.ext_cents, r.customer_id, r.tender_type,
  r.event_ts AS receipt_ts FROM {SQL_LINES} l JOIN {SQL_RECEIPTS} r ON l.receipt_id = r.receipt_id""",
)
def j01_header_line(spark, sf):
    li = d.lines(spark, sf).select("receipt_id", "line_num", "product_id", "store_id", "quantity", "ext_cents")
    r = d.receipts(spark, sf).select("receipt_id", "customer_id", "tender_type", F.col("event_ts").alias("receipt_ts"))
    return li.join(r, "receipt_id", "inner")


# J02 ---------------------------------------------------------------------------
@register(
    "J02",
    f"""WITH a AS (SELECT max(event_date) AS as_of FROM {SQL_RECEIPTS}),
f AS (SELECT customer_id, count(*) AS orders, CAST(sum(total_cents) AS BIGINT) AS spend_cents,
        CAST(date_diff('day', max(event_date), (SELECT as_of FROM a)) AS INTEGER) AS recency_days
      FROM {SQL_RECEIPTS} WHERE event_date > (SELECT as_of FROM a) - INTERVAL 365 DAY GROUP BY 1)
SELECT c_custkey AS customer_id, c_mktsegment, coalesce(orders, 0) AS orders, coalesce(spend_cents, 0) AS spend_cents,
  coalesce(recency_days, 366) AS recency_days
FROM customer LEFT JOIN f ON c_custkey = f.customer_id""",
)
def j02_left_join_fill(spark, sf):
    """Every customer with last-365-day activity; absent activity gets 0 and
    recency gets window + 1 (366)."""
    r = d.receipts(spark, sf)
    as_of = scalar(r, F.max("event_date"))
    recent = r.where(F.col("event_date") > F.date_sub(F.lit(as_of), 365))
    f = recent.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_cents").alias("spend_cents"), F.datediff(F.lit(as_of), F.max("event_date")).alias("recency_days")
    )
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), "c_mktsegment")
    return joins.fill_defaults(c.join(f, "customer_id", "left"), {"orders": 0, "spend_cents": 0, "recency_days": 366})


# J03 ---------------------------------------------------------------------------
@register(
    "J03",
    f"""SELECT * FROM {SQL_LINES} l WHERE l.product_id IN (
  SELECT product_id FROM {SQL_LINES} WHERE receipt_type = 'SALE' GROUP BY product_id HAVING count(DISTINCT event_date) >= 35)""",
)
def j03_semi_join(spark, sf):
    """Lines restricted to products sold on >= 35 distinct days (left_semi)."""
    li = d.lines(spark, sf)
    q = li.where(F.col("receipt_type") == "SALE").groupBy("product_id").agg(F.count_distinct("event_date").alias("n")).where(F.col("n") >= 35)
    return li.join(q.select("product_id"), "product_id", "left_semi")


# J04 ---------------------------------------------------------------------------
@register(
    "J04",
    f"""WITH l AS {SQL_LIFECYCLES}, a AS (SELECT max(arrival_ts) AS m FROM l)
SELECT truck_id, CAST(dc_id AS DOUBLE) AS dc_id, CAST(store_id AS DOUBLE) AS store_id, shipment_id, arrival_ts, departure_ts FROM l WHERE NOT EXISTS (
  SELECT 1 FROM l o WHERE o.arrival_ts < (SELECT m FROM a) - INTERVAL 365 DAY
    AND o.truck_id IS NOT DISTINCT FROM l.truck_id AND o.dc_id IS NOT DISTINCT FROM l.dc_id
    AND o.store_id IS NOT DISTINCT FROM l.store_id AND o.shipment_id IS NOT DISTINCT FROM l.shipment_id)""",
)
def j04_anti_join_new_keys(spark, sf):
    """Only lifecycles not already stored (stored = arrived over a year before
    the latest), on a null-safe 4-key anti join."""
    life = lifecycles(spark, sf).select("truck_id", "dc_id", "store_id", "shipment_id", "arrival_ts", "departure_ts")
    m = scalar(life, F.max("arrival_ts"))
    stored = life.where(F.col("arrival_ts") < F.lit(m) - F.expr("INTERVAL 365 DAYS")).select("truck_id", "dc_id", "store_id", "shipment_id")
    keys = ["truck_id", "dc_id", "store_id", "shipment_id"]
    return nullable_ids_as_double(life.join(stored, joins.null_safe_on(life, stored, keys), "left_anti"), ("dc_id", "store_id"))


# J05 ---------------------------------------------------------------------------
@register(
    "J05",
    f"""SELECT product_id, event_date, CAST(sum(quantity) AS BIGINT) AS units FROM {SQL_LINES} s
WHERE promo_code IS NULL AND NOT EXISTS (SELECT 1 FROM {SQL_LINES} p WHERE p.promo_code IS NOT NULL
  AND p.product_id = s.product_id AND p.event_date = s.event_date) GROUP BY ALL""",
)
def j05_anti_join_two_keys(spark, sf):
    """Unpromoted sales on days the product was never promoted (two-key anti join)."""
    li = d.lines(spark, sf)
    promo_days = li.where(F.col("promo_code").isNotNull()).select("product_id", "event_date")
    base = li.where(F.col("promo_code").isNull()).join(promo_days, ["product_id", "event_date"], "left_anti")
    return base.groupBy("product_id", "event_date").agg(F.sum("quantity").alias("units"))


# J06 ---------------------------------------------------------------------------
@register(
    "J06",
    f"""WITH s AS (SELECT product_id, event_date, CAST(sum(quantity) AS BIGINT) AS sold FROM {SQL_LINES} WHERE receipt_type = 'SALE' GROUP BY ALL),
r AS (SELECT product_id, event_date, CAST(sum(quantity) AS BIGINT) AS returned FROM {SQL_LINES} WHERE receipt_type = 'RETURN' GROUP BY ALL),
g AS (SELECT coalesce(s.product_id, r.product_id) AS product_id, coalesce(s.event_date, r.event_date) AS event_date,
        coalesce(sold, 0) AS sold, coalesce(returned, 0) AS returned FROM s FULL OUTER JOIN r ON s.product_id = r.product_id AND s.event_date = r.event_date)
SELECT g.*, p_type AS department, p_brand AS brand FROM g JOIN part ON g.product_id = p_partkey""",
)
def j06_full_outer_grids(spark, sf):
    """Sales grid full-outer returns grid, zeros filled, then product
    attributes re-joined so they are never NULL."""
    li = d.lines(spark, sf)
    s = li.where(F.col("receipt_type") == "SALE").groupBy("product_id", "event_date").agg(F.sum("quantity").alias("sold"))
    r = li.where(F.col("receipt_type") == "RETURN").groupBy("product_id", "event_date").agg(F.sum("quantity").alias("returned"))
    g = s.join(r, ["product_id", "event_date"], "full_outer").fillna({"sold": 0, "returned": 0})
    p = d.products(spark, sf).select("product_id", "department", "brand")
    return g.join(p, "product_id", "inner")


# J07 ---------------------------------------------------------------------------
@register(
    "J07",
    """SELECT CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS created, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS picked,
  CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS shipped FROM orders
WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY""",
)
def j07_single_row_aggregates(spark, sf):
    """Created / picked / shipped counts over the last 30 days in one scan.
    The reference joins three one-row aggregates; conditional counts in a
    single aggregate give the same row without any join."""
    o = d.table(spark, sf, "orders")
    m = scalar(o, F.max("o_orderdate"))
    recent = o.where(F.col("o_orderdate") > F.lit(m) - F.expr("INTERVAL 30 DAYS"))
    return recent.agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("created"),
        F.count_if(F.col("o_orderstatus") == "P").alias("picked"),
        F.count_if(F.col("o_orderstatus") == "F").alias("shipped"),
    )


# J08 ---------------------------------------------------------------------------
@register(
    "J08",
    """WITH sup AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cust AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
bn AS (SELECT s_nationkey, min(s_suppkey) AS m FROM sup GROUP BY 1), br AS (SELECT n_regionkey, min(s_suppkey) AS m FROM sup GROUP BY 1)
SELECT c_custkey, c_nationkey, cust.n_regionkey, coalesce(bn.m, br.m, (SELECT min(s_suppkey) FROM supplier)) AS match_id,
  CASE WHEN bn.m IS NOT NULL THEN 0 WHEN br.m IS NOT NULL THEN 1 ELSE 2 END AS match_score
FROM cust LEFT JOIN bn ON cust.c_nationkey = bn.s_nationkey LEFT JOIN br ON cust.n_regionkey = br.n_regionkey""",
)
def j08_best_match(spark, sf):
    """Nearest supplier per customer: same nation (0), same region (1),
    else any (2); ties to the smallest supplier id."""
    n = d.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    sup = d.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    cust = d.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    out = joins.best_match(cust, sup, "c_custkey", "s_suppkey", [("c_nationkey", "s_nationkey"), ("n_regionkey", "n_regionkey")])
    return out.withColumn("match_score", F.col("match_score").cast("int"))


_SQL_EPISODES = f"""(SELECT store_id, promo_code, episode_no, min(d) AS start_date, max(d) AS end_date FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR date_diff('day', prev, d) > 7 THEN 1 ELSE 0 END)
      OVER (PARTITION BY store_id, promo_code ORDER BY d ROWS UNBOUNDED PRECEDING) AS episode_no FROM (
    SELECT *, lag(d) OVER (PARTITION BY store_id, promo_code ORDER BY d) AS prev FROM (
      SELECT DISTINCT store_id, promo_code, event_date AS d FROM {SQL_LINES} WHERE promo_code IS NOT NULL)))
  GROUP BY ALL)"""


# J09 ---------------------------------------------------------------------------
@register(
    "J09",
    f"""SELECT e.store_id, e.promo_code, CAST(e.episode_no AS BIGINT) AS episode_no, count(*) AS sales_days,
  CAST(sum(s.units) AS BIGINT) AS units FROM {_SQL_EPISODES} e
JOIN (SELECT store_id, event_date, sum(quantity) AS units FROM {SQL_LINES} GROUP BY ALL) s
  ON e.store_id = s.store_id AND s.event_date BETWEEN e.start_date AND e.end_date GROUP BY ALL""",
)
def j09_range_join(spark, sf):
    """Store sales days inside each promo episode window (bucketed range join)."""
    li = d.lines(spark, sf)
    ep = windows.episodes(li.where(F.col("promo_code").isNotNull()).select("store_id", "promo_code", F.col("event_date").alias("d")), ["store_id", "promo_code"], "d", 7)
    daily = li.groupBy("store_id", "event_date").agg(F.sum("quantity").alias("units"))
    ep = ep.select("store_id", "promo_code", "episode_no", F.col("start_date").cast("timestamp_ntz").alias("s"), F.col("end_date").cast("timestamp_ntz").alias("e"))
    daily = daily.withColumn("t", F.col("event_date").cast("timestamp_ntz"))
    m = joins.range_join(ep, daily, ["store_id"], "s", "e", "t", bucket_seconds=7 * 86400)
    return m.groupBy("store_id", "promo_code", F.col("episode_no").cast("bigint").alias("episode_no")).agg(
        F.count(F.lit(1)).alias("sales_days"), F.sum("units").alias("units")
    )


# J10 ---------------------------------------------------------------------------
@register(
    "J10",
    f"""WITH s AS (SELECT user_id, session_no, min(ts) AS start_ts, max(ts) AS end_ts FROM {_SQL_SESSIONS} GROUP BY ALL)
SELECT s.user_id, s.session_no, s.start_ts, s.end_ts, CAST(p.event_id AS DOUBLE) AS purchase_id, p.value AS purchase_value FROM s
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = s.user_id
  AND p.ts >= s.start_ts AND p.ts <= s.end_ts + INTERVAL 5 MINUTE""",
)
def j10_time_window_join(spark, sf):
    """Session x purchases of the same device, start <= ts <= end + 5 min, left."""
    s = sessions(spark, sf).groupBy("user_id", F.col("session_no").cast("bigint").alias("session_no")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )
    s = s.withColumn("grace_end", F.col("end_ts") + F.expr("INTERVAL 5 MINUTES"))
    p = d.table(spark, sf, "events").where(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"), F.col("value").alias("purchase_value")
    )
    m = joins.range_join(s, p, ["user_id"], "start_ts", "grace_end", "purchase_ts", bucket_seconds=SESSION_GAP_S, how="left", left_id=["user_id", "session_no"])
    return nullable_ids_as_double(m.select("user_id", "session_no", "start_ts", "end_ts", "purchase_id", "purchase_value"), ("purchase_id",))


# J11 ---------------------------------------------------------------------------
@register(
    "J11",
    """SELECT o.o_orderkey, o.o_custkey, o.o_orderdate,
  CASE WHEN EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderdate > o.o_orderdate
    AND n.o_orderdate <= o.o_orderdate + INTERVAL 30 DAY) THEN 1 ELSE 0 END AS label FROM orders o""",
)
def j11_future_event(spark, sf):
    """Does the customer order again strictly after and within 30 days?"""
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = joins.next_event_within(o, o, ["o_custkey"], "o_orderdate", "o_orderdate", 30 * 86400)
    return out.select("o_orderkey", "o_custkey", "o_orderdate", "label")


# J12 ---------------------------------------------------------------------------
@register(
    "J12",
    f"""WITH day AS (SELECT product_id, event_date, CAST(sum(quantity) AS BIGINT) AS units FROM {SQL_LINES} GROUP BY ALL)
SELECT product_id, event_date, units,
  CAST(sum(units) OVER (PARTITION BY product_id ORDER BY event_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS units_7d,
  CAST(sum(units) OVER (PARTITION BY product_id ORDER BY event_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS units_30d
FROM day""",
)
def j12_trailing_window(spark, sf):
    """Units in the 7/30 days up to each snapshot day: cumulative range frames
    replace the reference's snapshot x sales range join."""
    day = d.lines(spark, sf).groupBy("product_id", "event_date").agg(F.sum("quantity").alias("units"))
    w = windows.Window.partitionBy("product_id").orderBy(F.unix_date("event_date"))
    return day.withColumn("units_7d", F.sum("units").over(w.rangeBetween(-6, 0))).withColumn("units_30d", F.sum("units").over(w.rangeBetween(-29, 0)))


# J13 ---------------------------------------------------------------------------
@register(
    "J13",
    """SELECT e.event_id, e.user_id, e.event_type, coalesce(n_name, 'UNKNOWN') AS nation, coalesce(n_regionkey, -1) AS region
FROM events e LEFT JOIN nation ON e.user_id = n_nationkey""",
)
def j13_static_enrichment(spark, sf):
    """Stream-static enrichment (batch face): events x nation dim with defaults for
    unknown keys; AQE broadcasts the dim by its measured size."""
    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("user_id"), "n_name", "n_regionkey")
    e = d.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    out = e.join(n, "user_id", "left")
    return out.select("event_id", "user_id", "event_type", F.coalesce("n_name", F.lit("UNKNOWN")).alias("nation"), F.coalesce("n_regionkey", F.lit(-1)).alias("region"))


# J14 ---------------------------------------------------------------------------
@register(
    "J14",
    f"""SELECT truck_id, CAST(dc_id AS DOUBLE) AS dc_id, CAST(store_id AS DOUBLE) AS store_id, shipment_id, arrival_ts, departure_ts,
  round(dwell_minutes, 4) AS dwell_minutes, site FROM {SQL_LIFECYCLES}""",
)
def j14_lifecycle_pairs(spark, sf):
    """Earliest arrival with latest departure per (truck, dc, store,
    shipment), null-safe keys, positive dwell, site label."""
    return finish(nullable_ids_as_double(lifecycles(spark, sf), ("dc_id", "store_id")), 4)


_SQL_ATTRIB = f"""(SELECT i.event_id AS impression_id, i.user_id, i.k AS campaign_id, i.ts AS impression_ts,
  c.event_id AS conversion_id, c.ts AS conversion_ts, c.value AS revenue
FROM {SQL_EVENTS} i JOIN {SQL_EVENTS} c ON c.user_id = i.user_id AND c.event_type = 'purchase'
  AND c.ts >= i.ts AND c.ts <= i.ts + INTERVAL 24 HOUR WHERE i.event_type = 'view')"""


def attribution(spark, sf, hours=24):
    e = d.events(spark, sf)
    imp = e.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("impression_id"), "user_id", F.col("k").alias("campaign_id"), F.col("ts").alias("impression_ts")
    ).withColumn("_end", F.col("impression_ts") + F.expr(f"INTERVAL {hours} HOURS"))
    conv = e.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("conversion_id"), F.col("ts").alias("conversion_ts"), F.col("value").alias("revenue")
    )
    return joins.range_join(imp, conv, ["user_id"], "impression_ts", "_end", "conversion_ts", bucket_seconds=hours * 3600).drop("_end")


# J15 ---------------------------------------------------------------------------
@register("J15", f"SELECT * FROM {_SQL_ATTRIB}")
def j15_attribution(spark, sf):
    """Impression -> conversion of the same user within 24 h (inner, G09)."""
    return attribution(spark, sf)


# J16 ---------------------------------------------------------------------------
@register(
    "J16",
    f"""WITH i AS (SELECT k AS campaign_id, count(*) AS impressions FROM {SQL_EVENTS} WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT k AS campaign_id, count(*) AS conversions, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
      FROM {SQL_EVENTS} WHERE event_type = 'purchase' GROUP BY 1)
SELECT i.campaign_id, i.impressions, coalesce(c.conversions, 0) AS conversions,
  CAST(coalesce(c.conversions, 0) AS DOUBLE) / i.impressions AS conversion_rate, coalesce(c.revenue_cents, 0) AS revenue_cents
FROM i LEFT JOIN c ON i.campaign_id = c.campaign_id""",
)
def j16_campaign_funnel(spark, sf):
    """Impressions per campaign left join conversions (purchases), rate, revenue."""
    e = d.events(spark, sf)
    i = e.where(F.col("event_type") == "view").groupBy(F.col("k").alias("campaign_id")).agg(F.count(F.lit(1)).alias("impressions"))
    c = e.where(F.col("event_type") == "purchase").groupBy(F.col("k").alias("campaign_id")).agg(
        F.count(F.lit(1)).alias("conversions"), F.sum(d.cents("value")).alias("revenue_cents")
    )
    out = i.join(c, "campaign_id", "left").fillna({"conversions": 0, "revenue_cents": 0})
    return out.withColumn("conversion_rate", F.try_divide(F.col("conversions").cast("double"), F.col("impressions")))


# J17 ---------------------------------------------------------------------------
@register(
    "J17",
    f"""SELECT r.recommendation_id, r.product_id, r.created_ts, x.decision_id, x.decided_ts, x.action
FROM {_SQL_RECS} r JOIN {_SQL_DECISIONS} x ON r.recommendation_id = x.recommendation_id""",
)
def j17_decision_join(spark, sf):
    """Recommendation <-> approve/reject decisions, inner join on the id."""
    r = recommendations(spark, sf).select("recommendation_id", "product_id", "created_ts")
    x = decisions(spark, sf).select("recommendation_id", "decision_id", "decided_ts", "action")
    return r.join(x, "recommendation_id", "inner")


# J18 ---------------------------------------------------------------------------
@register(
    "J18",
    f"""SELECT CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS channel_spend_cents FROM {SQL_EVENTS}
WHERE event_type = 'view' AND k IN (SELECT k FROM {SQL_EVENTS} WHERE event_type = 'purchase')""",
)
def j18_virtual_relationship(spark, sf):
    """TREATAS: spend of campaigns that appear among conversions (left_semi
    on the distinct campaign ids), then sum."""
    e = d.events(spark, sf)
    spend = e.where(F.col("event_type") == "view")
    conv_keys = e.where(F.col("event_type") == "purchase").select("k").distinct()
    return spend.join(conv_keys, "k", "left_semi").agg(F.sum(d.cents("value")).alias("channel_spend_cents"))


# J19 ---------------------------------------------------------------------------
@register(
    "J19",
    f"""SELECT l.store_id, CAST(sum(l.quantity * coalesce(CAST(round(p_retailprice * 100) AS BIGINT), 0)) AS BIGINT) AS line_cost_cents
FROM {SQL_LINES} l LEFT JOIN part ON l.product_id = p_partkey GROUP BY 1""",
)
def j19_lookup_default(spark, sf):
    """Per-line product cost lookup with default 0 (LOOKUPVALUE), summed per store."""
    p = d.products(spark, sf).select("product_id", "msrp_cents")
    li = d.lines(spark, sf).join(p, "product_id", "left")
    return li.groupBy("store_id").agg(F.sum(F.col("quantity") * F.coalesce("msrp_cents", F.lit(0))).alias("line_cost_cents"))


# J20 ---------------------------------------------------------------------------
@register(
    "J20",
    """WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rk,
             count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT o_orderkey, c_nationkey, s_suppkey AS assigned_supplier FROM orders JOIN customer ON o_custkey = c_custkey
JOIN s ON s.s_nationkey = c_nationkey AND s.rk = 1 + o_orderkey % s.n""",
)
def j20_rank_to_rank(spark, sf):
    """Each order is assigned the k-th supplier of its customer's nation,
    k = 1 + order key mod (suppliers in the nation)."""
    sup = d.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"))
    n = sup.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("_n"))
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    left = o.join(c, "o_custkey").join(n, "c_nationkey")
    out = joins.rank_to_rank(left, sup, "c_nationkey", F.pmod(F.col("o_orderkey"), F.col("_n")) + 1, [F.col("s_suppkey")])
    return out.select("o_orderkey", "c_nationkey", F.col("s_suppkey").alias("assigned_supplier"))


# J21 ---------------------------------------------------------------------------
@register(
    "J21",
    f"""SELECT dayname(event_date) AS day_name, CAST(sum(ext_cents) AS BIGINT) AS revenue_cents FROM {SQL_LINES} GROUP BY 1""",
)
def j21_timestamp_to_date(spark, sf):
    """Lines joined to the calendar on to_date(ts) (datePartOnly), revenue by weekday."""
    from storelake.functions import calendar

    li = d.lines(spark, sf)
    bounds = li.agg(F.min("event_date").alias("start"), F.max("event_date").alias("end"))
    cal = calendar.dim_date(bounds).select(F.col("date").alias("event_date"), "day_name")
    return li.join(cal, "event_date", "inner").groupBy("day_name").agg(F.sum("ext_cents").alias("revenue_cents"))


# J22 ---------------------------------------------------------------------------
@register(
    "J22",
    """WITH t AS (SELECT from_state, to_state, count(*) AS n FROM (
  SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
  WHERE from_state IS NOT NULL GROUP BY ALL)
SELECT t.from_state, t.to_state, t.n, CAST(tot.total AS BIGINT) AS total, round(CAST(t.n AS DOUBLE) / tot.total, 6) AS probability
FROM t LEFT JOIN (SELECT from_state, sum(n) AS total FROM t GROUP BY 1) tot ON t.from_state = tot.from_state""",
)
def j22_ratio_of_parts(spark, sf):
    """Transition counts left joined to their per-origin totals."""
    e = d.table(spark, sf, "events")
    t = windows.previous(e, ["user_id"], ["ts", "event_id"], "event_type", "from_state")
    t = t.select("from_state", F.col("event_type").alias("to_state")).where(F.col("from_state").isNotNull())
    n = t.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    tot = n.groupBy("from_state").agg(F.sum("n").alias("total"))
    return finish(n.join(tot, "from_state", "left").withColumn("probability", F.col("n") / F.col("total")), 6).withColumn(
        "total", F.col("total").cast("bigint")
    )


# J23 ---------------------------------------------------------------------------
@register(
    "J23",
    f"""WITH b AS (SELECT DISTINCT receipt_id, p_type AS item FROM {SQL_LINES} JOIN part ON product_id = p_partkey WHERE receipt_type = 'SALE'),
m AS (SELECT receipt_id FROM b GROUP BY 1 HAVING count(*) >= 2),
bm AS (SELECT b.* FROM b JOIN m USING (receipt_id)),
n AS (SELECT count(*) AS n FROM m),
s AS (SELECT item, count(*) AS cnt FROM bm GROUP BY 1)
SELECT item, cnt AS item_count, round(CAST(cnt AS DOUBLE) / (SELECT n FROM n), 6) AS support FROM s""",
)
def j23_item_support(spark, sf):
    """Support of each item over multi-item baskets (input of the lift join)."""
    from storelake.operators import basket

    b = _dept_baskets(spark, sf)
    return finish(basket.item_support(b, "receipt_id", "item"), 6)


def _dept_baskets(spark, sf):
    li = d.lines(spark, sf).where(F.col("receipt_type") == "SALE")
    p = d.products(spark, sf).select("product_id", F.col("department").alias("item"))
    return li.join(p, "product_id").select("receipt_id", "item")
