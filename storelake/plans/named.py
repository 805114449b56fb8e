"""Named queries (§2.10): querysets Q01–Q13, rules AL01–AL05, dashboard tiles
DR01–DR10 / DP01–DP12 and guide queries PJ01–PJ06.

``ago(w)`` is re-anchored to the data: as_of = max(ts) of the table read (one
scalar), so the lookback filter is a literal that reaches the parquet scan.
Every top-k carries a key tiebreak.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from storelake.operators import aggs, joins, windows
from storelake.plans.common import SQL_EVENTS, SQL_LINES, SQL_RECEIPTS, SQL_RECEIPTS_STORE, finish, nullable_ids_as_double, scalar
from storelake.plans.gold import SQL_LIFECYCLES, SQL_MARKETING, SQL_ORDER_TOTALS, SQL_SENSORS, lifecycles, order_totals
from storelake.plans.registry import register
from storelake.plans.windows import _SQL_BALANCES, Tail, balances
from storelake.sources import driver as d


def recent(df, ts: str, seconds: int):
    """Rows with ts > max(ts) - seconds (the data-anchored ``ago``)."""
    m = scalar(df, F.max(ts))
    if m is None:
        return df
    return df.where(F.col(ts) > F.lit(m - timedelta(seconds=seconds)))


def recent_minutes(df, ts: str, seconds: int):
    """Rows whose minute is later than the latest minute - seconds: a bound on the raw
    column, so it reaches the scan, equal to filtering the truncated minute."""
    m = scalar(df, F.max(ts))
    if m is None:
        return df
    first = m.replace(second=0, microsecond=0) - timedelta(seconds=seconds) + timedelta(minutes=1)
    return df.where(F.col(ts) >= F.lit(first))


def _ago(table_sql: str, ts: str, seconds: int) -> str:
    return f"{ts} > (SELECT max({ts}) FROM {table_sql}) - INTERVAL {seconds} SECOND"


# Q01 ---------------------------------------------------------------------------
@register(
    "Q01",
    f"""SELECT store_id, count(DISTINCT device_id) AS devices FROM {SQL_SENSORS} s
WHERE {_ago(SQL_SENSORS, 'event_ts', 1800)} GROUP BY 1""",
)
def q01_ble_presence(spark, sf):
    s = recent(d.sensors(spark, sf), "event_ts", 1800)
    return s.groupBy("store_id").agg(F.count_distinct("device_id").alias("devices"))


def _funnel(spark, sf, seconds):
    e = recent(d.events(spark, sf), "ts", seconds)
    i = e.where(F.col("event_type") == "view").groupBy(F.col("k").alias("campaign_id")).agg(F.count(F.lit(1)).alias("impressions"))
    c = e.where(F.col("event_type") == "purchase").groupBy(F.col("k").alias("campaign_id")).agg(
        F.count(F.lit(1)).alias("conversions"), F.sum(d.cents("value")).alias("revenue_cents")
    )
    out = i.join(c, "campaign_id", "left").fillna({"conversions": 0, "revenue_cents": 0})
    return out.withColumn("conversion_rate", F.col("conversions") / F.col("impressions"))


# Q02 ---------------------------------------------------------------------------
@register(
    "Q02",
    f"""WITH e AS (SELECT * FROM {SQL_EVENTS} WHERE {_ago('events', 'ts', 86400)}),
i AS (SELECT k AS campaign_id, count(*) AS impressions FROM e WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT k AS campaign_id, count(*) AS conversions, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS revenue_cents FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT i.campaign_id, i.impressions, coalesce(conversions, 0) AS conversions, coalesce(revenue_cents, 0) AS revenue_cents,
  CAST(coalesce(conversions, 0) AS DOUBLE) / i.impressions AS conversion_rate FROM i LEFT JOIN c ON i.campaign_id = c.campaign_id""",
)
def q02_campaign_funnel(spark, sf):
    return _funnel(spark, sf, 86400)


def _fulfilment(spark, sf, seconds):
    o = recent(d.table(spark, sf, "orders"), "o_orderdate", seconds)
    return o.agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("created"),
        F.count_if(F.col("o_orderstatus") == "P").alias("picked"),
        F.count_if(F.col("o_orderstatus") == "F").alias("shipped"),
    )


_SQL_FULFIL = f"""SELECT CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS created, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS picked,
  CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS shipped FROM orders WHERE {_ago('orders', 'o_orderdate', 86400)}"""


# Q03 ---------------------------------------------------------------------------
@register("Q03", _SQL_FULFIL)
def q03_fulfilment_pipeline(spark, sf):
    return _fulfilment(spark, sf, 86400)


def _mkt(spark, sf, seconds):
    m = recent(d.marketing(spark, sf), "event_ts", seconds)
    return m.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("impressions"), F.sum("cost_cents").alias("cost_cents"))


_SQL_MKT = f"""SELECT campaign_id, count(*) AS impressions, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM {SQL_MARKETING} m
WHERE {_ago(SQL_MARKETING, 'event_ts', 86400)} GROUP BY 1"""


# Q04 ---------------------------------------------------------------------------
@register("Q04", _SQL_MKT)
def q04_marketing_cost(spark, sf):
    return _mkt(spark, sf, 86400)


def _online(spark, sf, seconds):
    t = order_totals(spark, sf, seconds)
    g = t.agg(F.count(F.lit(1)).alias("orders"), F.sum("subtotal_cents").alias("subtotal_cents"), F.sum("tax_cents").alias("tax_cents"), F.sum("total_cents").alias("total_cents"))
    return g.withColumn("aov", F.try_divide(F.col("total_cents") / 100, F.col("orders")))


_SQL_ONLINE = f"""SELECT count(*) AS orders, CAST(sum(subtotal_cents) AS BIGINT) AS subtotal_cents, CAST(sum(tax_cents) AS BIGINT) AS tax_cents,
  CAST(sum(total_cents) AS BIGINT) AS total_cents, CAST(sum(total_cents) AS DOUBLE) / 100 / count(*) AS aov
FROM {SQL_ORDER_TOTALS} t WHERE {_ago(SQL_ORDER_TOTALS, 'event_ts', 900)}"""


# Q05 ---------------------------------------------------------------------------
@register("Q05", _SQL_ONLINE)
def q05_online_orders(spark, sf):
    return _online(spark, sf, 900)


def _store_minutes(spark, sf, seconds):
    r = recent_minutes(d.receipts(spark, sf, with_store=True), "event_ts", seconds)
    return aggs.sales_by_time(r, ["store_id"], "event_ts", "total_cents", "minute")


# Q06 ---------------------------------------------------------------------------
@register(
    "Q06",
    f"""WITH m AS (SELECT store_id, date_trunc('minute', event_ts) AS ts, sum(total_cents) AS cents, count(*) AS receipts
  FROM {SQL_RECEIPTS_STORE} GROUP BY ALL)
SELECT store_id, ts, CAST(sum(cents) AS DOUBLE) / 100 AS total_sales, CAST(sum(receipts) AS BIGINT) AS receipts,
  CAST(sum(cents) AS DOUBLE) / 100 / sum(receipts) AS avg_basket FROM m WHERE {_ago('m', 'ts', 3600)} GROUP BY ALL""",
)
def q06_receipts_minute_by_store(spark, sf):
    """Re-aggregated minute buckets; basket = sum/sum."""
    r = recent_minutes(d.receipts(spark, sf, with_store=True), "event_ts", 3600)
    a = r.groupBy("store_id", aggs.bucket_ts("event_ts", "minute").alias("ts")).agg(F.sum("total_cents").alias("cents"), F.count(F.lit(1)).alias("receipts"))
    g = a.groupBy("store_id", "ts").agg(F.sum("cents").alias("cents"), F.sum("receipts").alias("receipts"))
    return g.select("store_id", "ts", (F.col("cents") / 100).alias("total_sales"), "receipts", (F.col("cents") / 100 / F.col("receipts")).alias("avg_basket"))


def stockouts(spark, sf, tail=None):
    from storelake.operators import windows

    return windows.threshold_crossings(balances(spark, sf, tail), ["store_id", "product_id"], "event_ts", "txn_id", "qty")


_SQL_STOCKOUTS = f"""(SELECT store_id, product_id, CAST(event_ts AS DATE) AS event_date, event_ts, txn_id, abs(qty) AS last_known_quantity, balance
FROM {_SQL_BALANCES} WHERE balance <= 0 AND balance - qty > 0
QUALIFY row_number() OVER (PARTITION BY store_id, product_id, CAST(event_ts AS DATE) ORDER BY event_ts, txn_id) = 1)"""


# Q07 ---------------------------------------------------------------------------
@register(
    "Q07",
    f"""SELECT store_id, product_id, last_known_quantity, event_ts AS last_event_ts FROM {_SQL_STOCKOUTS} s
WHERE {_ago(_SQL_STOCKOUTS, 'event_ts', 86400)}
QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY event_ts DESC, txn_id DESC) = 1""",
)
def q07_latest_stockouts(spark, sf):
    s = recent(stockouts(spark, sf), "event_ts", 86400)
    return aggs.latest_per_key(
        s.withColumn("last_event_ts", F.col("event_ts")), ["store_id", "product_id"], ["event_ts", "txn_id"], ["last_known_quantity", "last_event_ts"]
    )


def _tender(spark, sf, seconds):
    r = recent(d.receipts(spark, sf), "event_ts", seconds)
    return r.groupBy(F.col("tender_type").alias("payment_method")).agg(F.sum("total_cents").alias("amount_cents"))


_SQL_TENDER = f"""SELECT tender_type AS payment_method, CAST(sum(total_cents) AS BIGINT) AS amount_cents FROM {SQL_RECEIPTS} r
WHERE {_ago(SQL_RECEIPTS, 'event_ts', 900)} GROUP BY 1"""


# Q08 ---------------------------------------------------------------------------
@register("Q08", _SQL_TENDER)
def q08_tender_mix(spark, sf):
    return _tender(spark, sf, 900)


def _top_products(spark, sf, n, seconds=900):
    li = recent(d.lines(spark, sf), "event_ts", seconds)
    g = li.groupBy("product_id").agg(F.sum("ext_cents").alias("revenue_cents"), F.sum("quantity").alias("units"))
    return g.orderBy(F.desc("revenue_cents"), F.asc("product_id")).limit(n)


def _sql_top_products(n):
    return f"""SELECT product_id, CAST(sum(ext_cents) AS BIGINT) AS revenue_cents, CAST(sum(quantity) AS BIGINT) AS units FROM {SQL_LINES} l
WHERE {_ago(SQL_LINES, 'event_ts', 900)} GROUP BY 1 ORDER BY revenue_cents DESC, product_id LIMIT {n}"""


# Q09 ---------------------------------------------------------------------------
@register("Q09", _sql_top_products(25))
def q09_top_products(spark, sf):
    return _top_products(spark, sf, 25)


def _dwell_by_site(spark, sf, seconds):
    life = recent(lifecycles(spark, sf), "arrival_ts", seconds)
    return life.groupBy("site").agg(F.avg("dwell_minutes").alias("avg_dwell_min"), F.count(F.lit(1)).alias("trucks"))


_SQL_DWELL_SITE = f"""SELECT site, round(avg(dwell_minutes), 4) AS avg_dwell_min, count(*) AS trucks FROM {SQL_LIFECYCLES} l
WHERE {_ago(SQL_LIFECYCLES, 'arrival_ts', 86400)} GROUP BY 1"""


# Q10 ---------------------------------------------------------------------------
@register("Q10", _SQL_DWELL_SITE)
def q10_truck_dwell_by_site(spark, sf):
    return finish(_dwell_by_site(spark, sf, 86400), 4)


# Q11 ---------------------------------------------------------------------------
@register(
    "Q11",
    f"""WITH m AS (SELECT store_id, zone, date_trunc('minute', event_ts) AS ts, avg(dwell_seconds) AS avg_dwell, sum(dwell_seconds) AS dwell_total,
  count(*) AS customers FROM {SQL_SENSORS} GROUP BY ALL)
SELECT store_id, zone, round(avg(avg_dwell), 4) AS avg_dwell, round(sum(dwell_total) / sum(customers), 4) AS weighted_dwell,
  CAST(sum(customers) AS BIGINT) AS customers FROM m WHERE {_ago('m', 'ts', 1800)} GROUP BY ALL""",
)
def q11_zone_heatmap(spark, sf):
    """Zone heatmap over the last 30 minutes: the literal average of minute
    averages (G29) and the visit-weighted average."""
    m = aggs.zone_dwell(recent_minutes(d.sensors(spark, sf), "event_ts", 1800), "store_id", "zone", "event_ts", "dwell_seconds")
    g = m.groupBy("store_id", "zone").agg(
        F.avg("avg_dwell").alias("avg_dwell"), (F.sum("dwell_total") / F.sum("customers")).alias("weighted_dwell"), F.sum("customers").alias("customers")
    )
    return finish(g, 4)


# Q12 ---------------------------------------------------------------------------
@register(
    "Q12",
    f"""SELECT i.k AS campaign_id, count(*) AS attributed, count(DISTINCT c.event_id) AS conversions,
  CAST(sum(CAST(round(c.value * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
FROM {SQL_EVENTS} i JOIN {SQL_EVENTS} c ON c.user_id = i.user_id AND c.event_type = 'purchase'
  AND c.ts >= i.ts AND c.ts <= i.ts + INTERVAL 24 HOUR WHERE i.event_type = 'view' GROUP BY 1""",
)
def q12_attribution_window(spark, sf):
    """fn_attribution_window(campaign, 24 h) for every campaign at once."""
    from storelake.plans.joins import attribution

    a = attribution(spark, sf, 24)
    return a.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("attributed"), F.count_distinct("conversion_id").alias("conversions"), F.sum(d.cents("revenue")).alias("revenue_cents")
    )


# Q13 ---------------------------------------------------------------------------
@register(
    "Q13",
    f"""SELECT truck_id, CAST(dc_id AS DOUBLE) AS dc_id, CAST(store_id AS DOUBLE) AS store_id, shipment_id, site, arrival_ts, departure_ts,
  CAST(epoch_us(departure_ts) - epoch_us(arrival_ts) AS BIGINT) // 1000000 AS dwell_seconds, round(dwell_minutes, 4) AS dwell_minutes
FROM {SQL_LIFECYCLES}""",
)
def q13_truck_sla(spark, sf):
    life = lifecycles(spark, sf)
    out = life.withColumn(
        "dwell_seconds", F.floor((F.unix_micros(F.col("departure_ts").cast("timestamp")) - F.unix_micros(F.col("arrival_ts").cast("timestamp"))) / 1_000_000).cast("bigint")
    )
    out = out.select("truck_id", "dc_id", "store_id", "shipment_id", "site", "arrival_ts", "departure_ts", "dwell_seconds", "dwell_minutes")
    return finish(nullable_ids_as_double(out, ("dc_id", "store_id")), 4)


# AL01 --------------------------------------------------------------------------
@register(
    "AL01",
    f"""SELECT store_id, product_id, last_known_quantity, event_ts FROM {_SQL_STOCKOUTS} s WHERE {_ago(_SQL_STOCKOUTS, 'event_ts', 300)}""",
)
def al01_stockout_alert(spark, sf):
    return recent(stockouts(spark, sf), "event_ts", 300).select("store_id", "product_id", "last_known_quantity", "event_ts")


# AL02 --------------------------------------------------------------------------
@register(
    "AL02",
    None,
)
def al02_urgent_reorder(spark, sf):
    """URGENT reorder signals of the last 10 minutes (R06 signals)."""
    from storelake.plans.reaimed import reorder_signals

    r = reorder_signals(spark, sf)
    return recent(r, "event_ts", 600).where(F.col("priority") == "URGENT")


# AL03 --------------------------------------------------------------------------
@register(
    "AL03",
    f"""SELECT truck_id, CAST(dc_id AS DOUBLE) AS dc_id, CAST(store_id AS DOUBLE) AS store_id, shipment_id, site, round(dwell_minutes, 4) AS dwell_minutes
FROM {SQL_LIFECYCLES} l WHERE dwell_minutes > 90 AND {_ago(SQL_LIFECYCLES, 'arrival_ts', 300)}""",
)
def al03_truck_dwell_breach(spark, sf, lookback: int = 300):
    """Lifecycles that arrived in the last 5 minutes and dwelt over 90 minutes."""
    life = recent(lifecycles(spark, sf), "arrival_ts", lookback).where(F.col("dwell_minutes") > 90)
    return finish(nullable_ids_as_double(life.select("truck_id", "dc_id", "store_id", "shipment_id", "site", "dwell_minutes"), ("dc_id", "store_id")), 4)


# AL04 --------------------------------------------------------------------------
@register(
    "AL04",
    f"""SELECT store_id, zone, count(*) AS customers, round(avg(dwell_seconds), 4) AS avg_dwell
FROM {SQL_SENSORS} s WHERE {_ago(SQL_SENSORS, 'event_ts', 300)} GROUP BY ALL HAVING count(*) > 50 OR avg(dwell_seconds) > 600""",
)
def al04_zone_overcrowded(spark, sf, lookback: int = 300):
    """Zones with > 50 customers or average dwell > 600 s in the last 5 minutes."""
    return finish(overcrowded(recent(d.sensors(spark, sf), "event_ts", lookback)), 4)


def overcrowded(sensors):
    """The zones of a window of sensor rows that hold too many customers or hold them too long."""
    return crowded(sensors.groupBy("store_id", "zone").agg(F.count(F.lit(1)).alias("customers"), F.avg("dwell_seconds").alias("avg_dwell")))


def crowded(zones):
    """The zones over a limit, from their customers and average dwell."""
    return zones.where((F.col("customers") > 50) | (F.col("avg_dwell") > 600))


# AL05 --------------------------------------------------------------------------
@register("AL05", f"SELECT receipt_id, customer_id, event_ts, total_cents FROM {SQL_RECEIPTS} r WHERE total_cents > 20000 AND {_ago(SQL_RECEIPTS, 'event_ts', 300)}")
def al05_high_value_receipt(spark, sf, lookback: int = 300):
    """Receipts of the last 5 minutes above 200.00."""
    return recent(d.receipts(spark, sf), "event_ts", lookback).where(F.col("total_cents") > 20000).select("receipt_id", "customer_id", "event_ts", "total_cents")


# DR01 --------------------------------------------------------------------------
@register(
    "DR01",
    f"""WITH m AS (SELECT store_id, date_trunc('minute', event_ts) AS ts, total_cents FROM {SQL_RECEIPTS_STORE})
SELECT store_id, CAST(sum(total_cents) AS BIGINT) AS sales_cents FROM m WHERE {_ago('m', 'ts', 3600)}
GROUP BY 1 ORDER BY sales_cents DESC, store_id LIMIT 10""",
)
def dr01_top_stores(spark, sf):
    a = recent_minutes(d.receipts(spark, sf, with_store=True), "event_ts", 3600)
    return a.groupBy("store_id").agg(F.sum("total_cents").alias("sales_cents")).orderBy(F.desc("sales_cents"), "store_id").limit(10)


# DR02 --------------------------------------------------------------------------
@register("DR02", f"SELECT orders, aov, total_cents FROM ({_SQL_ONLINE})")
def dr02_online_tile(spark, sf):
    return _online(spark, sf, 900).select("orders", "aov", "total_cents")


# DR03 --------------------------------------------------------------------------
@register("DR03", _SQL_FULFIL)
def dr03_fulfilment_tile(spark, sf):
    return _fulfilment(spark, sf, 86400)


# DR04 --------------------------------------------------------------------------
@register(
    "DR04",
    f"""SELECT store_id, count(DISTINCT device_id) AS devices FROM {SQL_SENSORS} s WHERE {_ago(SQL_SENSORS, 'event_ts', 1800)}
GROUP BY 1 ORDER BY devices DESC, store_id LIMIT 10""",
)
def dr04_top_stores_devices(spark, sf):
    return q01_ble_presence(spark, sf).orderBy(F.desc("devices"), "store_id").limit(10)


# DR05 --------------------------------------------------------------------------
@register("DR05", _SQL_MKT + " ORDER BY cost_cents DESC, campaign_id LIMIT 10")
def dr05_top_campaigns(spark, sf):
    return _mkt(spark, sf, 86400).orderBy(F.desc("cost_cents"), "campaign_id").limit(10)


# DR06 --------------------------------------------------------------------------
@register("DR06", _SQL_TENDER)
def dr06_tender_tile(spark, sf):
    return _tender(spark, sf, 900)


# DR07 --------------------------------------------------------------------------
@register("DR07", _sql_top_products(10))
def dr07_top_products(spark, sf):
    return _top_products(spark, sf, 10)


# DR08 --------------------------------------------------------------------------
@register(
    "DR08",
    f"""SELECT store_id, count(*) AS stockouts FROM {_SQL_STOCKOUTS} s WHERE {_ago(_SQL_STOCKOUTS, 'event_ts', 86400)}
GROUP BY 1 ORDER BY stockouts DESC, store_id LIMIT 10""",
)
def dr08_stockouts_per_store(spark, sf, lookback: int = 86400):
    s = recent(stockouts(spark, sf), "event_ts", lookback)
    return s.groupBy("store_id").agg(F.count(F.lit(1)).alias("stockouts")).orderBy(F.desc("stockouts"), "store_id").limit(10)


# DR09 --------------------------------------------------------------------------
@register(
    "DR09",
    f"""SELECT zone, count(*) AS customers FROM {SQL_SENSORS} s WHERE {_ago(SQL_SENSORS, 'event_ts', 1800)}
GROUP BY 1 ORDER BY customers DESC, zone LIMIT 10""",
)
def dr09_customers_per_zone(spark, sf, lookback: int = 1800):
    s = recent(d.sensors(spark, sf), "event_ts", lookback)
    return s.groupBy("zone").agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), "zone").limit(10)


# DR10 --------------------------------------------------------------------------
@register("DR10", _SQL_DWELL_SITE + " ORDER BY avg_dwell_min DESC, site LIMIT 10")
def dr10_dwell_per_site(spark, sf):
    return finish(_dwell_by_site(spark, sf, 86400), 4).orderBy(F.desc("avg_dwell_min"), "site").limit(10)


# ----------------------------------------------------------------------------
# Pricing approval roles: signup = recommendation created, click = approved,
# error = rejected. A decision belongs to the user's latest recommendation
# at or before it (an as-of lookup done with a window over the union).
# ----------------------------------------------------------------------------
_CHANGE = "(k - 50) / 250.0"


def recommendations(spark, sf):
    e = d.events(spark, sf).where(F.col("event_type") == "signup")
    c = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("department"))
    cur = d.cents("value")
    rec = F.round(F.col("value") * 100 * (1 + (F.col("k") - 50) / 250.0)).cast("bigint")
    return e.join(c, "user_id", "left").select(
        F.col("event_id").alias("recommendation_id"),
        F.col("user_id").alias("product_id"),
        F.coalesce("department", F.lit("UNKNOWN")).alias("department"),
        F.col("ts").alias("created_ts"),
        cur.alias("current_cents"),
        rec.alias("recommended_cents"),
        ((rec - cur) * 10).alias("impact_cents"),
        (F.col("k") / 100.0).alias("ml_confidence"),
        F.when(rec < cur * 0.85, F.lit("MARGIN_WARNING")).otherwise(F.lit("ALL_PASS")).alias("constraint_status"),
    )


_SQL_RECS = f"""(SELECT event_id AS recommendation_id, user_id AS product_id, coalesce(c_mktsegment, 'UNKNOWN') AS department, ts AS created_ts,
  CAST(round(value * 100) AS BIGINT) AS current_cents, CAST(round(value * 100 * (1 + (k - 50) / 250.0)) AS BIGINT) AS recommended_cents,
  (CAST(round(value * 100 * (1 + (k - 50) / 250.0)) AS BIGINT) - CAST(round(value * 100) AS BIGINT)) * 10 AS impact_cents,
  k / 100.0 AS ml_confidence,
  CASE WHEN CAST(round(value * 100 * (1 + (k - 50) / 250.0)) AS BIGINT) < CAST(round(value * 100) AS BIGINT) * 0.85 THEN 'MARGIN_WARNING' ELSE 'ALL_PASS' END AS constraint_status
FROM {SQL_EVENTS} e LEFT JOIN customer ON e.user_id = c_custkey WHERE event_type = 'signup')"""


def decisions(spark, sf):
    """click/error events linked to the user's latest signup at or before them."""
    e = d.events(spark, sf).where(F.col("event_type").isin("signup", "click", "error"))
    signup = F.col("event_type") == "signup"
    order = ["ts", F.when(signup, 0).otherwise(1), "event_id"]
    x = windows.last_at_or_before(e, ["user_id"], order, F.when(signup, F.col("event_id")), "recommendation_id", "ts")
    x = x.where(F.col("event_type") != "signup").where(F.col("recommendation_id").isNotNull())
    return x.select(
        F.col("event_id").alias("decision_id"),
        "recommendation_id",
        F.col("user_id").alias("product_id"),
        F.col("ts").alias("decided_ts"),
        F.when(F.col("event_type") == "click", F.lit("approved")).otherwise(F.lit("rejected")).alias("action"),
        F.concat(F.lit("APPROVER_"), (F.col("k") % 7).cast("string")).alias("approver_id"),
        F.when(F.col("value") < 5, F.lit("MARGIN_TOO_LOW")).when(F.col("value") < 20, F.lit("COMPETITOR_PRICE")).otherwise(F.lit("OTHER")).alias("rejection_reason"),
    )


_SQL_DECISIONS = f"""(SELECT x.event_id AS decision_id, r.event_id AS recommendation_id, x.user_id AS product_id, x.ts AS decided_ts,
  CASE WHEN x.event_type = 'click' THEN 'approved' ELSE 'rejected' END AS action,
  'APPROVER_' || CAST(x.k % 7 AS VARCHAR) AS approver_id,
  CASE WHEN x.value < 5 THEN 'MARGIN_TOO_LOW' WHEN x.value < 20 THEN 'COMPETITOR_PRICE' ELSE 'OTHER' END AS rejection_reason
FROM (SELECT * FROM {SQL_EVENTS} WHERE event_type IN ('click', 'error')) x
ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON x.user_id = r.user_id AND x.ts >= r.ts)"""

_SQL_PENDING = f"""(SELECT * FROM {_SQL_RECS} r WHERE NOT EXISTS (SELECT 1 FROM {_SQL_DECISIONS} x WHERE x.recommendation_id = r.recommendation_id))"""


def pending(spark, sf):
    """Pending = created anti-join decided."""
    return recommendations(spark, sf).join(decisions(spark, sf).select("recommendation_id"), "recommendation_id", "left_anti")


# DP01 --------------------------------------------------------------------------
@register(
    "DP01",
    f"""SELECT count(*) AS recommendations, CAST(sum(impact_cents) AS BIGINT) AS total_impact_cents,
  round(avg(ml_confidence) * 100, 1) AS avg_confidence_pct FROM {_SQL_PENDING}""",
)
def dp01_pending_summary(spark, sf):
    p = pending(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("recommendations"), F.sum("impact_cents").alias("total_impact_cents"), F.round(F.avg("ml_confidence") * 100, 1).alias("avg_confidence_pct"))


# DP02 --------------------------------------------------------------------------
@register(
    "DP02",
    f"""SELECT department, count(*) AS recommendations, CAST(sum(impact_cents) AS BIGINT) AS total_impact_cents FROM {_SQL_PENDING}
GROUP BY 1 ORDER BY recommendations DESC, department LIMIT 10""",
)
def dp02_pending_by_department(spark, sf):
    p = pending(spark, sf)
    g = p.groupBy("department").agg(F.count(F.lit(1)).alias("recommendations"), F.sum("impact_cents").alias("total_impact_cents"))
    return g.orderBy(F.desc("recommendations"), "department").limit(10)


# DP03 --------------------------------------------------------------------------
@register(
    "DP03",
    f"""SELECT recommendation_id, product_id, current_cents, recommended_cents, impact_cents, ml_confidence, constraint_status FROM {_SQL_PENDING}
ORDER BY impact_cents DESC, recommendation_id LIMIT 20""",
)
def dp03_top_pending(spark, sf):
    p = pending(spark, sf).select("recommendation_id", "product_id", "current_cents", "recommended_cents", "impact_cents", "ml_confidence", "constraint_status")
    return p.orderBy(F.desc("impact_cents"), "recommendation_id").limit(20)


def change_pct(before, after):
    """Change in percent of ``before``. From a price of 0 it is infinite by the sign of the change, NaN without
    one (IEEE division, as in the SQL), where ``/`` is an error under ANSI."""
    change = (after - before).cast("double")
    return F.when(before == 0, F.signum(change) * F.lit(float("inf"))).otherwise(F.try_divide(change, before) * 100)


def change_bucket(pct):
    """The dashboard's price-change buckets (percent)."""
    return (
        F.when(pct < -20, F.lit("Large Markdown (>20%)"))
        .when(pct < -10, F.lit("Moderate Markdown (10-20%)"))
        .when(pct < -5, F.lit("Small Markdown (5-10%)"))
        .when(pct < 5, F.lit("Minimal Change (<5%)"))
        .when(pct < 10, F.lit("Small Increase (5-10%)"))
        .otherwise(F.lit("Large Increase (>10%)"))
    )


def confidence_bucket(c, long_names=True):
    """The dashboard's confidence buckets."""
    names = ("Very High (>=90%)", "High (70-90%)", "Medium (50-70%)", "Low (<50%)") if long_names else ("Very High", "High", "Medium", "Low")
    return F.when(c >= 0.9, F.lit(names[0])).when(c >= 0.7, F.lit(names[1])).when(c >= 0.5, F.lit(names[2])).otherwise(F.lit(names[3]))


# DP04 --------------------------------------------------------------------------
@register(
    "DP04",
    f"""SELECT CASE WHEN pct < -20 THEN 'Large Markdown (>20%)' WHEN pct < -10 THEN 'Moderate Markdown (10-20%)' WHEN pct < -5 THEN 'Small Markdown (5-10%)'
  WHEN pct < 5 THEN 'Minimal Change (<5%)' WHEN pct < 10 THEN 'Small Increase (5-10%)' ELSE 'Large Increase (>10%)' END AS change_bucket, count(*) AS recommendations
FROM (SELECT round(CAST(recommended_cents - current_cents AS DOUBLE) / current_cents * 100, 1) AS pct FROM {_SQL_PENDING}) GROUP BY 1""",
)
def dp04_price_change_buckets(spark, sf):
    p = pending(spark, sf).withColumn("pct", F.round(change_pct(F.col("current_cents"), F.col("recommended_cents")), 1))
    return p.groupBy(change_bucket(F.col("pct")).alias("change_bucket")).agg(F.count(F.lit(1)).alias("recommendations"))


# DP05 --------------------------------------------------------------------------
@register(
    "DP05",
    f"""SELECT CASE WHEN ml_confidence >= 0.9 THEN 'Very High (>=90%)' WHEN ml_confidence >= 0.7 THEN 'High (70-90%)' WHEN ml_confidence >= 0.5 THEN 'Medium (50-70%)'
  ELSE 'Low (<50%)' END AS confidence_bucket, count(*) AS recommendations, round(avg(impact_cents), 4) AS avg_impact_cents FROM {_SQL_PENDING} GROUP BY 1""",
)
def dp05_confidence_buckets(spark, sf):
    p = pending(spark, sf)
    g = p.groupBy(confidence_bucket(F.col("ml_confidence")).alias("confidence_bucket")).agg(
        F.count(F.lit(1)).alias("recommendations"), F.avg("impact_cents").alias("avg_impact_cents")
    )
    return finish(g, 4)


# DP06 --------------------------------------------------------------------------
@register(
    "DP06",
    f"""SELECT constraint_status <> 'ALL_PASS' AS has_violations, count(*) AS recommendations,
  CASE WHEN constraint_status <> 'ALL_PASS' THEN 'Has Constraint Warnings' ELSE 'All Constraints Pass' END AS status_label FROM {_SQL_PENDING} GROUP BY ALL""",
)
def dp06_constraint_compliance(spark, sf):
    p = pending(spark, sf).withColumn("has_violations", F.col("constraint_status") != "ALL_PASS")
    g = p.groupBy("has_violations").agg(F.count(F.lit(1)).alias("recommendations"))
    return g.withColumn("status_label", F.when(F.col("has_violations"), F.lit("Has Constraint Warnings")).otherwise(F.lit("All Constraints Pass")))


# DP07 --------------------------------------------------------------------------
@register(
    "DP07",
    f"""SELECT action, date_trunc('hour', decided_ts) AS hour, count(*) AS decisions FROM {_SQL_DECISIONS} x
WHERE {_ago(_SQL_DECISIONS, 'decided_ts', 86400)} GROUP BY ALL""",
)
def dp07_decisions_per_hour(spark, sf):
    x = recent(decisions(spark, sf), "decided_ts", 86400)
    return x.groupBy("action", aggs.bucket_ts("decided_ts", "hour").alias("hour")).agg(F.count(F.lit(1)).alias("decisions"))


# DP08 --------------------------------------------------------------------------
@register(
    "DP08",
    f"""SELECT CASE WHEN ml_confidence >= 0.9 THEN 'Very High' WHEN ml_confidence >= 0.7 THEN 'High' WHEN ml_confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_bucket,
  count(*) AS total, CAST(count_if(action = 'approved') AS BIGINT) AS approved,
  round(CAST(count_if(action = 'approved') AS DOUBLE) / count(*) * 100, 1) AS approval_rate_pct
FROM (SELECT * FROM {_SQL_DECISIONS} x WHERE {_ago(_SQL_DECISIONS, 'decided_ts', 7 * 86400)}) x JOIN {_SQL_RECS} r USING (recommendation_id) GROUP BY 1""",
)
def dp08_approval_rate(spark, sf):
    x = recent(decisions(spark, sf), "decided_ts", 7 * 86400)
    j = x.join(recommendations(spark, sf).select("recommendation_id", "ml_confidence"), "recommendation_id", "inner")
    g = j.groupBy(confidence_bucket(F.col("ml_confidence"), False).alias("confidence_bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "approved").alias("approved")
    )
    return g.withColumn("approval_rate_pct", F.round(F.col("approved") / F.col("total") * 100, 1))


# DP09 --------------------------------------------------------------------------
@register(
    "DP09",
    f"""SELECT CAST(decided_ts AS DATE) AS day, CAST(sum(impact_cents) AS BIGINT) AS total_impact_cents
FROM (SELECT DISTINCT recommendation_id, CAST(decided_ts AS DATE) AS decided_ts FROM {_SQL_DECISIONS} x
      WHERE action = 'approved' AND {_ago(_SQL_DECISIONS, 'decided_ts', 7 * 86400)}) x
JOIN {_SQL_RECS} r USING (recommendation_id) GROUP BY 1""",
)
def dp09_realised_impact(spark, sf):
    """Approved impact per day, summed once per recommendation."""
    x = recent(decisions(spark, sf), "decided_ts", 7 * 86400).where(F.col("action") == "approved")
    x = x.select("recommendation_id", F.to_date("decided_ts").alias("day")).distinct()
    j = x.join(recommendations(spark, sf).select("recommendation_id", "impact_cents"), "recommendation_id")
    return j.groupBy("day").agg(F.sum("impact_cents").alias("total_impact_cents"))


# DP10 --------------------------------------------------------------------------
@register(
    "DP10",
    f"""SELECT approver_id, action, count(*) AS decisions FROM {_SQL_DECISIONS} x WHERE {_ago(_SQL_DECISIONS, 'decided_ts', 7 * 86400)}
GROUP BY ALL ORDER BY decisions DESC, approver_id, action LIMIT 10""",
)
def dp10_top_approvers(spark, sf):
    x = recent(decisions(spark, sf), "decided_ts", 7 * 86400)
    return x.groupBy("approver_id", "action").agg(F.count(F.lit(1)).alias("decisions")).orderBy(F.desc("decisions"), "approver_id", "action").limit(10)


# DP11 --------------------------------------------------------------------------
@register(
    "DP11",
    f"""SELECT round(avg(m), 4) AS avg_decision_time_min, round(quantile_cont(m, 0.5), 4) AS median_decision_time_min FROM (
  SELECT CAST(date_diff('minute', r.created_ts, x.decided_ts) AS BIGINT) AS m FROM (SELECT * FROM {_SQL_DECISIONS} x WHERE {_ago(_SQL_DECISIONS, 'decided_ts', 86400)}) x
  JOIN {_SQL_RECS} r USING (recommendation_id))""",
)
def dp11_decision_time(spark, sf):
    x = recent(decisions(spark, sf), "decided_ts", 86400)
    j = x.join(recommendations(spark, sf).select("recommendation_id", "created_ts"), "recommendation_id")
    # minute boundaries crossed (datetime_diff semantics), not elapsed whole minutes
    minute_no = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 60_000_000)
    j = j.withColumn("m", (minute_no("decided_ts") - minute_no("created_ts")).cast("bigint"))
    median = aggs.exact_percentiles(j, [], {"median_decision_time_min": ("m", 0.5)}).withColumn("_k", F.lit(1))
    mean = j.agg(F.avg("m").alias("avg_decision_time_min")).withColumn("_k", F.lit(1))
    return finish(mean.join(median, "_k", "left").drop("_k"), 4)


# DP12 --------------------------------------------------------------------------
@register(
    "DP12",
    f"""SELECT rejection_reason, count(*) AS rejections FROM {_SQL_DECISIONS} x WHERE action = 'rejected' AND {_ago(_SQL_DECISIONS, 'decided_ts', 7 * 86400)}
GROUP BY 1 ORDER BY rejections DESC, rejection_reason LIMIT 10""",
)
def dp12_rejection_reasons(spark, sf):
    x = recent(decisions(spark, sf), "decided_ts", 7 * 86400).where(F.col("action") == "rejected")
    return x.groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("rejections")).orderBy(F.desc("rejections"), "rejection_reason").limit(10)


# PJ01 --------------------------------------------------------------------------
@register("PJ01", f"SELECT event_type AS source, count(*) AS rows, max(ts) AS latest FROM events WHERE {_ago('events', 'ts', 600)} GROUP BY 1")
def pj01_readiness(spark, sf, lookback: int = 600):
    """Rows and latest timestamp of the last 10 minutes per live event table (one per event type)."""
    e = recent(d.table(spark, sf, "events"), "ts", lookback)
    return e.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("latest"))


# PJ02 --------------------------------------------------------------------------
@register(
    "PJ02",
    f"""SELECT CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'P' THEN 'picked' ELSE 'shipped' END AS source, count(*) AS events
FROM orders WHERE {_ago('orders', 'o_orderdate', 86400)} GROUP BY 1""",
)
def pj02_events_per_stage(spark, sf):
    o = recent(d.table(spark, sf, "orders"), "o_orderdate", 86400)
    u = aggs.tagged_union(
        {"created": o.where(F.col("o_orderstatus") == "O"), "picked": o.where(F.col("o_orderstatus") == "P"), "shipped": o.where(F.col("o_orderstatus") == "F")},
        "o_orderdate",
    )
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("events"))


# PJ03 --------------------------------------------------------------------------
@register(
    "PJ03",
    f"""SELECT store_id, product_id, reason, count(*) AS movements, CAST(sum(qty) AS BIGINT) AS net_delta, max(event_ts) AS latest
FROM (SELECT l_suppkey AS store_id, l_partkey AS product_id, l_returnflag AS reason, l_shipdate AS event_ts,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS qty FROM lineitem)
WHERE {_ago('(SELECT l_shipdate AS event_ts FROM lineitem)', 'event_ts', 1800)}
GROUP BY ALL ORDER BY latest DESC, store_id, product_id, reason LIMIT 25""",
)
def pj03_inventory_movement(spark, sf, lookback: int = 1800):
    """Movements of the last 30 minutes per store, product and reason; the 25 latest."""
    g = recent(d.ledger(spark, sf), "event_ts", lookback).groupBy("store_id", "product_id", "reason").agg(
        F.count(F.lit(1)).alias("movements"), F.sum("qty").alias("net_delta"), F.max("event_ts").alias("latest")
    )
    return g.orderBy(F.desc("latest"), "store_id", "product_id", "reason").limit(25)


# PJ04 --------------------------------------------------------------------------
def _signals(spark, sf, tail=None):
    from storelake.operators import ml
    from storelake.plans.reaimed import reorder_signals

    r = reorder_signals(spark, sf, tail=tail).select("store_id", "product_id", "event_ts")
    s = stockouts(spark, sf, tail).select("store_id", "product_id", "event_ts")
    return ml.staged(r.withColumn("signal", F.lit("reorder")).unionByName(s.withColumn("signal", F.lit("stockout"))), "signals")


def latest_signals(spark, sf, seconds: int):
    """Reorder and stockout signals, at least all of the last ``seconds`` before the latest one. A day's signals
    follow from its movements and the balances it opens with, so the days before the last one with signals are
    summed, not ranked and balanced; whether the days taken reach back far enough is known from their signals."""
    first, last = d.ledger(spark, sf).agg(F.to_date(F.min("event_ts")), F.to_date(F.max("event_ts"))).first()
    days = 1
    while last is not None and (since := last - timedelta(days=days)) > first:
        u = _signals(spark, sf, Tail(spark, sf, since))
        reach = scalar(u, F.to_date(F.max("event_ts") - F.make_dt_interval(secs=F.lit(seconds))))
        if reach is not None and reach >= since:
            return u
        days *= 8
    return _signals(spark, sf)


@register("PJ04", None)
def pj04_replenishment_signals(spark, sf, lookback: int = 1800):
    """Reorder and stockout signals of the last 30 minutes by type/store/product, the 25 latest."""
    u = recent(latest_signals(spark, sf, lookback), "event_ts", lookback)
    g = u.groupBy("signal", "store_id", "product_id").agg(F.count(F.lit(1)).alias("signals"), F.max("event_ts").alias("latest"))
    return g.orderBy(F.desc("latest"), "signal", "store_id", "product_id").limit(25)


# PJ05 --------------------------------------------------------------------------
@register(
    "PJ05",
    f"""SELECT count(*) AS lifecycles, max(departure_ts) AS latest, CAST(count_if(dwell_minutes > 90) AS BIGINT) AS breaches FROM {SQL_LIFECYCLES} l
WHERE {_ago(SQL_LIFECYCLES, 'arrival_ts', 1800)}""",
)
def pj05_truck_readiness(spark, sf, lookback: int = 1800):
    """Lifecycles that arrived in the last 30 minutes: rows, latest departure, SLA breaches."""
    life = recent(lifecycles(spark, sf), "arrival_ts", lookback)
    return life.agg(F.count(F.lit(1)).alias("lifecycles"), F.max("departure_ts").alias("latest"), F.count_if(F.col("dwell_minutes") > 90).alias("breaches"))


# PJ06 --------------------------------------------------------------------------
@register(
    "PJ06",
    f"""WITH m AS (SELECT store_id, date_trunc('minute', event_ts) AS ts, CAST(sum(total_cents) AS DOUBLE) / 100 AS total_sales, count(*) AS receipts
  FROM {SQL_RECEIPTS_STORE} GROUP BY ALL)
SELECT * FROM m WHERE {_ago('m', 'ts', 3600)}""",
)
def pj06_recent_minutes(spark, sf, lookback: int = 3600):
    """Minute buckets of the last hour per store."""
    r = recent_minutes(d.receipts(spark, sf, with_store=True), "event_ts", lookback)
    return aggs.sales_by_time(r, ["store_id"], "event_ts", "total_cents", "minute").drop("avg_basket")
