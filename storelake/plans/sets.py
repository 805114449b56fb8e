"""Set operations (U01–U07) and sort/top-k (T01–T04) on the driver tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from storelake.operators import aggs
from storelake.plans.common import SQL_LINES, SQL_RECEIPTS, finish, scalar
from storelake.plans.registry import register
from storelake.sources import driver as d


@register(
    "U01",
    f"""SELECT receipt_id, line_num, product_id, store_id, quantity, ext_cents, receipt_type FROM {SQL_LINES} WHERE receipt_type = 'SALE'
UNION ALL SELECT receipt_id, line_num, product_id, store_id, quantity, ext_cents, receipt_type FROM {SQL_LINES} WHERE receipt_type = 'RETURN'""",
)
def u01_union_by_name(spark, sf):
    """Sales lines UNION ALL return lines, matched by column name."""
    li = d.lines(spark, sf)
    cols = ["receipt_id", "line_num", "product_id", "store_id", "quantity", "ext_cents", "receipt_type"]
    sales = li.where(F.col("receipt_type") == "SALE").select(*cols)
    returns = li.where(F.col("receipt_type") == "RETURN").select(*reversed(cols))
    return sales.unionByName(returns)


@register(
    "U02",
    f"""SELECT receipt_id, event_ts, CAST(total_cents AS DOUBLE) AS total_cents, NULL::DOUBLE AS product_id FROM {SQL_RECEIPTS}
UNION ALL SELECT receipt_id, event_ts, NULL::DOUBLE AS total_cents, CAST(product_id AS DOUBLE) FROM {SQL_LINES}""",
)
def u02_union_missing_columns(spark, sf):
    """Headers and lines in one frame; columns missing on a side are NULL."""
    h = d.receipts(spark, sf).select("receipt_id", "event_ts", "total_cents")
    li = d.lines(spark, sf).select("receipt_id", "event_ts", "product_id")
    from storelake.plans.common import nullable_ids_as_double

    return nullable_ids_as_double(h.unionByName(li, allowMissingColumns=True), ("total_cents", "product_id"))


@register(
    "U03",
    """SELECT 'orders' AS source, o_orderdate AS ts FROM orders UNION ALL SELECT 'lineitem', l_shipdate FROM lineitem
UNION ALL SELECT 'events', ts FROM events""",
)
def u03_union_with_source(spark, sf):
    t = lambda n: d.table(spark, sf, n)
    return aggs.tagged_union(
        {"orders": t("orders").select(F.col("o_orderdate").alias("ts")), "lineitem": t("lineitem").select(F.col("l_shipdate").alias("ts")), "events": t("events").select("ts")},
        "ts",
    )


@register(
    "U04",
    f"""SELECT sha256(concat_ws('|', metric_type, entity_id, CAST(time_window AS VARCHAR))) AS alert_id, * FROM (
  SELECT 'high_value_receipt' AS metric_type, CAST(receipt_id AS VARCHAR) AS entity_id, event_ts AS time_window, CAST(total_cents AS DOUBLE) AS actual
    FROM {SQL_RECEIPTS} WHERE total_cents > 50000000
  UNION ALL SELECT 'error_burst', CAST(user_id AS VARCHAR), date_trunc('hour', ts), CAST(count(*) AS DOUBLE) FROM events WHERE event_type = 'error'
    GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) >= 2)""",
)
def u04_heterogeneous_alerts(spark, sf):
    """Two detectors with different shapes unioned into one alert schema with
    a deterministic sha256 alert id."""
    hv = d.receipts(spark, sf).where(F.col("total_cents") > 50_000_000).select(
        F.lit("high_value_receipt").alias("metric_type"), F.col("receipt_id").cast("string").alias("entity_id"), F.col("event_ts").alias("time_window"), F.col("total_cents").cast("double").alias("actual")
    )
    e = d.table(spark, sf, "events").where(F.col("event_type") == "error")
    burst = e.groupBy("user_id", aggs.bucket_ts("ts", "hour").alias("time_window")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select(
        F.lit("error_burst").alias("metric_type"), F.col("user_id").cast("string").alias("entity_id"), "time_window", F.col("n").cast("double").alias("actual")
    )
    u = hv.unionByName(burst)
    return u.select(F.sha2(F.concat_ws("|", "metric_type", "entity_id", F.col("time_window").cast("string")), 256).alias("alert_id"), "*")


@register("U05", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def u05_distinct(spark, sf):
    return d.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()


@register(
    "U06",
    """SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type) FILTER (WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 14 DAY))), ',') || '|' ||
  array_to_string(list_sort(list_distinct(list(event_type))), ',') AS type_sets FROM events GROUP BY 1""",
)
def u06_array_union(spark, sf):
    """Per user: the sorted set of event types seen in the table's first two
    weeks, and array_union of that set with all later types (set semantics)."""
    e = d.table(spark, sf, "events")
    first = scalar(e, F.min("ts"))
    early_end = F.lit(first + timedelta(days=14) if first else None).cast("timestamp_ntz")
    g = e.groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("ts") < early_end, F.col("event_type")))).alias("early"),
        F.array_sort(F.collect_set("event_type")).alias("all_types"),
    )
    return g.select("user_id", F.concat_ws("|", F.array_join("early", ","), F.array_join(F.array_sort(F.array_union("early", "all_types")), ",")).alias("type_sets"))


@register("U07", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u07_key_difference(spark, sf):
    """Customers without orders: difference of key sets via left_anti."""
    o = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return d.table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@register(
    "T01",
    f"""SELECT customer_id, CAST(sum(total_cents) AS BIGINT) AS spend_cents FROM {SQL_RECEIPTS} GROUP BY 1 ORDER BY spend_cents DESC, customer_id LIMIT 10""",
)
def t01_top_n(spark, sf):
    """Top 10 customers by spend; key tiebreak; TakeOrderedAndProject."""
    r = d.receipts(spark, sf).groupBy("customer_id").agg(F.sum("total_cents").alias("spend_cents"))
    return r.orderBy(F.desc("spend_cents"), "customer_id").limit(10)


@register(
    "T02",
    f"""SELECT store_id, date_trunc('minute', event_ts) AS ts, CAST(sum(total_cents) AS DOUBLE) / 100 AS total_sales FROM {SQL_RECEIPTS.replace('FROM orders', 'FROM orders')} r
JOIN (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS store_id FROM customer) c ON r.customer_id = c.c_custkey GROUP BY ALL""",
)
def t02_full_order(spark, sf):
    """Display order: newest minute first, then store (a range-partitioned
    sort; the order itself is not part of the value check)."""
    r = d.receipts(spark, sf, with_store=True)
    a = r.groupBy("store_id", aggs.bucket_ts("event_ts", "minute").alias("ts")).agg((F.sum("total_cents") / 100).alias("total_sales"))
    return a.orderBy(F.desc("ts"), "store_id")


@register(
    "T03",
    """SELECT * FROM (SELECT antecedent, consequent, round(lift, 6) AS lift FROM (
  WITH b AS (SELECT DISTINCT l_orderkey AS receipt_id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'),
  m AS (SELECT receipt_id FROM b GROUP BY 1 HAVING count(*) >= 2), bm AS (SELECT b.* FROM b JOIN m USING (receipt_id)),
  nb AS (SELECT count(*) AS n FROM m), cnt AS (SELECT item, count(*) AS n_item FROM bm GROUP BY 1),
  pc AS (SELECT a.item AS antecedent, c.item AS consequent, count(*) AS n_pair FROM bm a JOIN bm c ON a.receipt_id = c.receipt_id AND a.item <> c.item GROUP BY ALL)
  SELECT antecedent, consequent, (CAST(n_pair AS DOUBLE) / ca.n_item) / (CAST(cc.n_item AS DOUBLE) / (SELECT n FROM nb)) AS lift
  FROM pc JOIN cnt ca ON pc.antecedent = ca.item JOIN cnt cc ON pc.consequent = cc.item
  WHERE CAST(n_pair AS DOUBLE) / (SELECT n FROM nb) >= 0.01 AND CAST(n_pair AS DOUBLE) / ca.n_item >= 0.05))
ORDER BY lift DESC, antecedent, consequent LIMIT 10""",
)
def t03_top_rules(spark, sf):
    from storelake.plans.analytics import pair_rules

    r = pair_rules(spark, sf).select("antecedent", "consequent", "lift")
    return finish(r, 6).orderBy(F.desc("lift"), "antecedent", "consequent").limit(10)


def _sql_t04() -> str:
    from storelake.plans.analytics import _M02_SRC, _sql_anomaly

    return _sql_anomaly(_M02_SRC)


@register("T04", _sql_t04())
def t04_severity_order(spark, sf):
    """Alerts ordered by severity rank, |score| desc, time (not by the
    severity text, G08)."""
    from storelake.plans.analytics import m02_velocity

    a = m02_velocity(spark, sf)
    return a.orderBy("severity_rank", F.desc(F.abs("score")), "hour", "entity_id")
