"""Window operators (W01–W20), densify (R01) and the calendar (X03) on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storelake.functions import calendar
from storelake.functions.hashing import md5_unit_sql
from storelake.operators import aggs, windows
from storelake.plans.common import SQL_DAILY_DEPT, SQL_DENSE_DEPT, SQL_LEDGER, SQL_LINES, finish
from storelake.plans.registry import register
from storelake.sources import driver as d

SESSION_GAP_S = 12 * 3600  # events are hours apart per user (SURVEY §7.2)


# W01 ---------------------------------------------------------------------------
@register(
    "W01",
    f"""SELECT store_id, product_id, event_ts, txn_id, qty, reason FROM {SQL_LEDGER}
QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY event_ts DESC, txn_id DESC) = 1""",
)
def w01_latest_row(spark, sf):
    return windows.latest_row(d.ledger(spark, sf), ["store_id", "product_id"], ["event_ts", "txn_id"])


# W02 ---------------------------------------------------------------------------
@register(
    "W02",
    """SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate ASC NULLS LAST, l_partkey, l_suppkey) = 1""",
)
def w02_dedupe_earliest(spark, sf):
    """Dedupe by business key (order, line number) keeping the earliest."""
    li = d.table(spark, sf, "lineitem")
    return windows.dedupe_earliest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


_SQL_SESSIONS = f"""(SELECT user_id, event_id, ts, event_type, value, prev_ts, is_new,
  CAST(sum(CAST(is_new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
FROM (SELECT *, prev_ts IS NULL OR epoch_us(ts) - epoch_us(prev_ts) > {SESSION_GAP_S * 1_000_000} AS is_new FROM (
  SELECT user_id, event_id, ts, event_type, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts FROM events)))"""


def sessions(spark, sf):
    e = d.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return windows.sessionize(e, ["user_id"], "ts", "event_id", SESSION_GAP_S, bucket=F.to_date("ts"))


# W03 ---------------------------------------------------------------------------
@register("W03", f"SELECT * FROM {_SQL_SESSIONS}")
def w03_sessionize(spark, sf):
    """Sessions per device (user): gap > 12 h opens a new one. Segmented by day."""
    return sessions(spark, sf).withColumn("session_no", F.col("session_no").cast("bigint"))


# W04 ---------------------------------------------------------------------------
@register(
    "W04",
    f"""SELECT store_id, promo_code, episode_no, min(d) AS start_date, max(d) AS end_date, count(*) AS active_days FROM (
  SELECT *, CAST(sum(CASE WHEN prev IS NULL OR date_diff('day', prev, d) > 7 THEN 1 ELSE 0 END)
      OVER (PARTITION BY store_id, promo_code ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_no FROM (
    SELECT *, lag(d) OVER (PARTITION BY store_id, promo_code ORDER BY d) AS prev FROM (
      SELECT DISTINCT store_id, promo_code, event_date AS d FROM {SQL_LINES} WHERE promo_code IS NOT NULL)))
GROUP BY ALL""",
)
def w04_episodes(spark, sf):
    li = d.lines(spark, sf).where(F.col("promo_code").isNotNull())
    ep = windows.episodes(li.select("store_id", "promo_code", F.col("event_date").alias("d")), ["store_id", "promo_code"], "d", 7)
    return ep.withColumn("episode_no", F.col("episode_no").cast("bigint"))


_SQL_BALANCES = f"""(SELECT *, CAST(sum(qty) OVER (PARTITION BY store_id, product_id ORDER BY event_ts, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance
  FROM {SQL_LEDGER})"""


def balances(spark, sf, tail=None):
    """W05's rows; with ``tail`` those of its days."""
    if tail is None:
        return windows.running_balance(d.ledger(spark, sf), ["store_id", "product_id"], "event_ts", "txn_id", "qty", bucket=F.to_date("event_ts"))
    led = d.ledger(spark, sf).where(F.to_date("event_ts") >= F.lit(tail.since)).join(tail.opening, ["store_id", "product_id"], "left")
    opening = F.coalesce(F.col("opening"), F.lit(0))
    return windows.running_balance(led, ["store_id", "product_id"], "event_ts", "txn_id", "qty", opening=opening, bucket=F.to_date("event_ts")).drop("opening")


class Tail:
    """The ledger's days from the date ``since`` on: ``opening`` has the sum of all earlier movements (those
    without a time are the earliest) for each store and product that moves in these days."""

    def __init__(self, spark, sf, since):
        from storelake.operators import ml

        key = ["store_id", "product_id"]
        led = d.ledger(spark, sf).select(*key, "event_ts", "qty")
        late = F.to_date("event_ts") >= F.lit(since)
        keys = ml.staged(led.where(late).select(*[F.col(k).alias(f"_{k}") for k in key]).distinct(), "keys")  # files tell the join their size
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        old = led.where(~late | F.col("event_ts").isNull()).join(keys, same[0] & same[1], "left_semi")
        self.since, self.opening = since, ml.staged(old.groupBy(*key).agg(F.sum("qty").alias("opening")), "opening")


# W05 ---------------------------------------------------------------------------
@register("W05", f"SELECT * FROM {_SQL_BALANCES}")
def w05_running_balance(spark, sf):
    return balances(spark, sf)


# W06 ---------------------------------------------------------------------------
@register(
    "W06",
    f"""SELECT store_id, product_id, CAST(event_ts AS DATE) AS event_date, event_ts, txn_id, abs(qty) AS last_known_quantity, balance
FROM {_SQL_BALANCES} WHERE balance <= 0 AND balance - qty > 0
QUALIFY row_number() OVER (PARTITION BY store_id, product_id, CAST(event_ts AS DATE) ORDER BY event_ts, txn_id) = 1""",
)
def w06_threshold_crossing(spark, sf):
    return windows.threshold_crossings(balances(spark, sf), ["store_id", "product_id"], "event_ts", "txn_id", "qty")


def dense_dept(spark, sf):
    li = d.table(spark, sf, "lineitem")
    p = d.table(spark, sf, "part").select("p_partkey", "p_type")
    day = (
        li.join(p, li.l_partkey == p.p_partkey, "inner")
        .groupBy(F.col("p_type").alias("department"), F.to_date("l_shipdate").alias("sale_date"))
        .agg(F.sum("l_quantity").cast("bigint").alias("units"), F.sum(d.cents("l_extendedprice")).alias("revenue_cents"))
    )
    return calendar.densify(day, ["department"], "sale_date", ["units", "revenue_cents"])


# W07 ---------------------------------------------------------------------------
@register(
    "W07",
    f"""SELECT department, sale_date, units, revenue_cents,
  CAST(lag(units, 1) OVER w AS DOUBLE) AS lag_1, CAST(lag(units, 7) OVER w AS DOUBLE) AS lag_7,
  CAST(lag(units, 14) OVER w AS DOUBLE) AS lag_14, CAST(lag(units, 28) OVER w AS DOUBLE) AS lag_28
FROM {SQL_DENSE_DEPT} WINDOW w AS (PARTITION BY department ORDER BY sale_date)""",
)
def w07_lag_features(spark, sf):
    """Day lags on the densified daily series per department.
    Lags are doubles: NULL at the series start, and nullable integers would
    not survive a pandas round trip as integers."""
    x = windows.lag_features(dense_dept(spark, sf), ["department"], "sale_date", "units")
    return x.select(*[F.col(c).cast("double").alias(c) if c.startswith("lag_") else F.col(c) for c in x.columns])


# W08 ---------------------------------------------------------------------------
@register(
    "W08",
    f"""SELECT department, sale_date, units, revenue_cents,
  round(avg(units) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS roll_mean_7,
  round(avg(units) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 4) AS roll_mean_14,
  round(avg(units) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 4) AS roll_mean_28,
  round(stddev_samp(units) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 4) AS roll_std_14
FROM {SQL_DENSE_DEPT} WINDOW w AS (PARTITION BY department ORDER BY sale_date)""",
)
def w08_rolling_stats(spark, sf):
    return finish(windows.rolling_stats(dense_dept(spark, sf), ["department"], "sale_date", "units"), 4)


# W09 ---------------------------------------------------------------------------
@register(
    "W09",
    f"""SELECT * FROM (SELECT user_id, event_id, ts, event_type, value, prev_ts, is_new, session_no,
  (epoch_us(lead(ts) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS dwell_seconds
FROM {_SQL_SESSIONS}) WHERE dwell_seconds > 0 AND dwell_seconds < {SESSION_GAP_S}""",
)
def w09_dwell_to_next(spark, sf):
    """Seconds to the next event within the same session, 0 < d < gap."""
    s = sessions(spark, sf).withColumn("session_no", F.col("session_no").cast("bigint"))
    return windows.dwell_to_next(s, ["user_id", "session_no"], "ts", "event_id", SESSION_GAP_S)


# W10 ---------------------------------------------------------------------------
@register(
    "W10",
    """SELECT * FROM (SELECT event_id, ts, user_id, event_type, value, props,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
WHERE from_state IS NOT NULL AND from_state <> to_state""",
)
def w10_zone_changes(spark, sf):
    return windows.changes(d.table(spark, sf, "events"), ["user_id"], "ts", "event_id", "event_type")


# W11 ---------------------------------------------------------------------------
@register(
    "W11",
    f"""SELECT store_id, product_id, revenue_cents, CAST(rank AS INTEGER) AS rank FROM (
  SELECT store_id, product_id, CAST(sum(ext_cents) AS BIGINT) AS revenue_cents,
    row_number() OVER (PARTITION BY store_id ORDER BY sum(ext_cents) DESC, product_id) AS rank
  FROM {SQL_LINES} GROUP BY store_id, product_id) WHERE rank <= 3""",
)
def w11_top_n_per_group(spark, sf):
    rev = d.lines(spark, sf).groupBy("store_id", "product_id").agg(F.sum("ext_cents").alias("revenue_cents"))
    return windows.top_n_per_group(rev, ["store_id"], [F.desc("revenue_cents"), F.asc("product_id")], 3)


# W12 ---------------------------------------------------------------------------
@register(
    "W12",
    """SELECT customer_id, spend_cents, row_number() OVER (ORDER BY spend_cents DESC, customer_id) AS risk_rank FROM (
  SELECT o_custkey AS customer_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spend_cents FROM orders GROUP BY 1)""",
)
def w12_global_rank(spark, sf):
    """Global ranking without a single-partition window: rows are numbered
    inside spend buckets (log scale, monotone in the order) and offset by the
    counts of all higher buckets."""
    spend = d.receipts(spark, sf).groupBy("customer_id").agg(F.sum("total_cents").alias("spend_cents"))
    bucket = -F.floor(F.log2(F.greatest(F.col("spend_cents"), F.lit(1))) * 64)
    out = windows.bucketed_row_number(spend, [], [F.desc("spend_cents"), F.asc("customer_id")], bucket, "risk_rank")
    return out.withColumn("risk_rank", F.col("risk_rank").cast("bigint"))


# W13 ---------------------------------------------------------------------------
@register(
    "W13",
    f"""SELECT c_custkey, c_mktsegment, CASE WHEN rk <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {md5_unit_sql(['c_custkey'], 42)}, c_custkey) AS rk,
    count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)""",
)
def w13_stratified_split(spark, sf):
    c = d.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return windows.stratified_split(c, "c_mktsegment", "c_custkey", seed=42, test_fraction=0.2)


# W14 ---------------------------------------------------------------------------
@register(
    "W14",
    f"""SELECT receipt_id, line_num, product_id, store_id, quantity,
  CAST(coalesce(sum(quantity) OVER (PARTITION BY receipt_id ORDER BY line_num, product_id, store_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS qty_before,
  CAST(floor(coalesce(sum(quantity) OVER (PARTITION BY receipt_id ORDER BY line_num, product_id, store_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100) AS BIGINT) AS leg
FROM {SQL_LINES}""",
)
def w14_capacity_legs(spark, sf):
    """Truck leg of each line: quantity loaded before it // capacity (100)."""
    li = d.lines(spark, sf).select("receipt_id", "line_num", "product_id", "store_id", "quantity")
    x = windows.running_sum(li, ["receipt_id"], ["line_num", "product_id", "store_id"], "quantity", "qty_before", inclusive=False)
    return x.withColumn("qty_before", F.col("qty_before").cast("bigint")).withColumn("leg", F.floor(F.col("qty_before") / 100).cast("bigint"))


# W15 ---------------------------------------------------------------------------
@register(
    "W15",
    f"""SELECT receipt_id, store_id, total_cents FROM (
  SELECT o_orderkey AS receipt_id, c_nationkey AS store_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY {md5_unit_sql(['o_orderkey'], 7)}, o_orderkey) AS rk,
    count(*) OVER (PARTITION BY c_nationkey) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rk <= floor(n * 0.05)""",
)
def w15_capped_group_sample(spark, sf):
    """Returns sample: exactly floor(5 % of each store's receipts), seeded."""
    r = d.receipts(spark, sf, with_store=True).select("receipt_id", F.col("store_id").cast("int").alias("store_id"), "total_cents")
    return windows.capped_group_sample(r, ["store_id"], "receipt_id", 0.05, seed=7)


# W16 ---------------------------------------------------------------------------
@register(
    "W16",
    """SELECT from_state, to_state, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY from_state), 6) AS share FROM (
  SELECT from_state, to_state, count(*) AS n FROM (
    SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
  WHERE from_state IS NOT NULL GROUP BY ALL)""",
)
def w16_transition_share(spark, sf):
    e = d.table(spark, sf, "events")
    t = windows.previous(e, ["user_id"], ["ts", "event_id"], "event_type", "from_state")
    t = t.select("from_state", F.col("event_type").alias("to_state")).where(F.col("from_state").isNotNull())
    n = t.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return finish(windows.share_of_total(n, ["from_state"], "n"), 6)


_SQL_DENSE_TOTAL = """(SELECT g.sale_date, coalesce(s.revenue_cents, 0) AS revenue_cents FROM
  (SELECT CAST(unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS sale_date FROM lineitem) g
  LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS sale_date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
             FROM lineitem GROUP BY 1) s ON g.sale_date = s.sale_date)"""


def dense_total(spark, sf):
    li = d.lines(spark, sf)
    day = li.groupBy(F.col("event_date").alias("sale_date")).agg(F.sum("ext_cents").alias("revenue_cents")).withColumn("_all", F.lit(1))
    return calendar.densify(day, ["_all"], "sale_date", ["revenue_cents"]).drop("_all")


# W17 ---------------------------------------------------------------------------
@register(
    "W17",
    f"""SELECT sale_date, revenue_cents,
  CAST(sum(revenue_cents) OVER (PARTITION BY date_trunc('year', sale_date) ORDER BY sale_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS year_to_date,
  CAST(sum(revenue_cents) OVER (PARTITION BY date_trunc('quarter', sale_date) ORDER BY sale_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS quarter_to_date,
  CAST(sum(revenue_cents) OVER (PARTITION BY date_trunc('month', sale_date) ORDER BY sale_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS month_to_date
FROM {_SQL_DENSE_TOTAL}""",
)
def w17_period_to_date(spark, sf):
    x = dense_total(spark, sf)
    for unit in ("year", "quarter", "month"):
        x = windows.period_to_date(x, [], "sale_date", "revenue_cents", unit)
    return x


# W18 ---------------------------------------------------------------------------
@register(
    "W18",
    f"""SELECT c.sale_date, c.revenue_cents, CAST(pd.revenue_cents AS DOUBLE) AS prior_day, CAST(pm.revenue_cents AS DOUBLE) AS prior_month,
  CAST(py.revenue_cents AS DOUBLE) AS prior_year,
  round((c.revenue_cents - pd.revenue_cents) / CAST(nullif(pd.revenue_cents, 0) AS DOUBLE), 6) AS dod_change
FROM {_SQL_DENSE_TOTAL} c
LEFT JOIN {_SQL_DENSE_TOTAL} pd ON pd.sale_date = c.sale_date - INTERVAL 1 DAY
LEFT JOIN {_SQL_DENSE_TOTAL} pm ON pm.sale_date = CAST(c.sale_date - INTERVAL 1 MONTH AS DATE)
LEFT JOIN {_SQL_DENSE_TOTAL} py ON py.sale_date = CAST(c.sale_date - INTERVAL 1 YEAR AS DATE)""",
)
def w18_prior_periods(spark, sf):
    x = dense_total(spark, sf)
    x = windows.prior_period(x, [], "sale_date", "revenue_cents", days=1, out="prior_day")
    x = windows.prior_period(x, [], "sale_date", "revenue_cents", months=1, out="prior_month")
    x = windows.prior_period(x, [], "sale_date", "revenue_cents", months=12, out="prior_year")
    x = x.select("sale_date", "revenue_cents", *[F.col(c).cast("double").alias(c) for c in ("prior_day", "prior_month", "prior_year")])
    return finish(x.withColumn("dod_change", F.try_divide((F.col("revenue_cents") - F.col("prior_day")).cast("double"), F.col("prior_day"))), 6)


# W19 ---------------------------------------------------------------------------
@register(
    "W19",
    f"""SELECT department, sale_date, units, revenue_cents,
  CAST(sum(revenue_cents) OVER (PARTITION BY department ORDER BY sale_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS last_7d,
  CAST(sum(revenue_cents) OVER (PARTITION BY department ORDER BY sale_date RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING) AS DOUBLE) AS prev_7d,
  round((last_7d - prev_7d) / nullif(prev_7d, 0) * 100, 6) AS wow_pct
FROM {SQL_DAILY_DEPT}""",
)
def w19_trailing_windows(spark, sf):
    """Trailing 7 days and the 7 before, on the sparse series (range frames), and
    the week-over-week change in per cent."""
    li = d.table(spark, sf, "lineitem")
    p = d.table(spark, sf, "part").select("p_partkey", "p_type")
    day = (
        li.join(p, li.l_partkey == p.p_partkey, "inner")
        .groupBy(F.col("p_type").alias("department"), F.to_date("l_shipdate").alias("sale_date"))
        .agg(F.sum("l_quantity").cast("bigint").alias("units"), F.sum(d.cents("l_extendedprice")).alias("revenue_cents"))
    )
    out = windows.trailing_windows(day, ["department"], "sale_date", "revenue_cents", 7)
    out = out.withColumn("prev_7d", F.col("prev_7d").cast("double"))
    return out.withColumn("wow_pct", F.round(F.try_divide(F.col("last_7d") - F.col("prev_7d"), F.col("prev_7d")) * 100, 6))


# W20 ---------------------------------------------------------------------------
@register(
    "W20",
    f"""SELECT receipt_id, line_num, product_id, store_id, unit_cents,
  CAST(row_number() OVER (PARTITION BY receipt_id ORDER BY unit_cents, product_id, line_num, store_id) AS INTEGER) AS price_rank FROM {SQL_LINES}""",
)
def w20_rank_by_price(spark, sf):
    li = d.lines(spark, sf).select("receipt_id", "line_num", "product_id", "store_id", "unit_cents")
    by_price = Window.partitionBy("receipt_id").orderBy("unit_cents", "product_id", "line_num", "store_id")
    return li.withColumn("price_rank", F.row_number().over(by_price))


# R01 ---------------------------------------------------------------------------
@register("R01", f"SELECT * FROM {SQL_DENSE_DEPT}")
def r01_densify(spark, sf):
    """Daily grid per department from its first to last sale, zeros filled."""
    return dense_dept(spark, sf)


# X03 ---------------------------------------------------------------------------
@register(
    "X03",
    """SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, d AS date, year(d) AS year, quarter(d) AS quarter, month(d) AS month,
  monthname(d) AS month_name, day(d) AS day, isodow(d) AS day_of_week, dayname(d) AS day_name,
  CAST(strftime(d, '%U') AS BIGINT) AS week_of_year, CAST(weekofyear(d) AS BIGINT) AS iso_week,
  CAST(CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CASE WHEN month(d) >= 7 THEN year(d) ELSE year(d) - 1 END AS fiscal_year,
  ((month(d) - 7 + 12) % 12) // 3 + 1 AS fiscal_quarter
FROM (SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)""",
)
def x03_dim_date(spark, sf):
    o = d.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return calendar.dim_date(o)
