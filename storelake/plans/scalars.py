"""Scalar function families X01–X16 (one parametrised query per family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelake.functions import money
from storelake.functions.hashing import md5_unit, md5_unit_sql, weighted_pick
from storelake.plans.common import SQL_LINES, finish
from storelake.plans.registry import register
from storelake.sources import driver as d


@register(
    "X01",
    """SELECT o_orderkey, time_bucket(INTERVAL '15 minutes', o_orderdate) AS bin15, date_trunc('month', o_orderdate) AS month_start,
  CAST(o_orderdate AS DATE) AS day, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(dayofmonth(o_orderdate) AS INTEGER) AS dom,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(hour(o_orderdate) AS INTEGER) AS hour FROM orders""",
)
def x01_date_parts(spark, sf):
    o = d.table(spark, sf, "orders")
    return finish(
        o.select(
            "o_orderkey", F.window("o_orderdate", "15 minutes").start.alias("bin15"), F.date_trunc("month", "o_orderdate").alias("month_start"),
            F.to_date("o_orderdate").alias("day"), F.dayofweek("o_orderdate").alias("dow"), F.dayofmonth("o_orderdate").alias("dom"),
            F.month("o_orderdate").alias("month"), F.weekofyear("o_orderdate").alias("week"), F.hour("o_orderdate").alias("hour"),
        )
    )


@register(
    "X02",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days,
  CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS plus30, CAST(o_orderdate - INTERVAL 7 DAY AS DATE) AS minus7,
  date_diff('second', o_orderdate, l_shipdate) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def x02_date_arithmetic(spark, sf):
    li = d.table(spark, sf, "lineitem").join(d.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("plus30"), F.date_sub(F.to_date("o_orderdate"), 7).alias("minus7"),
        F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"),
    )


@register(
    "X04",
    """SELECT c_custkey, 'C-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code, regexp_extract(c_name, '(\\d+)$', 1) AS trailing_digits,
  substring(c_name, 1, 8) AS prefix8, contains(lower(c_mktsegment), 'hold') AS is_household, upper(c_name) AS upper_name,
  printf('%s/%05d', c_mktsegment, c_nationkey) AS formatted FROM customer""",
)
def x04_strings(spark, sf):
    c = d.table(spark, sf, "customer")
    return c.select(
        "c_custkey", F.concat(F.lit("C-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("code"),
        F.regexp_extract("c_name", r"(\d+)$", 1).alias("trailing_digits"), F.substring("c_name", 1, 8).alias("prefix8"),
        F.lower("c_mktsegment").contains("hold").alias("is_household"), F.upper("c_name").alias("upper_name"),
        F.format_string("%s/%05d", "c_mktsegment", "c_nationkey").alias("formatted"),
    )


@register("X04_conv")
def x04_conv_base36(spark, sf):
    """Base-36 ids (conv) — no DuckDB twin, rows-only."""
    return d.table(spark, sf, "customer").select("c_custkey", F.conv(F.col("c_custkey").cast("string"), 10, 36).alias("id36"))


@register(
    "X05",
    """SELECT c_custkey, round(c_acctbal, 1) AS r1, CAST(floor(c_acctbal) AS BIGINT) AS fl, greatest(c_acctbal, 0.0) AS pos, least(c_acctbal, 1000.0) AS capped,
  abs(c_acctbal) AS absval, round(sqrt(abs(c_acctbal)), 6) AS sq, round(pow(abs(c_acctbal), 0.5), 6) AS pw,
  round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS lg FROM customer""",
)
def x05_math(spark, sf):
    c = d.table(spark, sf, "customer")
    b = F.col("c_acctbal")
    out = c.select(
        "c_custkey", F.round(b, 1).alias("r1"), F.floor(b).alias("fl"), F.greatest(b, F.lit(0.0)).alias("pos"), F.least(b, F.lit(1000.0)).alias("capped"),
        F.abs(b).alias("absval"), F.sqrt(F.abs(b)).alias("sq"), F.pow(F.abs(b), 0.5).alias("pw"), F.when(b > 0, F.log(b)).alias("lg"),
    )
    return out.select("c_custkey", "r1", "fl", "pos", "capped", "absval", *[F.round(c_, 6).alias(c_) for c_ in ("sq", "pw", "lg")])


@register(
    "X06",
    """SELECT l_suppkey, round(coalesce(CAST(sum(l_discount) AS DOUBLE) / nullif(count_if(l_returnflag = 'R'), 0), 0), 6) AS divide_zero,
  round(CAST(sum(l_discount) AS DOUBLE) / nullif(count_if(l_returnflag = 'X'), 0), 6) AS divide_blank FROM lineitem GROUP BY 1""",
)
def x06_safe_ratio(spark, sf):
    """DIVIDE(a, b, 0) and DIVIDE(a, b, BLANK()) with ANSI on (try_divide)."""
    li = d.table(spark, sf, "lineitem")
    g = li.groupBy("l_suppkey").agg(F.sum("l_discount").alias("s"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "X").alias("x"))
    return finish(g.select("l_suppkey", F.coalesce(F.try_divide("s", "r"), F.lit(0.0)).alias("divide_zero"), F.try_divide("s", "x").alias("divide_blank")), 6)


@register(
    "X07",
    """SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'UNKNOWN') AS segment, CASE WHEN c.c_custkey IS NOT NULL THEN 'known' ELSE 'anonymous' END AS kind
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey""",
)
def x07_nulls(spark, sf):
    c = d.table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.lit(1).alias("_k"))
    o = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left")
    return o.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("UNKNOWN")).alias("segment"), F.when(F.col("_k").isNotNull(), "known").otherwise("anonymous").alias("kind"))


@register(
    "X08",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'critical' WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 150000 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN (200000 - o_totalprice) / 200000 * 100 >= 50 THEN 'URGENT' WHEN (200000 - o_totalprice) / 200000 * 100 >= 25 THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM orders""",
)
def x08_case_buckets(spark, sf):
    """CASE bucketing (severity-style band and deficit-% priority)."""
    o = d.table(spark, sf, "orders")
    p = F.col("o_totalprice")
    band = F.when(p >= 400000, "critical").when(p >= 300000, "high").when(p >= 150000, "medium").otherwise("low")
    deficit = (200000 - p) / 200000 * 100
    return o.select("o_orderkey", band.alias("band"), F.when(deficit >= 50, "URGENT").when(deficit >= 25, "HIGH").otherwise("NORMAL").alias("priority"))


@register("X09", "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus)) AS alert_id FROM orders")
def x09_hashing(spark, sf):
    """sha256 ids (portable); xxhash64 ids and pmod chunks in X09_xxhash."""
    o = d.table(spark, sf, "orders")
    return o.select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("alert_id"))


@register("X09_xxhash")
def x09_xxhash_chunks(spark, sf):
    """xxhash64 row ids and pmod(hash, 8) write chunks (JVM-only hash)."""
    o = d.table(spark, sf, "orders")
    return o.select("o_orderkey", F.xxhash64("o_orderkey", "o_orderstatus").alias("row_hash"), F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).alias("chunk"))


@register(
    "X10",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, to_json({'event_id': event_id, 'type': event_type}) AS envelope FROM events""",
)
def x10_json(spark, sf):
    e = d.table(spark, sf, "events")
    return e.select(
        "event_id", F.from_json("props", "k int").k.alias("k"), F.to_json(F.struct(F.col("event_id"), F.col("event_type").alias("type"))).alias("envelope")
    )


@register(
    "X11",
    """SELECT l_orderkey, CAST(len(list(l_linenumber)) AS INTEGER) AS n_lines, list_sort(list(l_linenumber))[1] AS first_line,
  array_to_string(list_sort(list(l_linenumber)), ',') AS lines, array_to_string(list_transform(list_sort(list(l_linenumber)), lambda x: x * 2), ',') AS doubled,
  CAST(len(range(1, max(l_linenumber) + 1)) AS INTEGER) AS seq_len FROM lineitem GROUP BY 1""",
)
def x11_arrays(spark, sf):
    li = d.table(spark, sf, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"), F.max("l_linenumber").alias("m"))
    return g.select(
        "l_orderkey", F.size("a").alias("n_lines"), F.element_at("a", 1).alias("first_line"), F.array_join("a", ",").alias("lines"),
        F.array_join(F.transform("a", lambda x: x * 2), ",").alias("doubled"), F.size(F.sequence(F.lit(1), F.col("m"))).alias("seq_len"),
    )


@register(
    "X12",
    """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s, make_timestamp(CAST(epoch(o_orderdate) AS BIGINT) * 1000000) AS back,
  TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority_no,
  make_timestamp(year(o_orderdate), month(o_orderdate), 1, 12, 0, 0) AS month_noon FROM orders""",
)
def x12_casts_epoch(spark, sf):
    o = d.table(spark, sf, "orders")
    ep = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return finish(
        o.select(
            "o_orderkey", ep.alias("epoch_s"), F.timestamp_seconds(ep).alias("back"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority_no"),
            F.make_timestamp_ntz(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1), F.lit(12), F.lit(0), F.lit(0)).alias("month_noon"),
        )
    )


@register(
    "X13",
    f"""SELECT receipt_id, line_num, product_id, store_id, ext_cents, CAST(round(tax_rate * 10000) AS BIGINT) AS rate_bps,
  CASE WHEN receipt_type = 'RETURN' THEN 'EXEMPT' WHEN line_status = 'O' THEN 'REDUCED' ELSE 'TAXABLE' END AS taxability,
  CAST((ext_cents * CAST(round(tax_rate * 10000) AS BIGINT) * CASE WHEN receipt_type = 'RETURN' THEN 0 WHEN line_status = 'O' THEN 50 ELSE 100 END + 500000) // 1000000 AS BIGINT) AS tax_cents
FROM {SQL_LINES}""",
)
def x13_basis_point_tax(spark, sf):
    """floor((ext * bps * mult + 500000) / 10^6) with mult 100/50/0 by
    taxability (role: returns exempt, open lines reduced)."""
    li = d.lines(spark, sf)
    tx = F.when(F.col("receipt_type") == "RETURN", "EXEMPT").when(F.col("line_status") == "O", "REDUCED").otherwise("TAXABLE")
    bps = F.round(F.col("tax_rate") * 10000).cast("bigint")
    x = li.select("receipt_id", "line_num", "product_id", "store_id", "ext_cents", bps.alias("rate_bps"), tx.alias("taxability"))
    return x.withColumn("tax_cents", money.line_tax_cents("ext_cents", "rate_bps", money.taxability_multiplier("taxability")))


@register(
    "X14",
    f"""SELECT receipt_id, line_num, product_id, store_id, least(greatest(0, CAST(floor(ext_cents * (discount * 100) / 100 + 0.5) AS BIGINT)), ext_cents) AS pct_discount_cents,
  CAST(floor(quantity / 2) * unit_cents AS BIGINT) AS bogo_cents FROM {SQL_LINES}""",
)
def x14_discounts(spark, sf):
    li = d.lines(spark, sf)
    return li.select(
        "receipt_id", "line_num", "product_id", "store_id", money.percent_discount_cents("ext_cents", F.col("discount") * 100).alias("pct_discount_cents"),
        money.bogo_discount_cents("unit_cents", "quantity").alias("bogo_cents"),
    )


def promo_rules():
    """A small promotion catalogue (code, first month, last
    month, minimum spend in cents, minimum quantity)."""
    return [
        ("WINTER10", 1, 2, 0, 1),
        ("SPRING5", 3, 5, 5000000, 1),
        ("SUMMER15", 6, 8, 0, 30),
        ("FALL20", 9, 11, 10000000, 20),
        ("HOLIDAY25", 12, 12, 0, 1),
    ]


@register(
    "X15",
    f"""WITH r(code, m_from, m_to, min_cents, min_qty) AS (VALUES ('WINTER10', 1, 2, 0, 1), ('SPRING5', 3, 5, 5000000, 1), ('SUMMER15', 6, 8, 0, 30),
  ('FALL20', 9, 11, 10000000, 20), ('HOLIDAY25', 12, 12, 0, 1))
SELECT receipt_id, line_num, product_id, store_id, coalesce(r.code, 'NONE') AS eligible_code FROM {SQL_LINES} l
LEFT JOIN r ON month(l.event_ts) BETWEEN r.m_from AND r.m_to AND l.ext_cents >= r.min_cents AND l.quantity >= r.min_qty""",
)
def x15_promo_eligibility(spark, sf):
    """Eligibility by month, minimum spend and quantity as one CASE over the
    rules (at most one rule a month); fallback code NONE."""
    li = d.lines(spark, sf)
    code = F.lit("NONE")
    for name, m_from, m_to, cents, qty in promo_rules():
        fits = F.month("event_ts").between(m_from, m_to) & (F.col("ext_cents") >= cents) & (F.col("quantity") >= qty)
        code = F.when(fits, F.lit(name)).otherwise(code)
    return li.select("receipt_id", "line_num", "product_id", "store_id", code.alias("eligible_code"))


@register(
    "X16",
    f"""SELECT c_custkey, CASE WHEN u < 0.5 THEN 'CASH' WHEN u < 0.8 THEN 'CARD' WHEN u < 0.95 THEN 'MOBILE' ELSE 'GIFT' END AS tender FROM (
  SELECT c_custkey, {md5_unit_sql(['c_custkey'], 3)} AS u FROM customer)""",
)
def x16_weighted_pick(spark, sf):
    """Inverse-CDF pick from a portable md5 draw: CASH 50 %, CARD 30 %,
    MOBILE 15 %, GIFT 5 %."""
    c = d.table(spark, sf, "customer")
    u = md5_unit(["c_custkey"], 3)
    return c.select("c_custkey", weighted_pick(u, [("CASH", 50), ("CARD", 30), ("MOBILE", 15), ("GIFT", 5)]).alias("tender"))
