"""Driver tables and the retail roles they play.

Every operator in this package takes DataFrames plus column names. The named
queries bind those roles to the driver's TPC-H-ish tables through the views
below; each view is a plain projection (or a dimension lookup join), so
Catalyst prunes columns and pushes filters straight into the parquet scans.

Role mapping (fixed choices, documented in the README):

- receipt header  = ``orders``   (store = customer's nation, tender = order priority)
- receipt line    = ``lineitem`` (store = supplier, product = part, RETURN when l_returnflag = 'R')
- promo code      = ``'D' || round(l_discount*100)`` when l_discount > 0
- live events     = ``events``   (zone = event_type, device/customer = user_id, campaign = props.k)
- inventory ledger= ``lineitem`` signed quantity by (supplier, part) in ship-date order
- truck lifecycle = order date (arrival) and ship date (departure) per shipment = order
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# The tables behind the retail roles; the others hold training data.
ROLE_TABLES = TABLES[:8]

# Unique key of a lineitem row (l_orderkey, l_linenumber alone is not unique).
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cents(c: Column | str) -> Column:
    """Money as integer cents (the exact representation every sum uses)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 100).cast("bigint")


def receipts(spark: SparkSession, sf_dir: str, with_store: bool = False) -> DataFrame:
    """Receipt headers from ``orders``.

    ``with_store`` adds ``store_id`` via the customer dimension (an equi
    join on the customer key; AQE broadcasts the dimension only when its
    measured size is under the broadcast threshold)."""
    o = table(spark, sf_dir, "orders")
    df = o.select(
        F.col("o_orderkey").alias("receipt_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("event_ts"),
        F.to_date("o_orderdate").alias("event_date"),
        cents("o_totalprice").alias("total_cents"),
        F.col("o_orderpriority").alias("tender_type"),
        F.col("o_orderstatus").alias("status"),
    )
    if with_store:
        c = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").cast("bigint").alias("store_id")
        )
        df = df.join(c, "customer_id", "inner")
    return df


def promo_code(discount: Column) -> Column:
    return F.when(discount > 0, F.concat(F.lit("D"), F.round(discount * 100).cast("int").cast("string")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt lines from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("receipt_id"),
        F.col("l_linenumber").alias("line_num"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        cents("l_extendedprice").alias("ext_cents"),
        F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("bigint").alias("unit_cents"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax_rate"),
        promo_code(F.col("l_discount")).alias("promo_code"),
        F.when(F.col("l_returnflag") == "R", F.lit("RETURN")).otherwise(F.lit("SALE")).alias("receipt_type"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_shipdate").alias("event_ts"),
        F.to_date("l_shipdate").alias("event_date"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live events: zone = event_type, device = user_id, campaign = props.k."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("department"),
        F.col("p_size").alias("size"),
        cents("p_retailprice").alias("msrp_cents"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory ledger: each line is a signed movement at (store=supplier,
    product=part): returns restock (+qty), other lines sell (-qty)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("event_ts"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in LINE_KEY]).alias("txn_id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("bigint").alias("qty"),
        F.col("l_returnflag").alias("reason"),
    )


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with the numbers that ``txn_id`` is made of instead of the text, for steps that shuffle it."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("event_ts"),
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("bigint").alias("qty"),
    )


def txn_id() -> Column:
    """``txn_id`` of the ledger over the columns of ``movements``."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "product_id", "store_id")])


def truck_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truck status rows: every line of a shipment (= order) arrives at the
    order date and departs at its ship date. Returned goods (l_returnflag R)
    travel to a DC, the rest to a store; truck = the order's customer."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    is_ret = F.col("l_returnflag") == "R"
    base = [
        F.col("o_custkey").alias("truck_id"),
        F.when(is_ret, F.col("l_suppkey")).alias("dc_id"),
        F.when(~is_ret, F.col("l_suppkey")).alias("store_id"),
        F.col("l_orderkey").alias("shipment_id"),
        F.col("o_orderdate").alias("eta"),
        F.col("l_shipdate").alias("etd"),
    ]
    st = F.explode(
        F.array(
            F.struct(F.lit("ARRIVED").alias("status"), F.col("o_orderdate").alias("event_ts")),
            F.struct(F.lit("DEPARTED").alias("status"), F.col("l_shipdate").alias("event_ts")),
        )
    ).alias("s")
    return j.select(*base, st).select("truck_id", "dc_id", "store_id", "shipment_id", "eta", "etd", "s.status", "s.event_ts")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foot-traffic/BLE readings from ``events``: store = props.k, zone =
    event_type, device = user_id, dwell seconds = value."""
    return events(spark, sf_dir).select(
        F.col("k").alias("store_id"),
        F.col("event_type").alias("zone"),
        F.col("user_id").alias("device_id"),
        F.col("value").alias("dwell_seconds"),
        F.col("ts").alias("event_ts"),
        "event_id",
    )


def marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad impressions (view events): campaign = props.k, cost = value."""
    return (
        events(spark, sf_dir)
        .where(F.col("event_type") == "view")
        .select(
            F.col("k").alias("campaign_id"),
            F.col("user_id").alias("customer_id"),
            F.round(F.col("value") * 100).cast("bigint").alias("cost_cents"),
            F.col("ts").alias("event_ts"),
            F.col("event_id").alias("impression_id"),
        )
    )
