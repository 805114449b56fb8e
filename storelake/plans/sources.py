"""Sources, sinks and table jobs (S01–S20) bound to the driver tables. Every
written artefact goes to a fresh run folder under spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.plans.common import finish
from storelake.plans.registry import ORACLES, register
from storelake.sources import driver as d
from storelake.sources import files as fs
from storelake.streaming.runner import run_folder


def _p(sf, name):
    return f"{sf.rstrip('/')}/{name}.parquet"


@register(
    "S01",
    """SELECT c_custkey AS party_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation_key, c_acctbal AS acctbal, c_mktsegment, 'customer' AS source FROM customer
UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT), s_acctbal, NULL, 'supplier' FROM supplier""",
)
def s01_read_reconciled(spark, sf):
    """Customers and suppliers read file by file, renamed and cast to one
    contract, unioned by name (missing segment is NULL for suppliers)."""
    return fs.read_reconciled(
        spark,
        {"customer": _p(sf, "customer"), "supplier": _p(sf, "supplier")},
        {"customer": {"c_custkey": "party_id", "c_name": "name", "c_nationkey": "nation_key", "c_acctbal": "acctbal"},
         "supplier": {"s_suppkey": "party_id", "s_name": "name", "s_nationkey": "nation_key", "s_acctbal": "acctbal"}},
        {"nation_key": "bigint", "acctbal": "double"},
    ).select("party_id", "name", "nation_key", "acctbal", "c_mktsegment", "source")


_EXPECTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "store_returns"]


@register(
    "S02",
    """SELECT 'region' AS table_name, true AS exists, CAST((SELECT count(*) FROM region) AS DOUBLE) AS rows UNION ALL SELECT 'nation', true, (SELECT count(*) FROM nation)
UNION ALL SELECT 'customer', true, (SELECT count(*) FROM customer) UNION ALL SELECT 'supplier', true, (SELECT count(*) FROM supplier)
UNION ALL SELECT 'part', true, (SELECT count(*) FROM part) UNION ALL SELECT 'orders', true, (SELECT count(*) FROM orders)
UNION ALL SELECT 'lineitem', true, (SELECT count(*) FROM lineitem) UNION ALL SELECT 'events', true, (SELECT count(*) FROM events)
UNION ALL SELECT 'store_returns', false, NULL::DOUBLE""",
)
def s02_read_table(spark, sf):
    """Catalog scan: the tables that are there are bound as views of the catalog under their own
    prefix, then every expected one is looked up by name. An absent source is reported, never invented."""
    for name in _EXPECTED:
        if fs.table_exists(spark, _p(sf, name)):
            spark.read.parquet(_p(sf, name)).createOrReplaceTempView(f"s02_{name}")
    found = fs.catalog_scan(spark, [f"s02_{name}" for name in _EXPECTED])
    return found.select(F.expr("substr(table_name, 5)").alias("table_name"), "exists", F.col("rows").cast("double").alias("rows"))


@register("S17", ORACLES["S02"])
def s17_expected_vs_found(spark, sf):
    """Presence and row count per expected table (includes one absent table)."""
    return fs.expected_vs_found(spark, sf, _EXPECTED).withColumn("rows", F.col("rows").cast("double"))


@register("S03", None)
def s03_write_all(spark, sf):
    """Write a set of gold tables and append the run log (table, rows)."""
    from storelake.plans import gold

    base = run_folder(spark, "s03")
    log = fs.write_all(spark, {"tender_mix_daily": gold.a11_tender_mix_daily(spark, sf), "marketing_cost_daily": gold.a10_marketing_cost_daily(spark, sf)}, base, "run-1")
    return log.select("run_id", "table_name", "row_count")


ORACLES["S03"] = """SELECT 'run-1' AS run_id, 'tender_mix_daily' AS table_name, count(*) AS row_count FROM (SELECT DISTINCT CAST(o_orderdate AS DATE), o_orderpriority FROM orders)
UNION ALL SELECT 'run-1', 'marketing_cost_daily', count(*) FROM (SELECT DISTINCT json_extract_string(props, '$.k'), CAST(ts AS DATE) FROM events WHERE event_type = 'view')"""


@register(
    "S04",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""",
)
def s04_append_evolving(spark, sf):
    """Two appends to one folder, the second with a new column; read back
    with mergeSchema (the first load's rows get NULL for it)."""
    base = run_folder(spark, "s04") + "/orders"
    o = d.table(spark, sf, "orders")
    fs.append_evolving(o.where(F.col("o_orderstatus") == "F").drop("o_orderpriority"), base)
    fs.append_evolving(o.where(F.col("o_orderstatus") != "F"), base)
    return fs.read_evolving(spark, base).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@register("S05", ORACLES.get("W02"))
def s05_rewrite_table(spark, sf):
    """Replace a table's contents (deduped lineitem) by writing a new sibling
    version and reading it — the source being read is never overwritten."""
    from storelake.operators import windows

    li = d.table(spark, sf, "lineitem")
    new = windows.dedupe_earliest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return spark.read.parquet(fs.rewrite_table(new, run_folder(spark, "s05")))


def _envelopes(spark, sf):
    e = d.table(spark, sf, "events")
    return fs.encode_envelope(e, F.col("event_type"), ["event_id", "user_id", "value", "props"], "ts", F.concat(F.lit("T"), F.col("event_id").cast("string")))


@register("S06", "SELECT event_id, user_id, value, props, event_type, 'T' || CAST(event_id AS VARCHAR) AS trace_id, ts AS ingest_timestamp, '1.0' AS schema_version FROM events")
def s06_decode_envelope(spark, sf):
    """Envelope JSON (S07 of each event) decoded back to typed columns."""
    return fs.decode_envelope(_envelopes(spark, sf), "event_id long, user_id long, value double, props string")


@register("S07", None)
def s07_encode_envelope(spark, sf):
    """Row -> envelope JSON string."""
    return _envelopes(spark, sf)


@register("S08", "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS campaign_k FROM events")
def s08_json_mapping(spark, sf):
    """Declarative (column, $.path, type) extraction from the JSON payload."""
    return fs.apply_json_mapping(d.table(spark, sf, "events"), "props", [("campaign_k", "$.k", "int")])


@register("S09", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def s09_route_by_type(spark, sf):
    """Route rows to same-named tables (one partition per event type) in one
    write; counts per routed table."""
    base = run_folder(spark, "s09")
    d.table(spark, sf, "events").write.mode("overwrite").partitionBy("event_type").parquet(base)
    return spark.read.parquet(base).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@register("S10", "SELECT * FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def s10_unknown_events(spark, sf):
    """Events whose type has no typed mapping, kept whole."""
    return fs.unknown_events(d.table(spark, sf, "events"), "event_type", ["view", "click", "purchase"])


_CSV_COLS = ["c_custkey", "c_name", "c_mktsegment", "is_household"]


def _exported(spark, sf):
    c = d.table(spark, sf, "customer").withColumn("is_household", F.col("c_mktsegment") == "HOUSEHOLD")
    return fs.export_csv(c, _CSV_COLS, run_folder(spark, "s11") + "/customers_csv", partitions=4)


@register("S11", "SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS is_household FROM customer")
def s11_export_csv(spark, sf):
    """CSV export (header, RFC-4180 quoting, booleans 0/1, loaded_at), read back."""
    path = _exported(spark, sf)
    return spark.read.option("header", True).schema("c_custkey long, c_name string, c_mktsegment string, is_household int, loaded_at string").csv(path).drop("loaded_at")


@register("S13", ORACLES["S11"])
def s13_load_csv(spark, sf):
    """Staged load of the exported CSV with an explicit schema, contract order."""
    path = _exported(spark, sf)
    return fs.load_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string, is_household int, loaded_at timestamp", _CSV_COLS)


@register("S12", "SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS distinct_rows FROM lineitem")
def s12_chunked_write(spark, sf):
    """Deterministic hash-chunked export (the JDBC target is replaced by a
    file sink): all chunks together hold every row exactly once."""
    base = run_folder(spark, "s12")
    fs.chunked_write(d.table(spark, sf, "lineitem"), list(d.LINE_KEY), 4, base)
    x = spark.read.parquet(base)
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*d.LINE_KEY).alias("distinct_rows"))


@register(
    "S14",
    """SELECT 'o_totalprice' AS "column", 'mistyped' AS issue, 'decimal(19,4)' AS expected, 'double' AS found, count(*) AS rows,
  CAST(count_if(o_totalprice IS NULL) AS BIGINT) AS nulls, CAST(count_if(o_totalprice IS NOT NULL AND try_cast(o_totalprice AS DECIMAL(19,4)) IS NULL) AS BIGINT) AS lost FROM orders
UNION ALL SELECT 'o_orderpriority', 'mistyped', 'int', 'string', count(*), CAST(count_if(o_orderpriority IS NULL) AS BIGINT),
  CAST(count_if(o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS INTEGER) IS NULL) AS BIGINT) FROM orders
UNION ALL SELECT 'o_clerk', 'missing', 'string', NULL, count(*), count(*), 0 FROM orders""",
)
def s14_conform(spark, sf):
    """Contract check of orders: missing / mistyped columns and the values their casts would lose."""
    contract = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_totalprice", T.DecimalType(19, 4)),
        T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.IntegerType()), T.StructField("o_clerk", T.StringType()),
    ])
    _, report = fs.conform(d.table(spark, sf, "orders"), contract)
    return report


@register("S15", "SELECT * FROM events")
def s15_compact_and_cluster(spark, sf):
    """Rewrite events into files of a million rows, range-clustered on (user_id, ts)."""
    path = fs.compact_and_cluster(d.table(spark, sf, "events"), ["user_id", "ts"], 1_000_000, run_folder(spark, "s15"))
    return spark.read.parquet(path)


@register("S16", "SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def s16_retention(spark, sf):
    """7-day retention anchored to the data's latest timestamp."""
    return fs.apply_retention(d.table(spark, sf, "events"), "ts", 7)


@register("S20", "SELECT * FROM events")
def s20_landing(spark, sf):
    """Raw landing table: the event stream appended as-is with its own checkpoint."""
    from storelake.streaming.runner import run_to_table, table_stream

    return run_to_table(table_stream(spark, sf, "events"), "s20-landing")
