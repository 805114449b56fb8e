"""Shared helpers for named queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 4


def finish(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Final presentation: session timestamps as timestamp_ntz; with
    ``digits``, doubles rounded (used where a double aggregate depends on
    summation order; exact cent arithmetic is left unrounded so it matches
    bit for bit)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and digits is not None:
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double") if digits is None else F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# DuckDB role views (independent SQL used only by the oracles).
# ---------------------------------------------------------------------------
SQL_RECEIPTS = """(SELECT o_orderkey AS receipt_id, o_custkey AS customer_id, o_orderdate AS event_ts,
  CAST(o_orderdate AS DATE) AS event_date, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
  o_orderpriority AS tender_type, o_orderstatus AS status FROM orders)"""

SQL_RECEIPTS_STORE = """(SELECT o_orderkey AS receipt_id, o_custkey AS customer_id, o_orderdate AS event_ts,
  CAST(o_orderdate AS DATE) AS event_date, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
  o_orderpriority AS tender_type, o_orderstatus AS status, CAST(c_nationkey AS BIGINT) AS store_id
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SQL_LINES = """(SELECT l_orderkey AS receipt_id, l_linenumber AS line_num, l_partkey AS product_id,
  l_suppkey AS store_id, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_cents,
  CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_cents,
  l_discount AS discount, l_tax AS tax_rate,
  CASE WHEN l_discount > 0 THEN 'D' || CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) END AS promo_code,
  CASE WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'SALE' END AS receipt_type,
  l_linestatus AS line_status, l_shipdate AS event_ts, CAST(l_shipdate AS DATE) AS event_date FROM lineitem)"""

SQL_EVENTS = """(SELECT event_id, ts, user_id, event_type, value, props,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

SQL_LEDGER = """(SELECT l_suppkey AS store_id, l_partkey AS product_id, l_shipdate AS event_ts,
  concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS txn_id,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS qty,
  l_returnflag AS reason FROM lineitem)"""


def scalar(df: DataFrame, expr):
    """One aggregate value to the driver (a parameter such as ``as_of``), so
    later filters become literals that reach the parquet scan."""
    return df.agg(expr.alias("v")).first()["v"]


def ts_lit(v) -> "F.Column":
    return F.lit(v).cast("timestamp_ntz")


SQL_DAILY_DEPT = """(SELECT p_type AS department, CAST(l_shipdate AS DATE) AS sale_date,
  CAST(sum(l_quantity) AS BIGINT) AS units, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

SQL_DENSE_DEPT = f"""(SELECT g.department, g.sale_date, coalesce(s.units, 0) AS units, coalesce(s.revenue_cents, 0) AS revenue_cents
  FROM (SELECT department, CAST(unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY)) AS DATE) AS sale_date
        FROM {SQL_DAILY_DEPT} GROUP BY department) g
  LEFT JOIN {SQL_DAILY_DEPT} s ON g.department = s.department AND g.sale_date = s.sale_date)"""


def nullable_ids_as_double(df: DataFrame, cols) -> DataFrame:
    """Output form for nullable integer ids: doubles keep NULL as NaN and
    survive any collection path (pandas turns nullable integers into floats)."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
