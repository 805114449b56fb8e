"""Every query with an oracle agrees with DuckDB at sf0.001 (the driver's
gate runs the same comparison at sf0.01)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from storelake.sources.driver import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, str):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if hasattr(v, "hour") and v.hour == 0 and v.minute == 0 and v.second == 0 and v.microsecond == 0:
        return str(v)[:10]
    return str(v)


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("qid", sorted(ORACLES))
def test_matches_duckdb(spark, con, qid):
    s = entry.queries()[qid](spark, SF).toPandas()
    d = con.execute(ORACLES[qid]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert _rows(s) == _rows(d)
