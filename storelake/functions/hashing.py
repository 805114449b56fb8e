"""Deterministic hashing and seeded draws.

Draws come from hashes of the row's own key, never from ``rand(seed)``, so a
re-run after a lost executor or under a different partitioning gives the same
rows. ``md5_unit`` is the portable form (the SQL oracle can compute it too);
``xxhash_unit`` is the faster JVM-native form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO52 = float(1 << 52)


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def xxhash_unit(cols: Sequence, seed: int = 0) -> Column:
    """Uniform [0, 1) from xxhash64(cols, seed)."""
    return F.pmod(F.xxhash64(*_cols(cols), F.lit(seed)), F.lit(1 << 52)).cast("double") / _TWO52


def md5_unit(cols: Sequence, seed: int = 0) -> Column:
    """Uniform [0, 1) from the first 52 bits of md5('seed|c1|c2...')."""
    txt = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in _cols(cols)])
    return F.conv(F.substring(F.md5(txt), 1, 13), 16, 10).cast("bigint").cast("double") / _TWO52


def md5_unit_sql(cols: Sequence[str], seed: int = 0) -> str:
    """The DuckDB expression equal to :func:`md5_unit`."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def seeded_sample(df, keys: Sequence, rate: float, seed: int = 0, portable: bool = True):
    """Keep rows whose hash draw is below ``rate`` (repeatable under any
    partitioning)."""
    u = md5_unit(keys, seed) if portable else xxhash_unit(keys, seed)
    return df.where(u < F.lit(rate))


def weighted_pick(u: Column, choices: Sequence[tuple[str, float]]) -> Column:
    """Inverse-CDF pick of a label from a [0,1) draw and (label, weight)
    pairs (weights are normalised)."""
    total = float(sum(w for _, w in choices))
    expr = None
    acc = 0.0
    for label, w in choices[:-1]:
        acc += w / total
        expr = (F.when(u < F.lit(acc), F.lit(label))) if expr is None else expr.when(u < F.lit(acc), F.lit(label))
    last = F.lit(choices[-1][0])
    return last if expr is None else expr.otherwise(last)


def alert_id(*cols) -> Column:
    """Deterministic sha256 id of the given columns."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in _cols(cols)]), 256)
