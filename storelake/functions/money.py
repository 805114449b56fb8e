"""Money expressions: integer cents are the truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def to_cents(x) -> Column:
    """round(x * 100) as bigint."""
    return F.round(_c(x) * 100).cast("bigint")


def cents_to_decimal(c) -> Column:
    """Cents / 100 as decimal(19,4) (exact, integer division by 100)."""
    return (_c(c).cast("decimal(19,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(19,4)")


def cents_to_text(c) -> Column:
    """P08: '%.2f' text of cents (exact: integer part and two-digit remainder)."""
    c = _c(c)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(c)
    return F.concat(sign, F.floor(a / 100).cast("string"), F.lit("."), F.lpad(F.pmod(a, F.lit(100)).cast("string"), 2, "0"))


# Tax multiplier per taxability class (basis points x multiplier / 10^6).
TAX_MULTIPLIER = {"TAXABLE": 100, "REDUCED": 50, "EXEMPT": 0}


def taxability_multiplier(taxability) -> Column:
    t = _c(taxability)
    return F.when(t == "TAXABLE", F.lit(100)).when(t == "REDUCED", F.lit(50)).when(t == "EXEMPT", F.lit(0)).otherwise(F.lit(100))


def line_tax_cents(ext_cents, rate_bps, multiplier) -> Column:
    """floor((ext_cents * rate_bps * multiplier + 500000) / 1000000), exact
    integer arithmetic (round half up of ext * bps/10^4 * mult/100)."""
    num = _c(ext_cents).cast("bigint") * _c(rate_bps).cast("bigint") * _c(multiplier).cast("bigint") + F.lit(500000)
    # floor division on integers: subtract the remainder first so the
    # division is exact (no double rounding of large products).
    return ((num - F.pmod(num, F.lit(1000000))) / F.lit(1000000)).cast("bigint")


def percent_discount_cents(ext_cents, pct) -> Column:
    """Percent discount in cents, half up, never below 0 and never above
    the line amount."""
    raw = F.floor(_c(ext_cents) * _c(pct) / 100 + F.lit(0.5)).cast("bigint")
    return F.least(F.greatest(F.lit(0).cast("bigint"), raw), _c(ext_cents).cast("bigint"))


def bogo_discount_cents(unit_cents, quantity) -> Column:
    """Buy-one-get-one: every second unit free."""
    return (F.floor(_c(quantity) / 2) * _c(unit_cents)).cast("bigint")
