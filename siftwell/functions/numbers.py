"""Decimal rounding of doubles by their exact binary value, ties to even.

Spark's own rounding works on the shortest decimal text of a double, which
turns 36.035 (stored as 36.03499...) into 36.04. Here the product with the
power of ten is split into its rounded value and its exact error, so 36.03
comes out, as in printf.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = float(2**27 + 1)


def _scaled(value: Column, digits: int) -> Column:
    """|value| * 10^digits rounded to a BIGINT."""
    x, scale = F.abs(value), F.lit(float(10**digits))
    big = x * F.lit(_SPLIT)
    high = big - (big - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    side = (product - whole - F.lit(0.5)) + error
    up = F.when(side > 0, 1).when(side < 0, 0).otherwise(F.pmod(whole, F.lit(2)))
    return whole + up


def round_exact(value: Column, digits: int) -> Column:
    rounded = _scaled(value, digits) / F.lit(float(10**digits))
    return F.when(value < 0, -rounded).otherwise(rounded)


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals; null and NaN become ``n/a``."""
    x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    n, sign = _scaled(x, digits), F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    scale = F.lit(10**digits).cast("bigint")
    parts = [sign, F.floor((n - n % scale) / scale).cast("string")]
    if digits:
        parts += [F.lit("."), F.lpad((n % scale).cast("string"), digits, "0")]
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.concat(*parts))
