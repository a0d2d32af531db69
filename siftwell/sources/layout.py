"""A layout for two conditions at once: rows along a Z-order curve of category and time.

Sorted by time alone, a condition on the category skips nothing, and the other
way round. Along the curve every stretch of rows is a rectangle of few
categories and a short time, so row groups have tight bounds in both columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits per dimension.
BITS = 12


def _spread(value: Column) -> Column:
    """The low 16 bits with a zero after each."""
    x = value.bitwiseAND(F.lit(0xFFFF)).cast("bigint")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def z_value(first: Column, second: Column) -> Column:
    """Bits of two cell numbers under 2**16 taken in turn, the first number's leading."""
    return F.shiftleft(_spread(first), 1).bitwiseOR(_spread(second))


def _cell(name: str, low: Column, high: Column) -> Column:
    """Cell of a value between two ends; null in the first one."""
    share = (F.col(name) - low) / F.greatest(high - low, F.lit(1))
    last = (1 << BITS) - 1
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(last), F.floor(share * (last + 1)))), F.lit(0)).cast("int")


def z_ordered(points: DataFrame, category: str = "category", time: str = "created_at", tenant: str = "tenant_id") -> DataFrame:
    """The rows by tenant, each tenant's along the curve; a drop-in for the order of a collection.

    Categories have no order that matters: a hash gives them cells. Times have
    cells of equal width between the table's first and last, read beforehand.
    """
    ends = points.agg(F.min(time).alias("low"), F.max(time).alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    cell = F.pmod(F.xxhash64(category), F.lit(1 << BITS)).cast("int")
    curve = z_value(cell, _cell(time, low, high))
    dealt = points.withColumn("_z", curve).hint("rebalance", tenant)
    return dealt.sortWithinPartitions(tenant, "_z", category, time).drop("_z")
