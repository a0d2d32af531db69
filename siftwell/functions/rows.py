"""Turn arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(df: DataFrame, keep, array: Column, name: str) -> DataFrame:
    """One row per array element; rows with an empty array disappear.

    A plain explode makes the optimizer add a "size > 0" filter below it, which
    computes the array (tokenizing, hashing) a second time. The outer form
    followed by a null check on its output computes it once.
    """
    out = df.select(*keep, F.explode_outer(array).alias(name))
    return out.where(F.col(name).isNotNull())
