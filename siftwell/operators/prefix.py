"""Running totals and consecutive numbering that survive one huge group.

A plain window per tenant sorts a tenant in one task. Here the table is range
partitioned by (key, order) and stored with the number of its partition; totals
per partition are few, their running sum gives each partition its offset, and
the detail window works partition by partition. The ranges are drawn from the
data, so dense and hashed order values are cut alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwell.sources.collection import stored


def running_total(
    df: DataFrame, key: str, order: str, value: Column, name: str, parts: int | None = None
) -> DataFrame:
    """Add the inclusive running sum of ``value`` per ``key`` in ``order``.

    ``order`` is unique per key. A null key is a key of its own, a null order
    comes first. ``parts`` defaults to the session's shuffle partitions.
    """
    by = [F.col(key), F.col(order)]
    spread = df.repartitionByRange(*([parts] if parts else []), *by)
    # A struct equals another with a null in it, so null keys meet in joins.
    ranged = stored(
        spread.withColumns(
            {"_v": value, "_r": F.spark_partition_id(), "_k": F.struct(F.col(key).alias("k"))}
        )
    )
    totals = ranged.groupBy("_k", "_r").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_k", "_r", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_k", "_r").orderBy(order)
    so_far = F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        ranged.withColumn(name, so_far)
        .join(offsets, ["_k", "_r"])
        .withColumn(name, F.col(name) + F.col("_o"))
        .drop("_v", "_r", "_o", "_k")
    )


def with_batch_numbers(
    df: DataFrame, size: int, key: str = "tenant_id", order: str = "id"
) -> DataFrame:
    """Consecutive batches of ``size`` rows per key; the last one may be short."""
    if size < 1:
        raise ValueError("size must be at least 1")
    numbered = running_total(df, key, order, F.lit(1), "_n")
    return numbered.withColumn(
        "batch_no", F.floor((F.col("_n") - 1) / F.lit(size)).cast("bigint")
    ).drop("_n")


def batch_counts(batched: DataFrame, key: str = "tenant_id") -> DataFrame:
    return batched.groupBy(key, "batch_no").agg(F.count(F.lit(1)).alias("n"))


def running_counts(batched: DataFrame, key: str = "tenant_id") -> DataFrame:
    """Rows ingested per key up to and including each batch."""
    counts = batch_counts(batched, key)
    return running_total(counts, key, "batch_no", F.col("n"), "total")
