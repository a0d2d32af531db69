"""Quantiles from stored, mergeable sketches: one KLL state per mode and hour.

A state has a bounded size whatever it has seen, and states merge without loss
of their guarantee: the latencies of any span of hours are read from its states,
not from the log. Late rows of an hour are a further state of it. The rank of a
returned value is off by at most about ``2.3 / k`` of the count (k = 400: half a
percent); ``exact_percentiles`` has the exact values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

K = 400


def latency_states(log: DataFrame, k: int = K) -> DataFrame:
    """mode, hour (epoch seconds), state, n of ``mode, ts, latency_ms`` rows.

    Latencies that are null or not a number are not counted; a null mode is a
    mode of its own.
    """
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    hour = (seconds - F.pmod(seconds, F.lit(3600))).alias("hour")
    value = F.col("latency_ms").cast("double")
    rows = log.select("mode", hour, value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    states = rows.groupBy("mode", "hour").agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("state"))
    return states.withColumn("n", F.kll_sketch_get_n_double("state"))


def append_states(log: DataFrame, path: str, k: int = K) -> None:
    """Add the states of a batch of the log to the table in ``path``, a folder per day."""
    day = F.col("hour") - F.pmod("hour", F.lit(86_400))
    states = latency_states(log, k).withColumn("day", day).hint("rebalance", "day")
    states.write.mode("append").partitionBy("day").parquet(path)


def read_states(spark, path: str, after: int | None = None, before: int | None = None) -> DataFrame:
    """States of the hours that start in ``after`` .. ``before``, both included."""
    states = spark.read.schema("mode string, hour bigint, state binary, n bigint, day bigint").parquet(path)
    if after is not None:
        states = states.where((F.col("hour") >= after) & (F.col("day") > after - 86_400))
    if before is not None:
        states = states.where((F.col("hour") <= before) & (F.col("day") <= before))
    return states.drop("day")


def merged_quantiles(states: DataFrame, named: dict[str, float], k: int = K) -> DataFrame:
    """mode, n and one column per named fraction, from the states alone."""
    if not named or not all(0.0 <= f <= 1.0 for f in named.values()):
        raise ValueError("fractions must be in 0..1")
    merged = states.groupBy("mode").agg(F.kll_merge_agg_double("state", F.lit(k)).alias("state"), F.sum("n").alias("n"))
    picks = [F.kll_sketch_get_quantile_double("state", F.lit(f)).alias(name) for name, f in named.items()]
    return merged.select("mode", "n", *picks)


def rank_errors(log: DataFrame, quantiles: DataFrame, named: dict[str, float]) -> DataFrame:
    """mode, n and per fraction how far the value's rank is off, as a share of the count.

    Equal values have a span of ranks; the nearest of them counts.
    """
    values = quantiles.select(F.struct("mode").alias("_m"), *named)
    rows = log.select(F.struct("mode").alias("_m"), F.col("latency_ms").cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v")).join(values, "_m")
    ends = [
        F.sum(test.cast("bigint")).alias(f"_{kind}_{name}")
        for name in named
        for kind, test in (("under", F.col("_v") < F.col(name)), ("upto", F.col("_v") <= F.col(name)))
    ]
    counted = rows.groupBy("_m").agg(F.count(F.lit(1)).alias("n"), *ends)
    errors = [
        (F.greatest(F.lit(0.0), F.col(f"_under_{name}") - f * F.col("n"), f * F.col("n") - F.col(f"_upto_{name}")) / F.col("n")).alias(name)
        for name, f in named.items()
    ]
    return counted.select("_m.mode", "n", *errors)
