"""Reciprocal rank fusion of several rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftwell.functions.vectors import reciprocal_rank
from siftwell.operators.ranking import take_top


def fuse_rankings(
    ranked: DataFrame, limit: int, prefetch_limit: int = 50, k0: int = 60
) -> DataFrame:
    """Fuse the branches of (tenant_id, query_id): sum of 1 / (k0 + rank).

    Each branch counts with its first ``prefetch_limit`` ranks; a branch that
    does not list a document adds nothing. Ties go to the smaller id.
    """
    fused = (
        ranked.where(F.col("rank") <= prefetch_limit)
        .groupBy("tenant_id", "query_id", "id")
        .agg(F.sum(reciprocal_rank(F.col("rank"), k0)).alias("score"))
        .withColumn("mode", F.lit("hybrid"))
    )
    return take_top(fused, limit)


def with_fused_rows(ranked: DataFrame, prefetch_limit: int = 50, k0: int = 60) -> DataFrame:
    """The rows of every branch plus the fused ones as mode ``hybrid``, unranked.

    Each ranked row becomes itself and its share of the fused score, so the
    ranking below is computed once (a union of two filters would plan it twice).
    """
    own = F.struct(F.col("mode").alias("mode"), F.col("score").alias("score"))
    share = F.struct(
        F.lit("hybrid").alias("mode"), reciprocal_rank(F.col("rank"), k0).alias("score")
    )
    rows = F.when(F.col("rank") <= prefetch_limit, F.array(own, share)).otherwise(F.array(own))
    return (
        ranked.select("tenant_id", "query_id", "id", F.explode(rows).alias("_r"))
        .groupBy("tenant_id", "query_id", "id", F.col("_r.mode").alias("mode"))
        .agg(F.sum("_r.score").alias("score"))
    )
