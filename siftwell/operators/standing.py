"""Rankings of standing queries, kept up to date from the changed points alone.

A stored ranking holds, per query, the best ``depth`` documents of the
collection, and a mark whether they are all that the query can find. When points
change, their old entries go, and the changed points are ranked among the rest.
What no entry says is how unchanged documents below the last entry rank; they
were all worse than it. So the first ``limit`` of the new list are certain as
long as none of them is worse than the old last entry. Only queries of which
that cannot be said are asked again (refill); the reserve ``depth - limit`` makes
them rare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwell.operators.ranking import exact_topk, take_top
from siftwell.sources.collection import stored

KEY = ["tenant_id", "query_id"]
ENTRY = [*KEY, "id", "score", "rank", "whole"]


def _ranked(points: DataFrame, queries: DataFrame, depth: int, mode: str) -> DataFrame:
    """The best ``depth`` of every query; ``whole`` says that there are no others."""
    found = exact_topk(points, queries, depth, (mode,)).select(*KEY, "id", "score", "rank")
    sizes = F.count(F.lit(1)).over(Window.partitionBy(*KEY))  # at most ``depth`` rows each
    return found.withColumn("whole", sizes < depth)


def start_ranking(points: DataFrame, queries: DataFrame, depth: int, mode: str = "dense") -> DataFrame:
    """tenant_id, query_id, id, score, rank, whole: the first ranking, stored."""
    return stored(_ranked(points, queries, depth, mode))


def _place(score: str, id_: str, mode: str) -> Column:
    """A value that is larger for better entries."""
    return F.struct(F.col(score).alias("s"), (F.col(id_) if mode == "dense" else -F.col(id_)).alias("i"))


def update_ranking(
    ranking: DataFrame,
    changed: DataFrame,
    removed: DataFrame,
    current: DataFrame,
    queries: DataFrame,
    limit: int,
    depth: int,
    mode: str = "dense",
) -> tuple[DataFrame, DataFrame]:
    """The new ranking, stored, and the queries (tenant_id, query_id) that were asked again.

    ``changed`` are the new versions of points (an id once), ``removed`` the ids
    that are gone; together they name every id whose old entries are void, also
    of ids that moved to another tenant. ``current`` is the collection after the
    change; it is read for the queries that are asked again, and for no other.
    Entries without a score (a similarity that is not a number) are asked again.
    """
    if not 1 <= limit <= depth:
        raise ValueError("needs 1 <= limit <= depth")
    void = changed.select("id").unionByName(removed.select("id")).distinct()
    last = F.min(_place("score", "id", mode)).alias("_last")
    bound = ranking.where("NOT whole").groupBy(*KEY).agg(last)
    kept = ranking.join(void, "id", "left_anti").select(*KEY, "id", "score")
    fresh = exact_topk(changed, queries, depth, (mode,)).select(*KEY, "id", "score")
    both = kept.unionByName(fresh).withColumn("mode", F.lit(mode))
    sizes = both.groupBy(*KEY).agg((F.count(F.lit(1)) > depth).alias("_more"))
    merged = take_top(both, depth).join(sizes, KEY).join(bound, KEY, "left")
    # Entries below the old bound may have unknown ones before them: the list ends there.
    sure = merged.where(F.col("_last").isNull() | (_place("score", "id", mode) >= F.col("_last")))
    whole = F.col("_last").isNull() & ~F.col("_more")
    sure = stored(sure.select(*KEY, "id", "score", "rank", whole.alias("whole")))
    counts = sure.where(F.col("score").isNotNull()).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_sure"))
    short = bound.join(counts, KEY, "left").where(F.coalesce("_sure", F.lit(0)) < limit)
    again = stored(short.select(*KEY))
    refilled = _ranked(current, queries.join(again, KEY, "left_semi"), depth, mode)
    return stored(sure.join(again, KEY, "left_anti").unionByName(refilled.select(*ENTRY))), again


def best_of(ranking: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of every query."""
    return ranking.where(F.col("rank") <= limit)
