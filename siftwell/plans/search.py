"""Dense, sparse and hybrid search for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftwell.functions.numbers import fixed, round_exact
from siftwell.operators.ann import ivf_candidates
from siftwell.operators.fuse import fuse_rankings, with_fused_rows
from siftwell.operators.idf import idf_table, weight_queries
from siftwell.operators.ranking import by_query, take_top, topk_candidates
from siftwell.schema import MODES, require_columns

HIT_KEYS = ["tenant_id", "query_id", "id"]


def _branches(mode: str) -> tuple[str, ...]:
    if mode not in MODES:
        raise ValueError(f"no search mode {mode!r}; known are {', '.join(MODES)}")
    return ("dense", "sparse") if mode == "hybrid" else (mode,)


def search(
    points: DataFrame,
    queries: DataFrame,
    mode: str = "hybrid",
    limit: int = 10,
    prefetch_limit: int = 50,
    rrf_k0: int = 60,
    idf: DataFrame | None = None,
    idf_scope: str = "collection",
    documents: Column | None = None,
    centroids: DataFrame | None = None,
    nprobe: int | None = None,
    points_stored: bool = False,
    **plan,
) -> DataFrame:
    """tenant_id, mode, query_id, id, score, rank for every query.

    With ``nprobe`` the dense branch looks only into the ``nprobe`` inverted
    lists (of ``centroids``) closest to the query.

    ``points`` and ``queries`` carry ``dense`` and/or ``sparse`` vectors. Every
    query is answered from its own tenant only: the tenant comes from the query
    row and is part of every comparison, so it cannot be left out. Optional
    query columns ``category_filter``, ``created_after``, ``created_before``
    narrow single queries; ``documents`` is a condition for all of them, applied
    to the scan before ranking.
    """
    branches = _branches(mode)
    require_columns(points, "tenant_id", "id", *branches)
    require_columns(queries, "tenant_id", "query_id", *branches)
    if "sparse" in branches:
        queries = weight_queries(queries, idf if idf is not None else idf_table(points, idf_scope))
    if documents is not None:
        points = points.where(documents)
    depth = prefetch_limit if mode == "hybrid" else limit
    if nprobe is not None and "dense" in branches:
        if centroids is None:
            raise ValueError("nprobe needs centroids")
        found = ivf_candidates(points, queries, centroids, nprobe, depth, **plan)
        if mode == "hybrid":
            found = found.unionByName(topk_candidates(points, queries, depth, ("sparse",), points_stored=points_stored, **plan))
    else:
        found = topk_candidates(points, queries, depth, branches, points_stored=points_stored, **plan)
    if mode != "hybrid":
        return take_top(found, depth)
    return fuse_rankings(take_top(by_query(found), depth), limit, prefetch_limit, rrf_k0)


def search_modes(
    points: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    prefetch_limit: int = 50,
    rrf_k0: int = 60,
    idf: DataFrame | None = None,
    idf_scope: str = "collection",
    **plan,
) -> DataFrame:
    """The hits of all three modes, from a single pass over the points."""
    queries = weight_queries(queries, idf if idf is not None else idf_table(points, idf_scope))
    depth = max(limit, prefetch_limit)
    ranked = take_top(by_query(topk_candidates(points, queries, depth, ("dense", "sparse"), **plan)), depth)
    return take_top(with_fused_rows(ranked, prefetch_limit, rrf_k0), limit)


def limit_per_query(hits: DataFrame, queries: DataFrame, k: Column) -> DataFrame:
    """Keep each query's own number of hits; ``k`` is over the query columns."""
    limits = queries.select("tenant_id", "query_id", k.alias("_k"))
    return hits.join(limits, ["tenant_id", "query_id"]).where(F.col("rank") <= F.col("_k")).drop("_k")


def with_payload(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Fetch text and category of the hits only; missing values become ''."""
    payload = documents.select(
        "tenant_id",
        "id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("category", F.lit("")).alias("category"),
    )
    return hits.join(payload, ["tenant_id", "id"])


def display_line(width: int = 70) -> Column:
    """One printed line per hit: score, category, start of the text."""
    category = F.concat(F.lit("["), F.col("category"), F.lit("]"))
    return F.concat_ws("  ", fixed(F.col("score"), 4), category, F.substring("text", 1, width))


def response_row() -> list[Column]:
    return [
        F.col("text").alias("content"),
        round_exact(F.col("score"), 4).alias("score"),
        F.col("category"),
    ]
