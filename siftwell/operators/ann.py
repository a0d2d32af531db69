"""Approximate dense search with a breadth knob: inverted file lists per tenant.

Each tenant's vectors are assigned to the nearest of a few centroids, trained on
a sample of bounded size; a query looks only into the ``nprobe`` lists whose
centroids are closest to it. Probing every list gives exactly the exact result,
and so does ``adaptive_search``, which goes on until no list can improve it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siftwell.operators.blocks import SCORE_DIGITS, BestOf
from siftwell.operators.ranking import (
    SLICE_BYTES,
    block_topk,
    document_side,
    listed_topk,
    measured_bytes,
    split_by_key,
    take_top,
    vector_bytes,
)
from siftwell.schema import require_columns
from siftwell.sources.collection import stored


def seed_centroids(points: DataFrame, per_tenant: int) -> DataFrame:
    """tenant_id, list_id, dense: the tenant's vectors with the smallest md5(id).

    Deterministic. Points without a vector seed no list, an id seeds one at most
    (of several vectors the smallest). Only distinct ids are ranked, and the
    literal rank bound lets Spark cut every task to ``per_tenant`` of them per
    tenant before the shuffle by tenant; the few vectors are fetched by a join.
    """
    if per_tenant < 1:
        raise ValueError("per_tenant must be at least 1")
    require_columns(points, "tenant_id", "id", "dense")
    order = Window.partitionBy("tenant_id").orderBy(F.md5(F.col("id").cast("string")))
    vectors = points.select("tenant_id", "id", "dense").where(F.col("dense").isNotNull())
    chosen = (
        vectors.select("tenant_id", "id")
        .where(F.col("tenant_id").isNotNull())
        .distinct()
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= per_tenant)
        .select("tenant_id", "id", (F.col("_n") - 1).cast("bigint").alias("list_id"))
    )
    seeds = vectors.join(chosen, ["tenant_id", "id"]).groupBy("tenant_id", "list_id")
    return seeds.agg(F.min("dense").alias("dense"))


#: Vectors of a tenant that its lists are trained on, and rounds of training.
SAMPLE, ROUNDS = 20_000, 4
#: Centroids are kept to this binary fraction, so the order of a sum has no effect.
_FRACTION = float(2**24)


def cosine_to(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors with centroids."""
    norm = np.sqrt(np.einsum("ij,ij->i", centroids, centroids))
    return rows @ centroids.T / np.where(norm == 0, 1.0, norm)


def lloyd(rows: np.ndarray, lists: int, rounds: int, nearness=cosine_to) -> np.ndarray:
    """Centroids after ``rounds``; the first ``lists`` rows are the seeds."""
    centroids = rows[:lists].copy()
    for _ in range(rounds):
        near = np.round(nearness(rows, centroids), SCORE_DIGITS)
        mine = near.argmax(axis=1)
        order = np.argsort(mine, kind="stable")
        taken, start = np.unique(mine[order], return_index=True)
        sums = np.add.reduceat(rows[order], start, axis=0)
        means = sums / np.diff(np.r_[start, len(rows)])[:, None]
        centroids[taken] = np.floor(means * _FRACTION + 0.5) / _FRACTION
        # Lists that nobody chose start again from the vectors farthest from their own.
        empty = np.setdiff1d(np.arange(len(centroids)), taken)
        far = np.argsort(near[np.arange(len(rows)), mine], kind="stable")[: len(empty)]
        centroids[empty] = rows[far]
    return centroids


def finite_vector(name: str = "dense"):
    return F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def train_centroids(points: DataFrame, per_tenant: int, rounds: int = ROUNDS, sample: int = SAMPLE) -> DataFrame:
    """tenant_id, list_id, dense: ``per_tenant`` centroids from rounds of Lloyd's algorithm.

    Trained on at most ``sample`` vectors of a tenant, those with the smallest
    md5(id), in one task each; the first of them are the seeds. Deterministic:
    sums run in one order and centroids are rounded to a binary fraction. Vectors
    that are null or not finite train nothing; tenants with fewer vectors than
    lists have a list for each.
    """
    if per_tenant < 1 or sample < per_tenant or rounds < 0:
        raise ValueError("needs per_tenant >= 1, sample >= per_tenant and rounds >= 0")
    chosen = seed_centroids(points.where(finite_vector()), sample)

    def train(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("list_id", "ascending")]))
        vectors = rows["dense"].combine_chunks()
        unit = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        norm = np.sqrt(np.einsum("ij,ij->i", unit, unit))
        found = lloyd(unit / np.where(norm == 0, 1.0, norm)[:, None], per_tenant, rounds)
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * np.int32(unit.shape[1]))
        lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
        names = pa.array([key[0].as_py()] * len(found), pa.string())
        return pa.Table.from_arrays([names, pa.array(np.arange(len(found))), lists], ["tenant_id", "list_id", "dense"])

    chosen = chosen.select(F.col("tenant_id").cast("string"), "list_id", F.col("dense").cast("array<double>").alias("dense"))
    return chosen.groupBy("tenant_id").applyInArrow(train, "tenant_id string, list_id bigint, dense array<double>")


def _as_documents(centroids: DataFrame) -> DataFrame:
    # negated ids turn "larger id first" of the dense order into "lower list first"
    return centroids.select("tenant_id", (-F.col("list_id")).alias("id"), "dense")


def _nearest(centroids: DataFrame, vectors: DataFrame, k: int, **plan) -> DataFrame:
    """tenant_id, query_id, list_id, rank of the k closest lists; ties to the lower list."""
    best = block_topk(_as_documents(centroids), vectors, k, ("dense",), **plan)
    return take_top(best, k).select(
        "tenant_id", "query_id", (-F.col("id")).alias("list_id"), "rank"
    )


def _closest_list(spark: SparkSession, lists: pa.Table):
    """Arrow UDF (tenant_id, dense) -> list_id over centroids held by every worker."""
    shared = spark.sparkContext.broadcast(lists)

    @F.arrow_udf("bigint")
    def closest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        by_tenant = dict(split_by_key(shared.value, ["tenant_id"]))
        for tenant, dense in batches:
            found = np.zeros(len(tenant), dtype=np.int64)
            known = np.zeros(len(tenant), dtype=bool)
            rows = pa.table(
                {"tenant_id": tenant, "query_id": np.arange(len(tenant)), "dense": dense}
            )
            for key, part in split_by_key(rows, ["tenant_id"]):
                if key in by_tenant:
                    best = BestOf(part, ("dense",), 1)
                    best.add(by_tenant[key])
                    for table in best.tables():
                        at = table["query_id"].to_numpy()
                        found[at], known[at] = -table["id"].to_numpy(), True
            yield pa.array(found, mask=~known)

    return closest(F.col("tenant_id"), F.col("dense"))


def assign_lists(
    points: DataFrame, centroids: DataFrame, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Add ``list_id``, the closest centroid of the point's tenant (null without one).

    Centroids are cut into slices of bounded bytes, whole tenants each; a slice
    is held by every worker and its tenants' points are assigned where they are
    read.
    """
    lists = document_side(_as_documents(centroids), ("tenant_id",), ("dense",))
    slices = max(1, -(-measured_bytes(lists, vector_bytes(("dense",))) // slice_bytes))

    def number(column: str):
        text = F.coalesce(F.col(column).cast("string"), F.lit(""))
        return F.pmod(F.xxhash64(text), F.lit(slices))

    parts = []
    for i in range(slices):
        held = lists.where(number("tenant_id") == i).toArrow()
        mine = points if slices == 1 else points.where(number("tenant_id") == i)
        parts.append(mine.withColumn("list_id", _closest_list(points.sparkSession, held)))
    return reduce(DataFrame.union, parts)


def probe_lists(queries: DataFrame, centroids: DataFrame, nprobe: int, **plan) -> DataFrame:
    """tenant_id, query_id, list_id, rank: the ``nprobe`` lists each query looks into.

    Stored, because both the scored queries and the list ranks are read from it.
    """
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    return stored(_nearest(centroids, queries, nprobe, **plan))


def write_lists(points: DataFrame, centroids: DataFrame, path: str) -> None:
    """Store the points by tenant and list; a search then reads the probed lists only."""
    listed = assign_lists(points, centroids).hint("rebalance", "tenant_id", "list_id")
    listed.write.mode("overwrite").partitionBy("tenant_id", "list_id").parquet(path)


def _probed_candidates(listed, queries, probes, k, **plan) -> DataFrame:
    """Best k of the probed lists or a superset, with the list's rank for the query."""
    best = listed_topk(listed, queries, probes, k, **plan)
    best = best.withColumn("list_id", F.col("list_id").cast("bigint"))
    # a row per query and list: small as a file, large as a broadcast through the driver
    ranks = probes.withColumnRenamed("rank", "list_rank").hint("merge")
    return best.join(ranks, ["tenant_id", "query_id", "list_id"])


def _listed(points: DataFrame, centroids: DataFrame) -> DataFrame:
    return points if "list_id" in points.columns else assign_lists(points, centroids)


def ivf_search(
    points: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    nprobe: int = 8,
    limit: int = 10,
    **plan,
) -> DataFrame:
    """Approximate dense top ``limit`` from the ``nprobe`` closest lists.

    Points that already carry ``list_id`` (stored after ``assign_lists``) are
    used as they are.
    """
    return take_top(ivf_candidates(points, queries, centroids, nprobe, limit, **plan), limit)


def ivf_candidates(
    points: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int, limit: int, **plan
) -> DataFrame:
    """A superset of the hits of ``ivf_search``, which ``take_top`` cuts."""
    probes = probe_lists(queries, centroids, nprobe, **plan)
    found = _probed_candidates(_listed(points, centroids), queries, probes, limit, **plan)
    return found.drop("list_id", "list_rank")


def breadth_values(*values: int) -> list[int]:
    """Sorted distinct breadths of a sweep."""
    if not values or min(values) < 1:
        raise ValueError("breadths must be at least 1")
    return sorted(set(values))


def ivf_sweep(
    points: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    breadths: list[int],
    limit: int = 10,
    **plan,
) -> DataFrame:
    """Hits for several breadths from one scoring pass at the largest.

    A candidate found in the r-th closest list belongs to every breadth >= r.
    """
    breadths = breadth_values(*breadths)
    probes = probe_lists(queries, centroids, breadths[-1], **plan)
    found = _probed_candidates(_listed(points, centroids), queries, probes, limit, breadths=breadths, **plan)
    covered = F.filter(F.lit(breadths), lambda n: n >= F.col("list_rank"))
    found = found.withColumn("nprobe", F.explode(covered))
    return take_top(found, limit, by=("nprobe", "tenant_id", "mode", "query_id")).drop(
        "list_id", "list_rank"
    )


def cosine(left: str, right: str):
    """Arrow UDF: cosine of two vector columns, NaN where it has none."""

    @F.arrow_udf("double")
    def of_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            a, b = (x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in (a, b))
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                norm = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
                yield pa.array(np.einsum("ij,ij->i", a, b) / np.where(norm == 0, 1.0, norm))

    return of_batches(F.col(left), F.col(right))


def list_radii(listed: DataFrame, centroids: DataFrame) -> DataFrame:
    """tenant_id, list_id, radius: the largest angle between a list's centroid and a member.

    A member without an angle makes the radius pi: nothing is known of the list.
    """
    members = listed.where(F.col("dense").isNotNull() & F.col("list_id").isNotNull())
    members = members.select(
        F.col("tenant_id").cast("string").alias("tenant_id"), F.col("list_id").cast("bigint").alias("list_id"),
        F.col("dense").cast("array<double>").alias("dense"),
    )
    hubs = centroids.select("tenant_id", "list_id", F.col("dense").alias("_centroid"))
    angles = members.join(hubs, ["tenant_id", "list_id"]).withColumn("_cos", cosine("dense", "_centroid"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl("_cos", F.lit(-1.0)))))
    return angles.groupBy("tenant_id", "list_id").agg(F.max(angle).alias("radius"))


#: Angles and scores are rounded differently; a list this close to the bound is read.
_SLACK = 1e-6


def adaptive_probes(
    listed: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int, limit: int, **plan
) -> tuple[DataFrame, DataFrame]:
    """Best ``limit`` of the ``nprobe`` closest lists, and the lists that may still improve them.

    By the triangle inequality of angles no member of a list is closer to a query
    than the centroid less the list's radius; a list beyond the ``limit``-th hit
    holds nothing better.
    """
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    most = centroids.groupBy("tenant_id").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("n")).first()["n"]
    ranked = take_top(block_topk(_as_documents(centroids), queries, int(most), ("dense",), **plan), int(most))
    ranked = stored(ranked.select("tenant_id", "query_id", (-F.col("id")).alias("list_id"), "rank", "score"))
    first = ranked.where(F.col("rank") <= nprobe).select("tenant_id", "query_id", "list_id", "rank")
    found = take_top(_probed_candidates(listed, queries, first, limit, **plan), limit)
    found = stored(found.drop("list_id", "list_rank"))
    full = found.where(F.col("rank") == limit).select("tenant_id", "query_id", F.col("score").alias("bound"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))
    best = F.cos(F.greatest(F.lit(0.0), angle - F.col("radius")))
    rest = ranked.where(F.col("rank") > nprobe).join(list_radii(listed, centroids), ["tenant_id", "list_id"])
    rest = rest.join(full, ["tenant_id", "query_id"], "left")
    # No bound yet, or a similarity that is not a number: the list has to be read.
    open_ = F.coalesce(best + _SLACK >= F.col("bound"), F.lit(True))
    return found, stored(rest.where(open_).select("tenant_id", "query_id", "list_id", "rank"))


def adaptive_search(
    points: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int = 8, limit: int = 10, **plan
) -> DataFrame:
    """The exact dense top ``limit``, reading lists only as long as they can matter.

    First the ``nprobe`` closest lists, then every list whose radius reaches the
    hits so far.
    """
    listed = _listed(points, centroids)
    found, rest = adaptive_probes(listed, queries, centroids, nprobe, limit, **plan)
    more = _probed_candidates(listed, queries, rest, limit, **plan)
    columns = ["tenant_id", "mode", "query_id", "id", "score"]
    return take_top(found.select(*columns).unionByName(more.select(*columns)), limit)


def lists_read(
    points: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int = 8, limit: int = 10, **plan
) -> DataFrame:
    """tenant_id, query_id, lists, lists_read of ``adaptive_search``."""
    _, rest = adaptive_probes(_listed(points, centroids), queries, centroids, nprobe, limit, **plan)
    further = rest.groupBy("tenant_id", "query_id").agg(F.count(F.lit(1)).alias("_more"))
    sizes = centroids.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("lists"))
    asked = queries.select(F.col("tenant_id").cast("string").alias("tenant_id"), "query_id")
    read = F.least(F.lit(nprobe), "lists") + F.coalesce("_more", F.lit(0))
    return asked.join(sizes, "tenant_id").join(further, ["tenant_id", "query_id"], "left").select(
        "tenant_id", "query_id", "lists", read.cast("bigint").alias("lists_read")
    )
