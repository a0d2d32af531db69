"""Exact top-k by inner product with pivot tables.

Components become ``floor(256 * x)``. Queries are dealt to slices and
candidates to blocks of bounded size, and every (slice, block) is one task:
candidates are copied once per slice, queries once per block. Inside, the
Euclidean distances of all vectors to the pivots are computed once. For a query
the largest difference of two pivot distances is a lower bound of its distance
to a candidate, hence an upper bound of their inner product
``(|q|^2 + |c|^2 - d^2) / 2``. Candidates are evaluated in the order of that
bound until the k-th best score is above every bound that is left. The best k
of each task are ranked per query.

Vectors that are null or hold null, NaN or infinite components take no part,
nor do rows with a null id. Rows equal in id and vector count once; a query
never meets a row of its own id. Of several vectors under one query id each is
a query of its own and the result holds the best k of them all, ties by id,
one row per candidate id. Vectors of another length than the first pivot raise
an error. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftwell.llm.shared import shared_folder, table, written

SCALE = 256
K = 5
PIVOTS = 24
SLICE, BLOCK = 8192, 32_768
_STEP = 256


def quantized(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v``: integer components of the vectors that take part, each row once."""
    x = F.col(vector_column)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & whole)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.select(F.col(id_column).alias("id"), scaled.alias("v")).distinct()


def bounded_best(q, c, q_ids, c_ids, pivots, k: int) -> list[tuple]:
    """(query row, candidate row, score) of the best k candidates of each query."""

    def to_pivots(x):
        squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
        return np.sqrt(squares.astype(np.float64)), (x * x).sum(1).astype(np.float64)

    (dq, nq), (dc, nc) = to_pivots(q), to_pivots(c)
    out = []
    for i in range(len(q)):
        apart = np.zeros(len(c))
        for p in range(len(pivots)):
            np.maximum(apart, np.abs(dc[:, p] - dq[i, p]), out=apart)
        bound = (nq[i] + nc - apart * apart) / 2
        bound += 1e-9 * (nq[i] + nc) + 1e-6  # rounding of the distances
        bound[c_ids == q_ids[i]] = -np.inf
        order = np.argsort(-bound)
        best = np.empty((0, 3), np.int64)  # score, -id, row
        step = _STEP
        at = 0
        while at < len(order) and np.isfinite(bound[order[at]]):
            if len(best) == k and best[-1, 0] > bound[order[at]]:
                break
            rows = order[at : at + step]
            rows = rows[np.isfinite(bound[rows])]
            more = np.stack([c[rows] @ q[i], -c_ids[rows], rows], axis=1)
            best = np.concatenate([best, more])
            best = best[np.lexsort((-best[:, 1], -best[:, 0]))]
            _, first = np.unique(best[:, 1], return_index=True)  # one row per candidate id
            best = best[np.sort(first)][:k]
            at, step = at + step, step * 2
        out += [(i, int(r), int(s)) for s, _, r in best]
    return out


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    n_pivots: int = PIVOTS,
    slice_rows: int = SLICE,
    block_rows: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best k rows of ``vectors`` for each query."""
    folder = shared_folder(vectors.sparkSession)
    all_rows = written(quantized(vectors, id_column, vector_column), folder, "vectors")
    asked = written(quantized(queries, id_column, vector_column), folder, "queries")
    chosen = all_rows.orderBy(F.xxhash64("v"), "id").limit(n_pivots).collect()  # a bounded few
    slices = max(1, -(-asked.count() // slice_rows))
    blocks = max(1, -(-all_rows.count() // block_rows), _spare_blocks(vectors))
    pivots = np.array([r["v"] for r in chosen], np.int64)

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int):
        return F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")

    c = all_rows.select("id", "v", dealt(blocks).alias("block"), copies(slices).alias("slice"))
    q = asked.select("id", "v", dealt(slices).alias("slice"), copies(blocks).alias("block"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t):
            return np.asarray(t["v"].combine_chunks().values).reshape(len(t), -1)

        rows = []
        if len(left) and len(right):
            q_ids, c_ids = left["id"].to_numpy(), right["id"].to_numpy()
            rows = bounded_best(matrix(left), matrix(right), q_ids, c_ids, pivots, k)
            rows = [(q_ids[i], c_ids[j], s) for i, j, s in rows]
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.table(
            {n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), columns)}
        )

    found = (
        q.groupBy("slice", "block")
        .cogroup(c.groupBy("slice", "block"))
        .applyInArrow(best, "query_id bigint, vec_id bigint, score bigint")
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _spare_blocks(df: DataFrame) -> int:
    """At least a block for every core, so that no core is idle."""
    return df.sparkSession.sparkContext.defaultParallelism


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP7_SQL = """
with v as (
  select distinct vec_id, [floor(256 * x::double)::bigint for x in embedding] as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), p as (
  select q.vec_id as query_id, c.vec_id, max(list_sum([a[1] * a[2] for a in list_zip(q.e, c.e)]))::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id group by 1, 2
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
  from p
)
select * from r where rank <= 5
"""
