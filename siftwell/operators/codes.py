"""Compressed dense search: product-quantisation codes, exact scores for what they propose.

Unit vectors are cut into ``parts`` pieces, and each piece is written as the
number of the nearest of ``codes`` centroids, trained per piece on a sample of
bounded size: a vector becomes ``parts`` bytes. A query makes a table of its
products with all centroids; the score of a document is the sum of ``parts``
entries of it. The best ``candidates`` by these sums are scored exactly, so the
scan of the corpus reads a byte where it would read a piece, and only a
candidate's own vector is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siftwell.operators.ann import ROUNDS, SAMPLE, cosine, finite_vector, lloyd
from siftwell.operators.blocks import SCORE_DIGITS
from siftwell.operators.ranking import block_topk, take_top
from siftwell.schema import require_columns
from siftwell.sources.collection import stored

PARTS, CODES = 16, 64


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one (all zero stays)."""
    out = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.where(norm == 0, 1.0, norm)[:, None]


def _closeness(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Half the negative squared distance."""
    squares = np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", centroids, centroids)
    return rows @ centroids.T - squares / 2


def train_codebook(
    points: DataFrame, parts: int = PARTS, codes: int = CODES, rounds: int = ROUNDS, sample: int = SAMPLE
) -> DataFrame:
    """part, code, centroid: trained on the ``sample`` vectors with the smallest md5(id).

    One task per part holds its pieces of the sample, no more. Vectors that are
    null or not finite train nothing; their length must be a multiple of ``parts``.
    """
    if not 1 <= codes <= 256 or parts < 1 or sample < codes:
        raise ValueError("needs 1 <= codes <= 256, parts >= 1 and sample >= codes")
    require_columns(points, "id", "dense")
    vectors = points.where(finite_vector()).select(F.col("id"), F.col("dense").cast("array<double>").alias("dense"))
    place = F.struct(F.md5(F.col("id").cast("string")).alias("h"), "id", "dense")
    chosen = vectors.select(place.alias("p")).orderBy("p").limit(sample).select("p.*")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column(2)).reshape(batch.num_rows, parts, -1)
            for part in range(parts):
                piece = np.ascontiguousarray(rows[:, part])
                offsets = pa.array(np.arange(len(piece) + 1, dtype=np.int32) * np.int32(piece.shape[1]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(piece.ravel()))
                number = pa.array(np.full(len(piece), part, np.int32))
                yield pa.RecordBatch.from_arrays([number, batch.column(0), batch.column(1), lists], ["part", "h", "id", "piece"])

    kind = points.schema["id"].dataType.simpleString()
    cut = chosen.mapInArrow(pieces, f"part int, h string, id {kind}, piece array<double>")

    def train(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("h", "ascending"), ("id", "ascending")]))
        vectors = rows["piece"].combine_chunks()
        found = lloyd(vectors.flatten().to_numpy().reshape(len(rows), -1), codes, rounds, _closeness)
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * np.int32(found.shape[1]))
        lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
        part = pa.array([key[0].as_py()] * len(found), pa.int32())
        return pa.Table.from_arrays([part, pa.array(np.arange(len(found), dtype=np.int32)), lists], ["part", "code", "centroid"])

    return cut.groupBy("part").applyInArrow(train, "part int, code int, centroid array<double>")


def _books(codebook: DataFrame) -> np.ndarray:
    """parts x codes x piece: at most 256 times the length of a vector."""
    rows = codebook.orderBy("part", "code").collect()
    parts = 1 + max((r.part for r in rows), default=-1)
    return np.array([r.centroid for r in rows]).reshape(parts, -1, len(rows[0].centroid)) if rows else np.empty((0, 0, 0))


def with_codes(points: DataFrame, codebook: DataFrame) -> DataFrame:
    """Add ``codes``, a byte per part; null where the vector is null or not finite."""
    books = points.sparkSession.sparkContext.broadcast(_books(codebook))

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = books.value
        for dense in batches:
            known = dense.drop_null()
            if not len(known) or not len(parts):
                yield pa.nulls(len(dense), pa.binary())
                continue
            rows = unit_rows(known).reshape(len(known), len(parts), -1)
            near = [np.round(_closeness(rows[:, p], parts[p]), SCORE_DIGITS).argmax(axis=1) for p in range(len(parts))]
            codes = iter(map(bytes, np.stack(near, axis=1).astype(np.uint8)))
            yield pa.array([next(codes) if ok else None for ok in dense.is_valid().to_pylist()], pa.binary())

    finite = F.when(finite_vector(), F.col("dense").cast("array<double>"))
    return points.withColumn("codes", encode(finite))


def with_tables(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """Add ``codes``, the products of a query's pieces with all centroids."""
    books = queries.sparkSession.sparkContext.broadcast(_books(codebook))

    @F.arrow_udf("array<double>")
    def tables(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = books.value
        for dense in batches:
            known = dense.drop_null()
            if not len(known) or not len(parts):
                yield pa.nulls(len(dense), pa.list_(pa.float64()))
                continue
            rows = unit_rows(known).reshape(len(known), len(parts), -1)
            table = iter(np.einsum("npd,pcd->npc", rows, parts).reshape(len(known), -1))
            yield pa.array([next(table) if ok else None for ok in dense.is_valid().to_pylist()], pa.list_(pa.float64()))

    finite = F.when(finite_vector(), F.col("dense").cast("array<double>"))
    return queries.withColumn("codes", tables(finite))


def code_search(
    coded: DataFrame, vectors: DataFrame, queries: DataFrame, codebook: DataFrame, limit: int = 10, candidates: int = 60, **plan
) -> DataFrame:
    """The dense top ``limit`` among the best ``candidates`` by codes; scores and order are exact.

    ``coded`` is scanned (tenant_id, id, codes and the columns of filters);
    ``vectors`` (tenant_id, id, dense, each id once) is read for the candidates
    only. Documents and queries whose vector is null or not finite take no part.
    """
    if candidates < limit:
        raise ValueError("candidates must be at least limit")
    require_columns(queries, "tenant_id", "query_id", "dense")
    asked = with_tables(queries, codebook)
    proposed = take_top(block_topk(coded, asked, candidates, ("codes",), **plan), candidates)
    proposed = stored(proposed.select("tenant_id", "query_id", "id"))
    # rows per query: small as files, large as broadcasts through the driver
    found = proposed.hint("merge").join(vectors.select("tenant_id", "id", F.col("dense").cast("array<double>").alias("_d")), ["tenant_id", "id"])
    own = queries.select("tenant_id", "query_id", F.col("dense").cast("array<double>").alias("_q"))
    scored = found.join(own.hint("merge"), ["tenant_id", "query_id"]).withColumn("score", F.round(cosine("_d", "_q"), SCORE_DIGITS) + F.lit(0.0))
    return take_top(scored.select("tenant_id", F.lit("dense").alias("mode"), "query_id", "id", "score"), limit)
