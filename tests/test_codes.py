"""Product-quantisation codes and the search over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries as registered, tables as t
from siftwell.operators import codes
from siftwell.operators.ranking import exact_topk

VECTOR = "id bigint, tenant_id string, category string, dense array<double>"


@pytest.fixture(scope="module")
def points(spark):
    draw, rows = np.random.default_rng(6), []
    for i in range(500):
        dense = (np.eye(8)[i % 8] * 2 + draw.normal(size=8)).tolist()
        rows.append((i, "hot" if i % 3 else "cold", "xy"[i % 2], dense))
    rows += [(900, "hot", "x", None), (901, "hot", "x", [float("nan")] * 8), (902, "hot", "x", [0.0] * 8), (903, None, "x", [1.0] * 8)]
    return spark.createDataFrame(rows, VECTOR).repartition(3)


def hits(df):
    return sorted(map(tuple, df.select("tenant_id", "query_id", "rank", "id", "score").collect()), key=repr)


def test_codes_are_the_nearest_centroids(points):
    book = codes.train_codebook(points, 4, 16).cache()
    table = {(r.part, r.code): r.centroid for r in book.collect()}
    assert {k[0] for k in table} == {0, 1, 2, 3} and len(table) == 64
    for r in codes.with_codes(points, book).collect():
        if r.dense is None or any(x != x for x in r.dense):
            assert r.codes is None
            continue
        unit = np.array(r.dense) / (np.linalg.norm(r.dense) or 1.0)
        for part, code in enumerate(r.codes):
            gaps = [np.sum((unit[2 * part : 2 * part + 2] - table[part, c]) ** 2) for c in range(16)]
            assert gaps[code] == pytest.approx(min(gaps), abs=1e-8)


def test_search_with_all_candidates_is_exact(points):
    asked = points.where("id % 7 = 0").withColumnRenamed("id", "query_id").drop("category")
    asked = asked.withColumn("category_filter", F.when(F.col("query_id") % 2 == 0, "x"))
    book = codes.train_codebook(points, 4, 16).cache()
    coded = codes.with_codes(points, book).drop("dense")
    whole = points.where("id != 901")
    want = hits(exact_topk(whole, asked, 6))
    assert want and hits(codes.code_search(coded, points, asked, book, 6, candidates=600)) == want
    few = hits(codes.code_search(coded, points, asked, book, 6, candidates=30))
    assert len({r[:2] + r[3:] for r in few} & {r[:2] + r[3:] for r in want}) >= 0.9 * len(want)


def test_odd_tables(spark, points):
    nothing = points.limit(0)
    book = codes.train_codebook(nothing, 4, 16)
    assert book.collect() == []
    assert codes.with_codes(points, book).where("codes IS NOT NULL").count() == 0
    asked = points.withColumnRenamed("id", "query_id").drop("category")
    assert codes.code_search(codes.with_codes(points, book), points, asked, book).collect() == []
    with pytest.raises(ValueError):
        codes.train_codebook(points, 4, 257)
    with pytest.raises(ValueError):
        codes.code_search(points, points, asked, book, limit=10, candidates=5)


def test_recall_and_bytes_of_the_registered_search(spark):
    sf = "/root/testdata/sf0.01"
    exact = registered.dense_exact_topk(spark, sf).select("query_id", "id")
    found = registered.pq_topk(spark, sf).select("query_id", "id")
    assert found.join(exact, ["query_id", "id"]).count() >= 0.9 * exact.count()
    _, coded = registered.coded_vectors(spark, sf)
    sizes = coded.join(t.vectors(spark, sf), "id").agg(F.avg(F.length("codes")), F.avg(F.size("dense") * 4)).first()
    assert sizes[0] * 10 < sizes[1]
