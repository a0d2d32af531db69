"""The stored inverted index against the exhaustive search."""

import random

import numpy as np
import pytest

from siftwell.operators import inverted
from siftwell.operators.embed import embed_hashed
from siftwell.operators.idf import idf_table
from siftwell.plans.search import search

POINT = (
    "id bigint, tenant_id string, category string, created_at bigint, "
    "sparse struct<indices: array<bigint>, values: array<double>>"
)
QUERY = (
    "query_id bigint, tenant_id string, category_filter string, created_after bigint, created_before bigint, "
    "sparse struct<indices: array<bigint>, values: array<double>>"
)


def vector(draw, terms, size, low=0.1):
    chosen = sorted(draw.sample(range(terms), size))
    return chosen, [round(draw.uniform(low, 3), 3) for _ in chosen]


@pytest.fixture(scope="module")
def sparse_tables(spark):
    """Skewed tenants, tied weights, vectors without terms, null vectors, tenants and ids."""
    draw = random.Random(8)
    points = []
    for i in range(900):
        tenant = "a" if i % 3 else f"t{i % 7}"
        points.append((i, tenant, draw.choice("xyz"), draw.choice([None, i]), vector(draw, 60, draw.randrange(1, 12))))
    points += [(1000 + i, "a", "x", 5, ([1, 2, 3], [2.0, 1.0, 1.0])) for i in range(40)]
    points += [(2000, "a", None, 1, ([], [])), (2001, "a", "x", 1, None), (2002, None, "x", 1, ([1], [1.0])), (None, "a", "x", 1, ([1], [1.0]))]
    queries = []
    for q in range(60):
        filters = (draw.choice([None, "x"]), draw.choice([None, 200]), draw.choice([None, 700]))
        queries.append((q, draw.choice(["a", "a", "t0", "t3", "nobody"]), *filters, vector(draw, 70, draw.randrange(1, 25))))
    queries += [(100, "a", None, None, None, ([], [])), (101, "a", None, None, None, None), (102, None, None, None, None, ([1], [1.0]))]
    return spark.createDataFrame(points, POINT).repartition(4), spark.createDataFrame(queries, QUERY)


def rows(df):
    return sorted((r.tenant_id, r.query_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard_docs, block, limit, slice_bytes", [(8192, 64, 10, 1 << 24), (90, 4, 3, 1 << 12), (25, 1, 1, 1 << 24)])
def test_hits_are_those_of_the_exhaustive_search(spark, sparse_tables, tmp_path, monkeypatch, shard_docs, block, limit, slice_bytes):
    monkeypatch.setattr(inverted, "BLOCK", block)
    points, queries = sparse_tables
    inverted.write_index(points, str(tmp_path / "index"), shard_docs)
    idf = idf_table(points)
    for asked in (queries, queries.drop("category_filter", "created_after", "created_before")):
        want = rows(search(points.dropna(subset=["id"]), asked, "sparse", limit, idf=idf))
        got = rows(inverted.index_search(spark, str(tmp_path / "index"), asked, idf, limit, slice_bytes))
        assert want and got == want


def test_negative_weights(spark, tmp_path):
    draw = random.Random(3)
    signed = lambda: vector(draw, 30, 8, low=-3)
    points = spark.createDataFrame([(i, "a", "x", i, signed()) for i in range(400)], POINT)
    queries = spark.createDataFrame([(q, "a", None, None, None, signed()) for q in range(30)], QUERY)
    inverted.write_index(points, str(tmp_path), 100)
    idf = idf_table(points)
    got = rows(inverted.index_search(spark, str(tmp_path), queries, idf, 5))
    assert got == rows(search(points, queries, "sparse", 5, idf=idf))


def test_blocks_are_skipped():
    import pyarrow as pa

    draw = np.random.default_rng(1)
    rows, size = [], 4096
    for term, share in ((1, 0.01), (2, 0.9), (3, 0.9)):
        ids = np.flatnonzero(draw.random(size) < share)
        weights = np.where(draw.random(len(ids)) < 0.01, 2.0, 0.1) if term > 1 else np.full(len(ids), 50.0)
        blocks = range(0, len(ids), inverted.BLOCK)
        peaks = [weights[k : k + inverted.BLOCK].max() for k in blocks], [weights[k : k + inverted.BLOCK].min() for k in blocks]
        rows.append({"idx": term, "ids": ids.tolist(), "weights": weights.tolist(), "largest": peaks[0], "smallest": peaks[1]})
    shard = inverted.Shard(pa.Table.from_pylist(rows))
    terms, w = np.array([1, 2, 3]), np.ones(3)
    docs, blocks, read = shard.best(terms, w, 5, None)
    assert read < blocks / 2
    every = shard.scores(np.arange(len(shard.ids)), terms, w)
    best = np.sort(every)[-5:]
    assert (np.sort(shard.scores(docs, terms, w))[-5:] == best).all()


def test_a_search_reads_its_own_terms(spark, tmp_path):
    texts = [(i, "a" if i % 2 else "b", f"common word{i} other{i % 5}") for i in range(50)]
    points = embed_hashed(spark.createDataFrame(texts, "id bigint, tenant_id string, text string"), dense=False)
    inverted.write_index(points, str(tmp_path))
    asked = embed_hashed(spark.createDataFrame([(1, "a", "word7 other2")], "query_id bigint, tenant_id string, text string"), dense=False)
    found = inverted.index_search(spark, str(tmp_path), asked, idf_table(points))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "largest" in line]
    assert scans and all("PushedFilters: [In(idx" in line.replace("IsNotNull(idx), ", "") for line in scans)
    assert found.orderBy("rank").first().id == 7
    work = inverted.index_work(spark, str(tmp_path), asked, idf_table(points)).collect()
    assert [(r.query_id, r.blocks) for r in work] == [(1, 2)]


def test_empty_and_broken_tables(spark, tmp_path):
    nothing = spark.createDataFrame([], POINT)
    inverted.write_index(nothing, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "a", None, None, None, ([1], [1.0]))], QUERY)
    idf = spark.createDataFrame([(1, 1, 0.5)], "idx bigint, df bigint, idf double")
    assert inverted.index_search(spark, str(tmp_path / "none"), asked, idf).collect() == []
    broken = spark.createDataFrame([(1, "a", "x", 1, ([1], [float("nan")]))], POINT)
    with pytest.raises(Exception, match="finite"):
        inverted.write_index(broken, str(tmp_path / "broken"))


@pytest.mark.parametrize("walked", [0, 10**6])
def test_queries_of_a_shard_together_and_dealt_out(spark, sparse_tables, tmp_path, monkeypatch, walked):
    """Queries of many shards used to be sent to every worker, slice by slice, and walked one by one."""

    def sent(*args):
        raise AssertionError("queries were sent to the workers")

    points, queries = sparse_tables
    points = points.dropna(subset=["id"]).localCheckpoint()
    again = queries.unionByName(queries.where("query_id < 9"))
    inverted.write_index(points, str(tmp_path / "index"), 50)
    idf = idf_table(points)
    want = [rows(search(points, asked, "sparse", 4, idf=idf)) for asked in (again, again.drop("category_filter", "created_after", "created_before"))]
    monkeypatch.setattr(inverted, "_score_slice", sent)
    monkeypatch.setattr(inverted, "WALKED", walked)
    monkeypatch.setattr(inverted, "SHARD_DOCS", 120)
    monkeypatch.setattr(inverted, "SENT_TERMS", walked)
    monkeypatch.setattr(inverted, "PUSHED_TERMS", 3)
    for asked, expected in zip((again, again.drop("category_filter", "created_after", "created_before")), want):
        assert expected and rows(inverted.index_search(spark, str(tmp_path / "index"), asked, idf, 4, 2_000)) == expected
