"""Search over more queries than are sent to every worker: both sides dealt out in cells."""

import numpy as np
import pyarrow as pa
import pytest

from siftwell.operators import blocks, ranking
from siftwell.operators.idf import idf_table
from siftwell.plans.search import search
from tests import brute


@pytest.fixture
def cells(monkeypatch):
    """Everything is dealt out, in small cells; nothing may go through the driver."""

    def sent(*args):
        raise AssertionError("queries were sent to the workers")

    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    monkeypatch.setattr(ranking, "CELL_BYTES", 30_000)
    monkeypatch.setattr(ranking, "CELL_DOCS", 9)
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 4)
    monkeypatch.setattr(ranking, "_score_slice", sent)


@pytest.mark.parametrize("size", [1 << 26, 8_000])
def test_cells_give_the_hits_of_slices(tables, monkeypatch, cells, size):
    _, points, asked = tables
    idf = idf_table(points)
    got = [brute.ranked(search(points, asked, mode, 10, idf=idf, slice_bytes=size).collect()) for mode in ("hybrid", "dense", "sparse")]
    monkeypatch.undo()
    want = [brute.ranked(search(points, asked, mode, 10, idf=idf).collect()) for mode in ("hybrid", "dense", "sparse")]
    assert got == want and got[0]


def test_cells_keep_filters_copies_and_broken_vectors(spark, monkeypatch, cells):
    rows = [(i, "tu"[i % 2], [1.0, i / 10], "ab"[i % 3 % 2], i) for i in range(30)]
    rows += [(40 + i, "t", [1.0, 0.5], "a", 7) for i in range(30)]
    rows += [(90, "t", None, "a", 1), (91, "t", [float("nan"), 1.0], "a", 1), (92, None, [1.0, 0.0], "a", 1), (93, "v", [1.0, 0.0], None, None)]
    points = spark.createDataFrame(rows, "id bigint, tenant_id string, dense array<double>, category string, created_at bigint")
    asked = [(i, "tuvx"[i % 4], [1.0, i / 50] if i % 9 else None, "a" if i % 3 else None, i % 7 if i % 5 else None) for i in range(60)]
    asked = asked + [(60, None, [1.0, 0.0], None, None)] + asked[:8]
    kinds = "query_id bigint, tenant_id string, dense array<double>, category_filter string, created_after bigint"
    queries = spark.createDataFrame(asked, kinds)
    found = lambda: sorted(map(repr, search(points, queries, "dense", 5).collect()))
    got = found()
    monkeypatch.undo()
    assert got == found() and got


def test_slices_compute_the_documents_once(spark, tables):
    """Several slices used to embed all documents once each."""
    _, points, asked = tables
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    documents = points.select("id", "tenant_id", "category", "created_at", "dense").localCheckpoint()
    counted = documents.mapInArrow(watched, documents.schema)
    search(counted, asked, "dense", 3, slice_bytes=20_000).collect()
    assert seen.value == documents.count()


def _sparse(rows):
    offsets = pa.array(np.cumsum([0, *(len(r) for r in rows)]), pa.int32())
    terms = pa.array([t for r in rows for t in sorted(r)], pa.int64())
    weights = pa.array([r[t] for r in rows for t in sorted(r)], pa.float64())
    return pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, weights)


@pytest.mark.parametrize("columns", [0, 3, 1024])
@pytest.mark.parametrize("odd", [None, -2.0, 1e-30, float("nan")])
def test_sparse_scores_are_those_of_single_sums(monkeypatch, columns, odd):
    """Terms as columns, as entries or both; weights that single precision cannot hold."""
    monkeypatch.setattr(blocks, "_COLUMNS", columns)
    monkeypatch.setattr(blocks, "_ENTRIES_PER_STEP", 50)
    monkeypatch.setattr(blocks, "_CELLS_PER_STEP", 300)
    rng = np.random.default_rng(5)
    make = lambda n: [{int(t): float(rng.random() + 0.1) for t in np.minimum(rng.zipf(1.4, 12), 60)} for _ in range(n)]
    docs, queries = make(90), [*make(20), {}, {99: 1.0}]
    docs[7:20] = [docs[3]] * 13
    if odd is not None:
        docs[30][1] = odd
    table = pa.table([pa.array(range(90)), *_sparse(docs)], ["id", "indices", "values"])
    best = blocks.BestOf(pa.table([pa.array(range(22)), *_sparse(queries)], ["query_id", "indices", "values"]), ("sparse",), 6)
    for start in range(0, 90, 30):
        best.add(table.slice(start, 30))
    got = pa.concat_tables(best.tables()).to_pylist()
    for q, terms in enumerate(queries):
        shared = {i: [t for t in sorted(terms) if t in d] for i, d in enumerate(docs)}
        scores = {i: round(sum(docs[i][t] * terms[t] for t in ts), 9) for i, ts in shared.items() if ts}
        order = sorted(scores, key=lambda i: (np.isnan(scores[i]), -scores[i], i))[:6]
        mine = [r for r in got if r["query_id"] == q]
        assert [r["id"] for r in mine] == order
        assert [r["score"] for r in mine] == [None if np.isnan(scores[i]) else pytest.approx(scores[i], abs=2e-9) for i in order]
