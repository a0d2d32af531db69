"""Blocks ranked in single precision first, and sparse sums taken document by document."""

import numpy as np
import pyarrow as pa

from siftwell.operators import blocks


def lists(rows, kind):
    return pa.array(rows, pa.list_(kind))


def dense_tables(docs, queries):
    sides = ((docs, "id"), (queries, "query_id"))
    return [pa.table({name: pa.array(range(len(m)), pa.int64()), "dense": lists([None if v is None else list(v) for v in m], pa.float64())}) for m, name in sides]


def best(docs, queries, mode, k, rows=None):
    found = blocks.BestOf(queries, (mode,), k)
    for start in range(0, docs.num_rows, rows or docs.num_rows):
        found.add(docs.slice(start, rows or docs.num_rows))
    return [t.to_pydict() for t in found.tables()]


def test_large_blocks_are_ranked_in_single_precision_first():
    rng = np.random.default_rng(3)
    hub = rng.normal(size=24)
    # neighbours of one vector, closer to each other than single precision can tell, copies among them
    m = [hub + 1e-8 * rng.normal(size=24) for _ in range(400)] + [*rng.normal(size=(400, 24))]
    m[7], m[9], m[11], m[500] = m[8], m[8], np.zeros(24), None
    docs, queries = dense_tables(m, [hub, m[8], *rng.normal(size=(5, 24)), np.zeros(24), None])
    assert blocks._Dense(docs, queries, 3).single
    together = best(docs, queries, "dense", 3)
    assert not blocks._Dense(docs.slice(0, 50), queries, 3).single
    assert together == best(docs, queries, "dense", 3, 50) == best(docs, queries, "dense", 3, 310)


def test_vectors_that_single_precision_cannot_hold_are_not_ranked_by_it():
    rng = np.random.default_rng(4)
    for odd in (np.nan, np.inf, 1e80, 1e-80):
        m = rng.normal(size=(400, 8))
        m[5] = odd
        docs, queries = dense_tables(m, rng.normal(size=(4, 8)))
        assert not blocks._Dense(docs, queries, 3).single
        assert not blocks._Dense(queries.rename_columns(["id", "dense"]), docs.rename_columns(["query_id", "dense"]), 1).single


def sparse_table(rows, name):
    indices, values = zip(*rows)
    return pa.table(
        {
            name: pa.array(range(len(rows)), pa.int64()),
            "indices": lists([list(map(int, x)) for x in indices], pa.int64()),
            "values": lists([list(map(float, x)) for x in values], pa.float64()),
        }
    )


def test_sparse_sums_do_not_depend_on_the_side_they_are_taken_from(monkeypatch):
    rng = np.random.default_rng(5)

    def row(terms):
        place = np.sort(rng.choice(300, terms, replace=False))
        return place, rng.uniform(0.1, 3.0, terms)

    docs = sparse_table([row(200 if i % 10 == 0 else 12) for i in range(300)], "id")
    queries = sparse_table([row(15) for _ in range(40)] + [([], [])], "query_id")
    scorer = blocks._Sparse(docs, queries, 5)
    col, place = np.meshgrid(np.arange(300), np.arange(40))
    pair = place.ravel(), col.ravel()
    found = {}
    for cost in (0, 10**6):  # the longer rows of documents are laid out, or the fewer queries
        monkeypatch.setattr(blocks, "_LAYING_OUT", cost)
        for entries in (50, 10**6):
            monkeypatch.setattr(blocks, "_ENTRIES_PER_STEP", entries)
            found[cost, entries] = scorer.exact(*pair, None).tolist()
    want = []
    for q, d in zip(*pair):
        mine = dict(zip(queries["indices"][int(q)].as_py(), queries["values"][int(q)].as_py()))
        total = 0.0
        for term, weight in zip(docs["indices"][int(d)].as_py(), docs["values"][int(d)].as_py()):
            total += weight * mine.get(term, 0.0)
        want.append(total)
    assert all(x == want for x in found.values())


def test_candidates_are_scored_in_bounded_numbers(monkeypatch):
    rng = np.random.default_rng(6)
    docs, queries = dense_tables(np.tile(rng.normal(size=(4, 8)), (100, 1)), rng.normal(size=(30, 8)))
    want, sizes, exact = best(docs, queries, "dense", 2), [], blocks._Dense.exact
    monkeypatch.setattr(blocks, "_PAIRS_HELD", 150)
    monkeypatch.setattr(blocks, "_CELLS_PER_STEP", 400)
    monkeypatch.setattr(blocks._Dense, "exact", lambda self, row, *x: sizes.append(len(row)) or exact(self, row, *x))
    assert best(docs, queries, "dense", 2) == want
    assert len(sizes) > 1 and max(sizes) <= 150 + 400
