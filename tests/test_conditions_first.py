import numpy as np
import pyarrow as pa
import pytest

from siftwell.operators import blocks


def _lists(rows, kind):
    return pa.array(rows, pa.list_(kind))


def _tables(rng, odd):
    n, m = 400, 60
    words = [np.sort(rng.choice(40, 6, replace=False)).tolist() for _ in range(n + m)]
    dense = rng.normal(size=(n + m, 8)).tolist()
    dense[3], dense[n + 2] = None, None
    weights = rng.uniform(0.1, 2.0, (n + m, 6)).tolist()
    if odd:
        dense[5][0], weights[5][0] = float("nan"), -1.0
    vectors = [_lists(dense, pa.float64()), _lists(words, pa.int64()), _lists(weights, pa.float64())]
    names = ["dense", "indices", "values"]
    at = pa.array([None if i % 50 == 7 else int(x) for i, x in enumerate(rng.integers(0, 2000, n))], pa.int64())
    topic = pa.array([[None, "a", "b", "c"][i % 4] for i in range(n)])
    docs = pa.table([pa.array(range(n)), topic, at, *(v[:n] for v in vectors)], ["id", "category", "created_at", *names])
    start = [int(x) if i % 2 else None for i, x in enumerate(rng.integers(0, 2000, m))]
    end = [None if s is None or i % 10 == 1 else s + 30 for i, s in enumerate(start)]
    wanted = pa.array([["a", None, "d", None, "b"][i % 5] for i in range(m)])
    asked = [pa.array(range(m)), wanted, pa.array(start, pa.int64()), pa.array(end, pa.int64()), *(v[n:] for v in vectors)]
    return docs, pa.table(asked, ["query_id", "category_filter", "created_after", "created_before", *names])


@pytest.mark.parametrize("odd", [False, True])
def test_queries_grouped_by_conditions_give_the_same_hits(monkeypatch, odd):
    """Equal to all queries in one matrix; narrow time limits score far fewer pairs."""
    docs, queries = _tables(np.random.default_rng(8), odd)
    scored = []
    for scorer in (blocks._Dense, blocks._Sparse):
        plain = scorer.rough
        monkeypatch.setattr(scorer, "rough", lambda self, a, b, f=plain: scored.append((b - a) * docs.num_rows) or f(self, a, b))

    def hits(groups):
        rows = []
        for group in groups:
            best = blocks.BestOf(group, ("dense", "sparse"), 5)
            for start in range(0, 400, 100):
                best.add(docs.slice(start, 100))
            rows += [r for t in best.tables() for r in t.to_pylist()]
        return sorted(rows, key=lambda r: (r["mode"], r["query_id"], r["id"]))

    groups = blocks.by_conditions(queries)
    assert len(groups) > 3 and sum(g.num_rows for g in groups) == queries.num_rows
    whole = hits([queries])
    before, scored[:] = sum(scored), []
    assert hits(groups) == whole
    assert odd or sum(scored) < 0.7 * before


def test_many_categories_stay_together():
    table = pa.table({
        "category_filter": [str(i) for i in range(40)],
        "created_after": pa.nulls(40, pa.int64()), "created_before": pa.nulls(40, pa.int64()),
    })
    assert len(blocks.by_conditions(table)) == 1
    assert len(blocks.by_conditions(table.slice(0, 3))) == 3
