import numpy as np
import pyarrow as pa
import pytest

from siftwell.operators import blocks


@pytest.mark.parametrize("places", [1, 4, 1 << 22])
def test_terms_are_numbered_also_where_they_share_a_place(monkeypatch, places):
    monkeypatch.setattr(blocks, "_PLACES", places)
    rng = np.random.default_rng(3)
    asked = rng.integers(-50, 50, 40) * 3
    given = np.r_[rng.integers(-200, 200, 300), 2**62, -(2**62)]
    n, place, at = blocks._numbered(asked, given)
    terms = sorted(set(asked.tolist()))
    assert n == len(terms)
    assert [terms[i] for i in place] == asked.tolist()
    assert [None if i < 0 else terms[i] for i in at] == [g if g in terms else None for g in given.tolist()]
    assert blocks._numbered(asked[:0], given)[2].tolist() == [-1] * len(given)


def test_order_is_stable():
    numbers = np.random.default_rng(4).integers(0, 30, 500).astype(np.int32)
    for n in (30, 1 << 60):
        assert blocks._order(numbers, n).tolist() == np.argsort(numbers, kind="stable").tolist()


def test_terms_of_matrices_are_not_listed_too():
    lists = pa.array([[1, 2, 3]] * 50 + [[1, 100 + i] for i in range(50)][:50], pa.list_(pa.int64()))
    weights = pa.array([[1.0] * len(x) for x in lists.to_pylist()])
    docs = pa.table([pa.array(range(100)), lists, weights], ["id", "indices", "values"])
    queries = pa.table([pa.array([1]), pa.array([[1, 120]], pa.list_(pa.int64())), pa.array([[1.0, 1.0]])], ["query_id", "indices", "values"])
    scorer = blocks._Sparse(docs, queries, 5)
    assert scorer.q_heavy.shape[1] + int(scorer.light.sum()) == 2
    assert len(scorer.doc) == sum(int(scorer.light[t]) for t in scorer.d_term)
    assert scorer.rough(0, 1)[0][0].max() == 2.0
