"""Inverted lists searched in cells: a query is dealt out once, whatever lists it names."""

import numpy as np
import pytest

from siftwell.operators import ann, ranking


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "tuv"[i % 7 % 3], [float(x) for x in rng.normal(size=6)]) for i in range(240)]
    rows += [(300, "t", None), (301, "t", [float("nan")] * 6), (302, None, rows[0][2]), (5, "t", rows[9][2])]
    points = spark.createDataFrame(rows, "id bigint, tenant_id string, dense array<double>").localCheckpoint()
    asked = points.withColumnRenamed("id", "query_id")
    return points, asked.unionByName(asked.where("query_id < 3")), ann.train_centroids(points, 6).localCheckpoint()


def ranked(found):
    return sorted(map(repr, found.collect()))


def test_listed_cells_give_the_hits_of_slices(vectors, monkeypatch):
    points, asked, centroids = vectors
    searches = (
        lambda: ann.ivf_search(points, asked, centroids, 3, 5),
        lambda: ann.ivf_sweep(points, asked, centroids, [1, 4, 6], 5),
    )
    want = [ranked(s()) for s in searches]
    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    monkeypatch.setattr(ranking, "CELL_BYTES", 3_000)
    monkeypatch.setattr(ranking, "CELL_DOCS", 20)
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 4)
    assert [ranked(s()) for s in searches] == want and all(want)


def test_a_query_is_dealt_out_once_for_all_its_lists(vectors, monkeypatch):
    points, asked, centroids = vectors
    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    dealt, deal = [], ranking._dealt

    def counted(rows, cells, keys, own, other, id_):
        out = deal(rows, cells, keys, own, other, id_)
        if id_ == "query_id":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(ranking, "_dealt", counted)
    few = asked.where("query_id % 10 = 3 AND dense IS NOT NULL")
    probes = ann.probe_lists(few, centroids, 6)
    dealt.clear()
    ann.listed_topk(ann.assign_lists(points, centroids), few, probes.drop("rank"), 5).collect()
    assert dealt == [few.where("tenant_id IS NOT NULL").count()] and probes.count() == 6 * dealt[0]
