"""Trained lists and the search that stops when no list can improve its hits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from siftwell.operators import ann
from siftwell.operators.ranking import exact_topk

VECTOR = "id bigint, tenant_id string, dense array<double>"


def lloyd(unit, lists, rounds):
    """The same rounds, vector by vector."""
    centroids = [list(v) for v in unit[:lists]]
    for _ in range(rounds):
        sims = [[round(float(np.dot(v, c)) / (np.linalg.norm(c) or 1.0), 9) for c in centroids] for v in unit]
        mine = [max(range(len(centroids)), key=lambda j: (s[j], -j)) for s in sims]
        far = iter(sorted(range(len(unit)), key=lambda i: (sims[i][mine[i]], i)))
        for j in range(len(centroids)):
            members = [unit[i] for i in range(len(unit)) if mine[i] == j]
            if members:
                centroids[j] = [np.floor(x * 2**24 + 0.5) / 2**24 for x in np.sum(members, axis=0) / len(members)]
        for j in range(len(centroids)):
            if j not in mine:
                centroids[j] = list(unit[next(far)])
    return np.array(centroids)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_are_those_of_the_definition(seed):
    draw = np.random.default_rng(seed)
    unit = draw.normal(size=(30, 3))
    unit[5:9] = unit[0]  # equal seeds leave lists empty
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert ann.lloyd(unit, 7, 4) == pytest.approx(lloyd(unit, 7, 4), abs=1e-7)


@pytest.fixture(scope="module")
def clustered(spark):
    draw, rows = np.random.default_rng(3), []
    for i in range(600):
        centre = np.eye(8)[i % 8] * 4
        tenant = "hot" if i % 4 else f"t{i % 3}"
        rows.append((i, tenant, (centre + draw.normal(size=8) * 0.6).tolist()))
    rows += [(700, "hot", None), (701, "hot", [float("nan")] * 8), (702, "hot", [0.0] * 8), (703, "few", [1.0] * 8)]
    rows += [(704, None, [1.0] * 8), (705, "hot", [float("inf")] + [0.0] * 7)]
    return spark.createDataFrame(rows, VECTOR).repartition(3)


def hits(df):
    found = df.select("tenant_id", "query_id", "rank", "id", "score").collect()
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("nprobe, limit", [(1, 5), (3, 10), (16, 4)])
def test_adaptive_search_is_exact(clustered, nprobe, limit):
    asked = clustered.withColumnRenamed("id", "query_id").where("query_id % 5 = 0 OR query_id >= 700")
    centroids = ann.train_centroids(clustered, 16).cache()
    want = hits(exact_topk(clustered, asked, limit))
    assert want and hits(ann.adaptive_search(clustered, asked, centroids, nprobe, limit)) == want


def test_adaptive_search_leaves_lists_out(clustered):
    asked = clustered.withColumnRenamed("id", "query_id").where("query_id < 600")
    plain = clustered.where("id < 600")
    centroids = ann.train_centroids(plain, 16).cache()
    rows = ann.lists_read(plain, asked, centroids, 2, 5).collect()
    assert len(rows) == 600 and all(2 <= r.lists_read <= r.lists for r in rows)
    assert np.mean([r.lists_read / r.lists for r in rows]) < 0.8


def test_training_is_repeatable_and_bounded(clustered):
    first = ann.train_centroids(clustered, 6, sample=50).collect()
    again = ann.train_centroids(clustered.repartition(7), 6, sample=50).collect()
    assert sorted(first) == sorted(again)
    assert {r.tenant_id: 0 for r in first}.keys() == {"hot", "few", "t0", "t1", "t2"}
    assert sum(r.tenant_id == "few" for r in first) == 1
    assert ann.train_centroids(clustered.limit(0), 6).collect() == []
    with pytest.raises(ValueError):
        ann.train_centroids(clustered, 8, sample=4)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_recall_of_the_registered_lists(spark, sf):
    exact = registered.dense_exact_topk(spark, sf).select("query_id", "id")
    found = registered.ivf_topk(spark, sf).select("query_id", "id")
    assert found.join(exact, ["query_id", "id"]).count() >= 0.9 * exact.count()
    summary = registered.mode_summary(spark, sf).where(F.col("mode") == "dense").first()
    assert summary.index_recall_at_10 >= 0.9
