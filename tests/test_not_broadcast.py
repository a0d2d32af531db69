"""Rows per query and list never pass through the driver, also where their files are small."""

import numpy as np

from siftwell.operators import ann, codes, ranking


def joins_of(df, by="query_id"):
    """Kinds of the joins by a column."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Join")[0].split()[-1] for line in plan.splitlines() if "Join [" in line and by in line]


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"t{i % 2}", rng.normal(size=16).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "id bigint, tenant_id string, dense array<double>").localCheckpoint()


def test_probed_lists_are_merged(spark, monkeypatch):
    points, kinds = vectors(spark), []
    queries, keep = points.withColumnRenamed("id", "query_id"), ranking.stored
    monkeypatch.setattr(ranking, "stored", lambda df: kinds.extend(joins_of(df)) or keep(df))
    found = ann.ivf_search(points, queries, ann.train_centroids(points, 3), 2, 4)
    assert joins_of(found) == ["SortMerge"] and "BroadcastHash" not in kinds
    assert found.count() == 60 * 4


def test_candidates_of_codes_are_merged(spark):
    points = vectors(spark)
    book = codes.train_codebook(points, parts=4, codes=8)
    coded = codes.with_codes(points, book).drop("dense")
    found = codes.code_search(coded, points, points.withColumnRenamed("id", "query_id"), book, 3, 6)
    assert joins_of(found, "id#") == ["SortMerge"] * 2
    assert found.count() == 60 * 3
