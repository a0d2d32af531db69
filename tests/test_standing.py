"""Maintained rankings against a fresh search after every change."""

import random

import pytest

from siftwell.operators import standing
from siftwell.operators.ranking import exact_topk

POINT = "id bigint, tenant_id string, dense array<double>, sparse struct<indices: array<bigint>, values: array<double>>"


def point(draw, i):
    terms = sorted(draw.sample(range(12), draw.randrange(1, 6)))
    sparse = (terms, [float(draw.randrange(1, 4)) for _ in terms])
    return i, draw.choice(["a", "a", "b"]), [float(draw.randrange(-3, 4)) for _ in range(3)], sparse


def entries(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("mode, limit, depth", [("dense", 4, 7), ("sparse", 5, 5)])
def test_ranking_follows_every_change(spark, mode, limit, depth):
    draw = random.Random(7)
    now = {i: point(draw, i) for i in range(60)}
    table = lambda rows: spark.createDataFrame(list(rows), POINT)
    asked = [(q, *point(draw, q)[1:]) for q in range(9)] + [(50, "new", [1.0, 0.0, 0.0], ([1], [1.0]))]
    queries = table(asked).withColumnRenamed("id", "query_id")
    ranking = standing.start_ranking(table(now.values()), queries, depth, mode)
    names, asked_again = ("tenant_id", "query_id", "rank", "id", "score"), []
    for turn in range(4):
        new = [point(draw, draw.choice([*now, 1000 + 10 * turn + k])) for k in range(6)]
        new = list({p[0]: p for p in new}.values())
        if turn == 1:
            new.append((2000, "new", [1.0, 1.0, 0.0], ([1, 2], [1.0, 1.0])))
        best = sorted({r.id for r in standing.best_of(ranking, 1).collect()})
        gone = [i for i in best[: 2 * turn] if i not in {p[0] for p in new}]
        now = {i: p for i, p in now.items() if i not in gone} | {p[0]: p for p in new}
        removed = spark.createDataFrame([(i,) for i in gone], "id bigint")
        current = table(now.values())
        ranking, again = standing.update_ranking(ranking, table(new), removed, current, queries, limit, depth, mode)
        want = exact_topk(current, queries, limit, (mode,))
        assert entries(standing.best_of(ranking, limit), *names) == entries(want, *names)
        asked_again.append(again.count())
    assert 0 < sum(asked_again) and min(asked_again) < 10


def test_arguments(spark):
    nothing = spark.createDataFrame([], POINT)
    queries = nothing.withColumnRenamed("id", "query_id")
    ranking = standing.start_ranking(nothing, queries, 3)
    updated, again = standing.update_ranking(ranking, nothing, nothing, nothing, queries, 2, 3)
    assert updated.collect() == [] and again.collect() == []
    with pytest.raises(ValueError):
        standing.update_ranking(ranking, nothing, nothing, nothing, queries, 4, 3)
