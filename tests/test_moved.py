"""What a search moves and leaves on the disks."""

import re
import time

import pytest
from pyspark.sql import functions as F

from siftwell.operators import idf as idf_ops, ranking
from siftwell.operators.idf import idf_table, weight_queries
from siftwell.plans.search import search
from siftwell.sources.collection import stored
from tests import brute


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def test_a_stored_table_leaves_no_shuffle(spark):
    """Shuffles used to stay until the driver collected its garbage."""
    was = shuffle_files(spark)
    made = stored(spark.range(50).repartition(3, "id").groupBy(F.col("id") % 7).count())
    deadline = time.time() + 10
    while shuffle_files(spark) > was and time.time() < deadline:
        time.sleep(0.2)
    assert shuffle_files(spark) <= was
    assert made.count() == 7


def test_documents_are_moved_once_however_many_the_queries(spark, monkeypatch):
    """A document used to be moved for every ``CELL_BYTES`` of queries."""
    kinds = "tenant_id string, dense array<double>"
    points = spark.createDataFrame([(i, "t", [1.0, i / 7]) for i in range(90)], f"id bigint, {kinds}")
    asked = spark.createDataFrame([(i, "t", [1.0, i / 5]) for i in range(70)], f"query_id bigint, {kinds}")
    want = sorted(map(repr, ranking.exact_topk(points, asked, 4).collect()))
    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    monkeypatch.setattr(ranking, "CELL_BYTES", 1_500)
    dealt, moved = ranking._dealt, []

    def watched(rows, *args):
        moved.append(dealt(rows, *args))
        return moved[-1]

    monkeypatch.setattr(ranking, "_dealt", watched)
    assert sorted(map(repr, ranking.block_topk(points, asked, 4).transform(ranking.take_top, 4).collect())) == want
    assert [x.count() for x in moved] == [70, 90]


def test_cells_are_dealt_in_rounds(spark, monkeypatch):
    """Everything used to be moved at once, however often."""
    kinds = "tenant_id string, dense array<double>"
    points = spark.createDataFrame([(i, "tuv"[i % 9 % 3], [1.0, i / 7]) for i in range(90)], f"id bigint, {kinds}")
    asked = spark.createDataFrame([(i, "tu"[i % 9 == 0], [1.0, i / 5]) for i in range(70)], f"query_id bigint, {kinds}")
    want = sorted(map(repr, ranking.exact_topk(points, asked, 4).collect()))
    for name, value in {"SENT_BYTES": 0, "ROUND_BYTES": 1, "CELL_PAIRS": 10, "CELL_QUERIES": 4, "CELLS_PER_CORE": 100}.items():
        monkeypatch.setattr(ranking, name, value)
    rounds, seen = ranking._rounds, []

    def watched(*args):
        seen.append((args, rounds(*args)))
        return seen[-1][1]

    monkeypatch.setattr(ranking, "_rounds", watched)
    assert sorted(map(repr, ranking.exact_topk(points, asked, 4).collect())) == want
    ((counts, asked_bytes, docs_bytes), number), = seen
    assert 1 < number <= counts["qs"]
    assert counts["docs_moved"] > 2 * counts["docs"]


@pytest.mark.parametrize("slice_bytes", [1 << 26, 8_000])
def test_documents_of_a_cell_in_a_file(tables, monkeypatch, slice_bytes):
    _, points, asked = tables
    idf = idf_table(points)
    want = brute.ranked(search(points, asked, "hybrid", 10, idf=idf).collect())
    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    monkeypatch.setattr(ranking, "HELD_BYTES", 20_000)
    monkeypatch.setattr(ranking, "CELL_BYTES", 30_000)
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 4)
    assert brute.ranked(search(points, asked, "hybrid", 10, idf=idf, slice_bytes=slice_bytes).collect()) == want and want


def test_ranks_of_both_branches_are_dealt_once(tables):
    """Ranking, fusing and ranking again used to be a shuffle each."""
    _, points, asked = tables
    plan = search(points, asked, "hybrid", 5)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*query_id#", plan)) == 1


SPARSE = "sparse struct<indices: array<bigint>, values: array<double>>"


@pytest.mark.parametrize("scope", ["collection", "tenant"])
def test_queries_are_weighed_where_they_are_read(spark, monkeypatch, scope):
    """Only rows of one query are brought together."""
    points = [(i, "ab"[i % 2], ([i % 5, 7, 9 + i], [1.0, 2.0, 0.5])) for i in range(20)]
    points = spark.createDataFrame(points, f"id bigint, tenant_id string, {SPARSE}")
    rows = [(i, "abn"[i % 3], "x", ([1, 7, 12, 99], [1.0, 2.0, 3.0, 4.0])) for i in range(9)]
    rows += [(20, "a", "x", ([7, 1], [1.0, 2.0])), (21, "a", "x", ([], [])), (22, "a", "x", None), (None, "a", "x", ([1], [1.0])), (23, None, "x", ([1], [1.0]))]
    rows += [(24, "a", "x", ([1, None, 7], [1.0, 2.0, 3.0])), (30, "a", "x", ([1, 7], [1.0, 2.0])), (30, "a", "y", ([2], [1.0]))]
    queries = spark.createDataFrame(rows, f"query_id bigint, tenant_id string, note string, {SPARSE}")
    idf = idf_table(points, scope)
    on = ["tenant_id", "idx"] if scope == "tenant" else ["idx"]
    found = lambda df: sorted(map(repr, df.select("query_id", "tenant_id", "note", "sparse").collect()))
    want = found(idf_ops._by_join(queries, idf, on))
    joined, brought = idf_ops._by_join, []

    def watched(some, *args):
        brought.append(some.count())
        return joined(some, *args)

    monkeypatch.setattr(idf_ops, "_by_join", watched)
    assert found(weight_queries(queries, idf)) == want
    assert brought == [2]
    monkeypatch.setattr(idf_ops, "SENT_WEIGHTS", 0)
    assert found(weight_queries(queries, idf)) == want
