"""Cells of a large key are spread over tasks; few rows leave the search of lists."""

from pyspark.sql import functions as F

from siftwell.operators import ann, ranking


def made(spark, rows, queries):
    kinds = "tenant_id string, dense array<double>"
    vector = lambda i: [1.0, i % 17 / 7, i % 5 / 3]
    points = spark.createDataFrame([(i, "tu"[i % 10 == 0], vector(i)) for i in range(rows)], f"id bigint, {kinds}")
    asked = spark.createDataFrame([(i, "tu"[i % 10 == 0], vector(i + 3)) for i in range(queries)], f"query_id bigint, {kinds}")
    return points, asked


def test_cells_of_a_large_key_go_to_tasks_of_their_own(spark, monkeypatch):
    points, asked = made(spark, 200, 120)
    want = sorted(map(repr, ranking.exact_topk(points, asked, 5).collect()))
    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    monkeypatch.setattr(ranking, "CELL_PAIRS", 1_000)
    monkeypatch.setattr(ranking, "CELL_QUERIES", 12)
    monkeypatch.setattr(ranking, "CELLS_PER_CORE", 1_000)
    found = ranking.block_topk(points, asked, 5).withColumn("task", F.spark_partition_id())
    tasks = found.groupBy("tenant_id").agg(F.countDistinct("task").alias("n")).collect()
    assert {r["tenant_id"]: r["n"] for r in tasks} == {"t": 9, "u": 1}
    assert found.select("tenant_id", "task").distinct().groupBy("task").count().where("count > 1").isEmpty()
    assert sorted(map(repr, ranking.exact_topk(points, asked, 5).collect())) == want


def test_small_keys_share_partitions(spark, monkeypatch):
    points, asked = made(spark, 60, 60)
    points = points.withColumn("tenant_id", F.concat("tenant_id", F.when(F.col("id") > 40, F.col("id").cast("string")).otherwise("")))
    asked = asked.withColumn("tenant_id", F.concat("tenant_id", F.when(F.col("query_id") > 40, F.col("query_id").cast("string")).otherwise("")))
    want = sorted(map(repr, ranking.exact_topk(points, asked, 5).collect()))
    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    monkeypatch.setattr(ranking, "CELL_PARTITIONS", 3)
    monkeypatch.setattr(ranking, "CELL_BYTES", 2_000)
    assert ranking.block_topk(points, asked, 5).rdd.getNumPartitions() <= 6
    assert sorted(map(repr, ranking.exact_topk(points, asked, 5).collect())) == want


def test_hits_of_all_lists_are_merged_before_they_leave_the_task(spark, monkeypatch):
    points, asked = made(spark, 200, 40)
    points, centroids = points.localCheckpoint(), ann.train_centroids(points, 6).localCheckpoint()
    probes = ann.probe_lists(asked, centroids, 6)
    listed = ann.assign_lists(points, centroids)
    monkeypatch.setattr(ranking, "SENT_BYTES", 0)
    monkeypatch.setattr(ranking, "_ROWS_HELD", 7)
    most = lambda found: found.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert most(ranking.listed_topk(listed, asked, probes, 5)) == 5
    assert 5 < most(ranking.listed_topk(listed, asked, probes, 5, breadths=[1, 6])) <= 10
