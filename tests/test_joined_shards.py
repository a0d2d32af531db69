"""Small shards of an index are walked together."""

from siftwell.operators import inverted
from siftwell.operators.embed import embed_hashed
from siftwell.operators.idf import idf_table
from siftwell.plans.search import search


def test_a_query_walks_few_shards(spark, tmp_path):
    """Each of 15 shards used to cost a walk of its own, and a block for every term."""
    rows = [(i, "t" if i < 300 else "u", f"same word{i % 7}" + " more" * (i % 3)) for i in range(310)]
    points = embed_hashed(spark.createDataFrame(rows, "id bigint, tenant_id string, text string"), dense=False).localCheckpoint()
    inverted.write_index(points, str(tmp_path / "index"), shard_docs=20)
    shards = inverted.read_postings(spark, str(tmp_path / "index")).select("tenant_id", "shard").distinct()
    assert shards.count() == 16
    asked = [(1, "t", "same"), (2, "t", "word3 more"), (3, "u", "same word2"), (4, "v", "same")]
    queries = embed_hashed(spark.createDataFrame(asked, "query_id bigint, tenant_id string, text string"), dense=False)
    idf = idf_table(points)
    work = {r.query_id: r.blocks for r in inverted.index_work(spark, str(tmp_path / "index"), queries, idf).collect()}
    assert work[1] == 5  # 300 documents in blocks of 64
    columns = ["query_id", "rank", "id", "score"]
    got = inverted.index_search(spark, str(tmp_path / "index"), queries, idf, 12).select(columns)
    assert sorted(got.collect()) == sorted(search(points, queries, "sparse", 12, idf=idf).select(columns).collect())
