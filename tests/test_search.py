import brute
import pytest
from pyspark.sql import functions as F

from siftwell.operators import filters
from siftwell.operators.embed import embed_hashed
from siftwell.operators.idf import idf_table, weight_queries
from siftwell.operators.ranking import block_topk, clamp_limit, exact_topk, take_top
from siftwell.plans.search import limit_per_query, search, search_modes, with_payload
from siftwell.schema import MODES

DIM = 256
FILTERS = "category_filter string, created_after bigint, created_before bigint"


def ask(spark, *rows, filters=False):
    schema = "query_id bigint, tenant_id string, text string" + (", " + FILTERS if filters else "")
    return embed_hashed(spark.createDataFrame(list(rows), schema), DIM)


def expected(mode, docs, q, k, prefetch=50):
    if mode == "dense":
        return brute.dense_hits(docs, q, k, DIM)
    if mode == "sparse":
        return brute.sparse_hits(docs, q, k)
    return brute.hybrid_hits(docs, q, k, DIM, prefetch)


SLICES = (1 << 26, 25_000)  # one slice of queries, several


@pytest.mark.parametrize("size", SLICES)
@pytest.mark.parametrize("mode", MODES)
def test_modes_match_brute_force(corpus, tables, mode, size):
    docs, queries = corpus
    _, points, asked = tables
    got = brute.ranked(search(points, asked, mode, 10, slice_bytes=size).collect())
    assert set(got) == {q.query_id for q in queries}
    for q in queries:
        brute.same(got[q.query_id], expected(mode, docs, q, 10))


def test_prefetch_truncates_each_branch(corpus, tables):
    docs, queries = corpus
    _, points, asked = tables
    got = brute.ranked(search(points, asked, "hybrid", 20, prefetch_limit=4).collect())
    for q in queries:
        brute.same(got[q.query_id], expected("hybrid", docs, q, 20, prefetch=4))
        assert len(got[q.query_id]) <= 8


def test_one_pass_gives_all_modes(tables):
    _, points, asked = tables
    together = search_modes(points, asked, 7).collect()
    for mode in MODES:
        alone = search(points, asked, mode, 7).collect()
        assert brute.ranked([r for r in together if r["mode"] == mode]) == brute.ranked(alone)


def test_blocks_and_slices_do_not_change_results(monkeypatch, tables):
    from siftwell.operators import blocks, ranking

    _, points, asked = tables
    idf = idf_table(points)
    want = brute.ranked(search(points, asked, "hybrid", 10, idf=idf).collect())
    monkeypatch.setattr(blocks, "_CELLS_PER_STEP", 10)
    for rows, size in ((7, 1 << 30), (10_000, 20_000)):
        monkeypatch.setattr(ranking, "BLOCK_DOCS", rows)
        monkeypatch.setattr(ranking, "BLOCK_BYTES", size)
        for part in SLICES:
            found = search(points, asked, "hybrid", 10, idf=idf, slice_bytes=part)
            assert brute.ranked(found.collect()) == want


def test_many_slices_never_move_the_documents(tables, monkeypatch):
    from siftwell.operators import ranking

    _, points, asked = tables
    plans = []
    score = ranking._score_slice

    def watched(*args):
        found, shared = score(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found, shared

    monkeypatch.setattr(ranking, "_score_slice", watched)
    got = brute.ranked(exact_topk(points, asked, 3, slice_bytes=20_000).collect())
    assert len(plans) >= 3 and got == brute.ranked(exact_topk(points, asked, 3).collect())
    for plan in plans:
        assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
        assert "hashpartitioning(tenant_id" not in plan.split("BroadcastExchange")[0]


def test_broken_and_missing_vectors(spark):
    nan = float("nan")
    rows = [(i, "t", [1.0, i / 10]) for i in range(6)]
    rows += [(6, "t", [nan, 1.0]), (7, "t", None), (8, "t", [None, 1.0]), (9, "u", None)]
    points = spark.createDataFrame(rows, "id bigint, tenant_id string, dense array<double>").coalesce(1)
    asked = spark.createDataFrame(
        [(1, "t", [1.0, 0.0]), (2, "t", None), (3, "u", [1.0, 0.0])],
        "query_id bigint, tenant_id string, dense array<double>",
    )
    for k in (1, 3, 6, 8, 20):
        got = exact_topk(points, asked, k).orderBy("rank").collect()
        assert [r.id for r in got] == [0, 1, 2, 3, 4, 5, 8, 6][:k]
        assert [r.score is None for r in got] == [False] * min(k, 6) + [True] * max(0, min(k, 8) - 6)
        assert {r.query_id for r in got} == {1}


def test_breadth_of_search(tables):
    from siftwell.operators import ann

    _, points, asked = tables
    centroids = ann.seed_centroids(points, 4)
    for mode in ("dense", "hybrid"):
        whole = brute.ranked(search(points, asked, mode, 8).collect())
        found = search(points, asked, mode, 8, centroids=centroids, nprobe=4)
        assert brute.ranked(found.collect()) == whole
        narrow = search(points, asked, mode, 8, centroids=centroids, nprobe=1).collect()
        assert narrow and brute.ranked(narrow) != whole


def test_hot_tenant_is_split_and_stays_exact(spark, monkeypatch):
    from siftwell.operators import ranking

    monkeypatch.setattr(ranking, "BLOCK_DOCS", 64)
    rows = [
        (i, "hot" if i % 3 else f"cold{i % 5}", f"word{i % 11} word{i % 7} item{i}", "c", i)
        for i in range(900)
    ]
    docs = [dict(zip(("id", "tenant_id", "text", "category", "created_at"), r)) for r in rows]
    schema = "id bigint, tenant_id string, text string, category string, created_at bigint"
    points = embed_hashed(spark.createDataFrame(rows, schema), DIM)
    asked = ask(spark, (1, "hot", "word3 word5 item8"), (2, "cold2", "word3 item12"))
    for size in SLICES:
        got = brute.ranked(search(points, asked, "hybrid", 10, slice_bytes=size).collect())
        for i, tenant, text in ((1, "hot", "word3 word5 item8"), (2, "cold2", "word3 item12")):
            want = expected("hybrid", docs, {"tenant_id": tenant, "text": text}, 10)
            brute.same(got[i], want)


def test_ties_zero_vectors_and_missing_terms(spark):
    rows = [(1, "t", "same words"), (5, "t", "same words"), (3, "t", "!!"), (4, "t", ""), (9, "u", "same")]
    points = embed_hashed(spark.createDataFrame(rows, "id bigint, tenant_id string, text string"), DIM)
    asked = ask(spark, (1, "t", "same words"), (2, "t", "É"), (3, "t", "absent"), (4, None, "same"), (5, "v", "same"))
    dense = brute.ranked(search(points, asked, "dense", 10).collect())
    assert [i for i, _ in dense[1]] == [5, 1, 4, 3]
    assert dense[2] == [(5, 0.0), (4, 0.0), (3, 0.0), (1, 0.0)]
    assert set(dense) == {1, 2, 3}
    sparse = brute.ranked(search(points, asked, "sparse", 10).collect())
    assert set(sparse) == {1} and [i for i, _ in sparse[1]] == [1, 5]
    hybrid = brute.ranked(search(points, asked, "hybrid", 10).collect())
    assert set(hybrid) == {1, 2, 3}


def test_many_equal_scores_are_cut_exactly(spark):
    rows = [(i, "t", "copy of one text") for i in range(300)]
    points = embed_hashed(spark.createDataFrame(rows, "id bigint, tenant_id string, text string"), DIM)
    asked = ask(spark, (1, "t", "copy"))
    for size in SLICES:
        dense = brute.ranked(search(points, asked, "dense", 5, slice_bytes=size).collect())
        assert [i for i, _ in dense[1]] == [299, 298, 297, 296, 295]
        sparse = brute.ranked(search(points, asked, "sparse", 5, slice_bytes=size).collect())
        assert [i for i, _ in sparse[1]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("mode", MODES)
def test_per_query_filters(spark, corpus, tables, mode):
    docs, _ = corpus
    _, points, _ = tables
    acme = sorted(d.created_at for d in docs if d.tenant_id == "acme")
    rows = [
        (1, "acme", "router packet latency", "networking", None, None),
        (2, "acme", "database index query", None, acme[2], acme[6]),
        (3, "acme", "database index query", None, acme[30], None),
        (4, "acme", "database index query", None, None, acme[4]),
        (5, "globex", "index risk oven", "cooking", acme[0], acme[-1]),
        (6, "acme", "database index query", "", None, None),
        (7, "acme", "index query", None, None, None),
    ]
    names = ("query_id", "tenant_id", "text", "category_filter", "created_after", "created_before")
    for size in SLICES:
        asked = ask(spark, *rows, filters=True)
        got = brute.ranked(search(points, asked, mode, 50, slice_bytes=size).collect())
        for r in rows:
            want = expected(mode, docs, dict(zip(names, r)), 50)
            brute.same(got.get(r[0], []), want)
    assert 6 not in got and 5 not in got


def test_range_bounds_are_inclusive(spark, corpus, tables):
    docs, _ = corpus
    documents, points, _ = tables
    acme = sorted((d.created_at, d.id) for d in docs if d.tenant_id == "acme")
    asked = ask(
        spark, (1, "acme", "database index query", None, acme[2][0], acme[6][0]), filters=True
    )
    found = search(points, asked, "dense", 50)
    assert {r.id for r in found.collect()} == {i for _, i in acme[2:7]}
    assert filters.range_violations(found, documents, asked).count() == 0


def test_scalar_filter_reaches_below_the_ranking(corpus, tables, spark):
    docs, _ = corpus
    _, points, _ = tables
    asked = ask(spark, (1, "acme", "router packet latency"))
    found = search(points, asked, "hybrid", 20, documents=F.col("category") == "networking")
    rows = found.collect()
    by_id = {d.id: d for d in docs}
    assert len(rows) == 8 and all(by_id[r.id].category == "networking" for r in rows)


def test_unknown_creation_time_fails_a_range(spark):
    rows = [(1, "t", "word", None), (2, "t", "word", 5)]
    points = embed_hashed(
        spark.createDataFrame(rows, "id bigint, tenant_id string, text string, created_at bigint"), DIM
    )
    timed = ask(spark, (1, "t", "word", None, 0, None), (2, "t", "word", None, None, None), filters=True)
    got = brute.ranked(search(points, timed, "dense", 5).collect())
    assert [i for i, _ in got[1]] == [2] and [i for i, _ in got[2]] == [2, 1]


@pytest.mark.parametrize("mode", MODES)
def test_isolation(corpus, tables, spark, mode):
    docs, _ = corpus
    documents, points, _ = tables
    names = sorted({d.tenant_id for d in docs})
    asked = ask(
        spark,
        *[(i, t, "database index query") for i, t in enumerate(names)],
        *[(10 + i, t, docs[0].text) for i, t in enumerate(names) if t != docs[0].tenant_id],
    )
    found = search(points, asked, mode, 50)
    owner = {d.id: d.tenant_id for d in docs}
    rows = found.collect()
    assert {r.query_id for r in rows} == {0, 1, 2, 11, 12}
    assert all(owner[r.id] == r.tenant_id for r in rows)
    assert filters.foreign_hits(found, documents).count() == 0
    wrong = found.withColumn("tenant_id", F.lit("nobody"))
    assert filters.foreign_hits(wrong, documents).count() == len(rows)


def test_filters_and_limits(spark, tables, corpus):
    documents, points, asked = tables
    assert documents.where(filters.document_filter("acme", "cooking")).count() == 8
    assert documents.where(filters.document_filter("acme", "")).count() == 0
    first = min(d.created_at for d in corpus[0])
    assert documents.where(filters.document_filter("acme", None, first, first)).count() == 1
    with pytest.raises(ValueError):
        filters.document_filter(None)
    queries = spark.createDataFrame(
        [(1, "acme"), (2, "nobody"), (3, None)], "query_id bigint, tenant_id string"
    )
    unknown = filters.unknown_tenant_queries(queries, documents)
    assert {r.query_id for r in unknown.collect()} == {2, 3}
    ks = spark.createDataFrame([(-3,), (0,), (7,), (99,)], "k int")
    assert [r[0] for r in ks.select(clamp_limit("k")).collect()] == [1, 1, 7, 20]
    found = search(points, asked, "dense", 20)
    cut = limit_per_query(found, asked, clamp_limit(F.col("query_id")))
    sizes = {r["query_id"]: r["count"] for r in cut.groupBy("query_id").count().collect()}
    assert sizes == {q: max(1, min(q, 20)) for q in range(18)}


def test_payload_defaults(spark):
    docs = spark.createDataFrame(
        [(1, "t", None, None)], "id bigint, tenant_id string, text string, category string"
    )
    hits = spark.createDataFrame([(1, "t", 1)], "query_id bigint, tenant_id string, id bigint")
    row = with_payload(hits, docs).first()
    assert (row.text, row.category) == ("", "")


def test_arguments(tables):
    _, points, asked = tables
    with pytest.raises(ValueError, match="no search mode"):
        search(points, asked, "fuzzy")
    with pytest.raises(ValueError, match="at least 1"):
        exact_topk(points, asked, 0)
    with pytest.raises(ValueError, match="missing columns"):
        search(points.drop("tenant_id"), asked, "dense")


def test_uneven_vectors_are_rejected(spark):
    rows = [(1, "t", [1.0, 0.0]), (2, "t", [1.0])]
    points = spark.createDataFrame(rows, "id bigint, tenant_id string, dense array<double>").coalesce(1)
    asked = points.withColumnRenamed("id", "query_id").where("query_id = 1")
    with pytest.raises(Exception, match="equal lengths"):
        exact_topk(points, asked, 1).collect()


def test_weighting_keeps_queries_without_terms(spark, tables):
    _, points, _ = tables
    asked = ask(spark, (1, "acme", "zzzz"), (2, "acme", "index"))
    rows = {r.query_id: r.sparse for r in weight_queries(asked, idf_table(points)).collect()}
    assert rows[1]["indices"] == [] and len(rows[2]["indices"]) == 1


def test_rank_bound_is_pushed_before_the_shuffle(tables):
    _, points, asked = tables
    plan = take_top(block_topk(points, asked, 5), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "MapInArrow" in plan
