import random
import statistics

import brute
import numpy
import pytest
from pyspark.sql import functions as F

from siftwell.operators import ann, metrics, prefix
from siftwell.operators.percentiles import exact_percentiles
from siftwell.operators.ranking import exact_topk
from siftwell.plans import evaluate, report
from siftwell.plans.benchmark import run_benchmark
from siftwell.plans.search import search, search_modes
from siftwell.schema import MODES


def interpolated(values, p):
    return float(numpy.quantile(values, p)) if len(values) else 0.0


def recall(got, relevant, k):
    """Relevant ids among the first k, of those that fit into k places."""
    if not relevant:
        return 0.0
    marks = [i in relevant for i in dict.fromkeys(got[:k])]
    return sum(marks) / min(k, len(relevant))


def by_mode(spark, values):
    rows = [(m, float(v) if v is not None else None) for m, vs in values.items() for v in vs]
    return spark.createDataFrame(rows, "mode string, latency_ms double").repartition(3)


def test_percentile_cases(spark):
    log = by_mode(spark, {"none": [None], "one": [10], "four": [1, 2, 3, 4]})
    got = {
        (r.mode, r.fraction): r.value
        for r in exact_percentiles(log, "mode", "latency_ms", [0.5, 0.95]).collect()
    }
    assert got[("none", 0.95)] == 0.0
    assert got[("one", 0.95)] == 10
    assert got[("four", 0.5)] == 2.5
    assert got[("four", 0.95)] == pytest.approx(3.85)


def test_percentiles_of_a_hot_skewed_group(spark):
    rng = random.Random(5)
    hot = [7.0] * 4000 + [rng.lognormvariate(0, 3) for _ in range(8000)] + [1e300, -5.0]
    values = {"hot": hot, "small": [rng.random() for _ in range(9)], "pair": [1.0, 2.0]}
    fractions = [0.0, 0.1, 0.333, 0.5, 0.95, 0.99, 0.9999, 1.0]
    rows = exact_percentiles(by_mode(spark, values), "mode", "latency_ms", fractions).collect()
    assert len(rows) == len(values) * len(fractions)
    for r in rows:
        assert r.value == pytest.approx(interpolated(values[r.mode], r.fraction), rel=1e-12)


def test_percentiles_stay_exact_when_the_sketch_is_poor(spark, monkeypatch):
    from siftwell.operators import percentiles

    monkeypatch.setattr(percentiles, "_ACCURACY", 2)
    monkeypatch.setattr(percentiles, "_MARGIN", 1e-6)
    values = {"a": [float(i * i % 1009) for i in range(1500)]}
    rows = exact_percentiles(by_mode(spark, values), "mode", "latency_ms", [0.25, 0.5, 0.99])
    for r in rows.collect():
        assert r.value == interpolated(values["a"], r.fraction)


def test_recall_cases(spark):
    cases = [([1, 2, 3], [2, 3], 5, 1.0), ([9, 8, 7], [1, 2], 3, 0.0), ([1, 9, 9], [1, 2], 3, 0.5),
             ([4], [], 5, 0.0), ([], [1], 5, 0.0), ([1, 2], [1, 1, 2, 3], 2, 1.0)]
    hits = [("dense", "t", q, i, r) for q, c in enumerate(cases) for r, i in enumerate(c[0], 1)]
    marks = [("t", q, d) for q, c in enumerate(cases) for d in c[1]]
    hits = spark.createDataFrame(hits, "mode string, tenant_id string, query_id bigint, id bigint, rank int")
    marks = spark.createDataFrame(marks, "tenant_id string, query_id bigint, doc_id bigint")
    asked = spark.createDataFrame([("t", q) for q in range(len(cases))], "tenant_id string, query_id bigint")
    rows = evaluate.recall_by_list(hits, asked, marks, (2, 3, 5), labels=("dense",)).collect()
    got = {r.query_id: r.asDict() for r in rows}
    for q, (_, _, k, want) in enumerate(cases):
        assert got[q][f"recall_at_{k}"] == want
    with pytest.raises(ValueError):
        evaluate.recall_by_list(hits, asked, marks, (0,))


def test_mode_summary_invariants(spark, corpus, tables):
    docs, queries = corpus
    documents, points, asked = tables
    hits = search_modes(points, asked, 10)
    per_query = evaluate.recall_by_category(hits, asked, documents)
    relevant = {
        q.query_id: [d.id for d in docs if (d.tenant_id, d.category) == (q.tenant_id, q.category)]
        for q in queries
    }
    for mode in MODES:
        got = brute.ranked(search(points, asked, mode, 10).collect())
        for r in per_query.where(F.col("mode") == mode).collect():
            ids = [i for i, _ in got[r.query_id]]
            assert r.recall_at_5 == recall(ids, relevant[r.query_id], 5)
            assert r.recall_at_10 == recall(ids, relevant[r.query_id], 10)
    log = by_mode(spark, {m: [1.0, 2.0, 5.0 + i] for i, m in enumerate(MODES)})
    index = evaluate.index_recall(search(points, asked, "dense", 10), exact_topk(points, asked, 10), asked)
    rows = evaluate.mode_summary(
        per_query, metrics.latency_percentiles(log), metrics.mode_throughput(log), index, {"nprobe": 4}
    ).collect()
    assert {r["mode"] for r in rows} == set(MODES)
    for r in rows:
        assert 0.0 <= r.recall_at_5 <= 1.0 and 0.0 <= r.recall_at_10 <= 1.0
        assert r.p99_ms >= r.p95_ms >= r.p50_ms >= 0.0 and r.qps > 0
        assert r.n_queries == len(queries) and r.nprobe == 4
        assert r.index_recall_at_10 == (1.0 if r["mode"] == "dense" else None)


def test_run_benchmark(spark, corpus, tables):
    _, queries = corpus
    _, points, asked = tables
    log = by_mode(spark, {m: [1.0, 2.0, 5.0 + i] for i, m in enumerate(MODES)})
    centroids = ann.seed_centroids(points, 4)
    rough = ann.ivf_search(points, asked, centroids, nprobe=1)
    rows = run_benchmark(points, asked, log, approximate=rough, settings={"nprobe": 1}, ks=(3, 5, 10))
    got = {r["mode"]: r for r in rows.collect()}
    assert set(got) == set(MODES)
    assert 0.0 < got["dense"].index_recall_at_10 < 1.0 and got["sparse"].index_recall_at_10 is None
    for r in got.values():
        assert r.n_docs == 120 and r.n_queries == len(queries) and 0.0 <= r.recall_at_3 <= 1.0
    lines = report.markdown_rows(rows).collect()
    assert len(lines) == 3 and all(line.line.count("|") == 9 for line in lines)


def test_relevant_sets(corpus, tables):
    docs, _ = corpus
    rows = evaluate.relevant_sets(tables[0]).collect()
    assert len(rows) == len(docs) and all(r.n_relevant == 8 for r in rows)


def test_report_rows(spark):
    schema = (
        "mode string, recall_at_5 double, recall_at_10 double, index_recall_at_10 double, "
        "p50_ms double, p95_ms double, p99_ms double, qps double"
    )
    rows = [("dense", 0.8125, 1.0, float("nan"), 1.0, 2.345, 3.0, 2.5), ("sparse", 0.0, 0.5, None, 1.0, 2.0, 3.0, 99.5)]
    df = spark.createDataFrame(rows, schema)
    lines = {r["mode"]: r.line for r in report.markdown_rows(df).collect()}
    assert lines["dense"] == "| dense | 0.812 | 1.000 | n/a | 1.00 | 2.35 | 3.00 | 2 |"
    assert lines["sparse"] == "| sparse | 0.000 | 0.500 | n/a | 1.00 | 2.00 | 3.00 | 100 |"
    text = report.json_rows(df.select("mode", "index_recall_at_10")).collect()[1].json
    assert text == '{"mode":"sparse","index_recall_at_10":null}'
    assert report.settings_line({"docs": 3, "nprobe": 8}) == "docs=3 nprobe=8"


def test_histogram_and_throughput(spark):
    values = {"a": [1.0, 1.5, 2000.0, 2000.1], "b": [0.0]}
    rows = metrics.latency_histogram(by_mode(spark, values)).collect()
    assert len(rows) == 2 * 12
    a = {r.le: r.n for r in rows if r["mode"] == "a"}
    assert (a["0.001"], a["0.002"], a["2.0"], a["+Inf"]) == (1, 2, 3, 4)
    assert all(r["count"] == 4 for r in rows if r["mode"] == "a")
    qps = {r["mode"]: r.qps for r in metrics.mode_throughput(by_mode(spark, values)).collect()}
    assert qps["b"] == 0.0 and qps["a"] == pytest.approx(4 / 4.0026)
    log = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,0,id) ts from range(11)")
    assert tuple(metrics.ingest_throughput(log).first()) == (11, 10.0, 1.1)
    assert tuple(metrics.ingest_throughput(log.limit(1)).first()) == (1, 0.0, 1.0)
    assert tuple(metrics.ingest_throughput(log.limit(0)).first()) == (0, 0.0, 0.0)
    gauges = spark.createDataFrame([("x", 1, 5.0), ("x", 3, 7.0), ("y", 2, 1.0)], "k string, ts int, v double")
    assert {tuple(r) for r in metrics.last_values(gauges, ["k"], "v", "ts").collect()} == {("x", 7.0), ("y", 1.0)}


def test_batches_and_running_totals_across_ranges(spark, monkeypatch):
    ids = [i * 7 - 300 for i in range(400)]
    rows = [("hot" if n % 4 else "cold", i) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "tenant_id string, id bigint").repartition(5)
    want, seen = {}, {}
    for tenant, i in sorted(rows, key=lambda r: r[1]):
        seen[tenant] = seen.get(tenant, 0) + 1
        want[i] = (seen[tenant] - 1) // 9
    for width in (None, 1, 7):
        monkeypatch.setattr(prefix.running_total, "__defaults__", (width,))
        got = {r.id: r.batch_no for r in prefix.with_batch_numbers(df, 9).collect()}
        assert got == want
    totals = prefix.running_counts(prefix.with_batch_numbers(df, 9)).collect()
    last = {}
    for r in sorted(totals, key=lambda r: r.batch_no):
        last[r.tenant_id] = last.get(r.tenant_id, 0) + r.n
        assert r.total == last[r.tenant_id]
    assert last == seen


def vectors(spark, n=240, dim=12, seed=3):
    rng = random.Random(seed)
    rows = [
        (i, f"t{min(i % 6, 3)}", [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id bigint, tenant_id string, dense array<double>").repartition(3)


@pytest.mark.parametrize("limit, held", [(64 << 20, 64 << 20), (40_000, 1500)])
def test_inverted_lists(spark, limit, held):
    rows, points = vectors(spark)
    points = points.cache()
    queries = points.withColumnRenamed("id", "query_id")
    centroids = ann.seed_centroids(points, 5).cache()
    cents = {}
    for c in centroids.collect():
        cents.setdefault(c.tenant_id, {})[c.list_id] = c.dense
    assert all(sorted(c) == list(range(5)) for c in cents.values())

    def order(tenant, v):
        near = cents[tenant]
        return sorted(near, key=lambda i: (-round(brute.cosine(v, near[i]), 9), i))

    listed = ann.assign_lists(points, centroids, slice_bytes=held).cache()
    home = {r.id: r.list_id for r in listed.collect()}
    assert home == {i: order(t, v)[0] for i, t, v in rows}

    swept = ann.ivf_sweep(listed, queries, centroids, [1, 3, 5, 3], limit=6, slice_bytes=limit)
    swept = swept.collect()
    for nprobe in (1, 3, 5):
        got = brute.ranked([r for r in swept if r.nprobe == nprobe])
        single = ann.ivf_search(listed, queries, centroids, nprobe, 6, slice_bytes=limit)
        assert brute.ranked(single.collect()) == got
        for i, t, v in rows:
            lists = order(t, v)[:nprobe]
            near = sorted(
                ((round(brute.cosine(v, w), 9), j) for j, u, w in rows if u == t and home[j] in lists),
                reverse=True,
            )[:6]
            brute.same(got[i], [(j, s) for s, j in near])
    exact = brute.ranked(exact_topk(points, queries, 6).collect())
    assert exact == brute.ranked([r for r in swept if r.nprobe == 5])
    hits = spark.createDataFrame(swept)
    recalls = evaluate.index_recall(hits, exact_topk(points, queries, 6), queries, 6, "nprobe", [1, 3, 5])
    means = {r.nprobe: r.recall_at_6 for r in evaluate.mean_recall(recalls, "nprobe").collect()}
    assert means[1] < means[3] < means[5] == 1.0


def test_list_arguments(spark):
    _, points = vectors(spark, 6)
    with pytest.raises(ValueError):
        ann.seed_centroids(points, 0)
    with pytest.raises(ValueError):
        ann.probe_lists(points, points, 0)
    with pytest.raises(ValueError):
        ann.breadth_values(0)
    assert ann.breadth_values(32, 64, 128, 32) == [32, 64, 128]


def test_summary_statistics_agree_with_the_standard_library(spark):
    values = {"m": [float(x) for x in range(1, 42)]}
    row = metrics.latency_percentiles(by_mode(spark, values)).first()
    assert row.p50_ms == statistics.median(values["m"])


def test_percentiles_of_nan_and_null_keys(spark):
    nan = float("nan")
    log = spark.createDataFrame(
        [("m", 1.0), ("m", 2.0), ("m", nan), (None, 1.0), (None, 1.0), ("none", None)],
        "mode string, latency_ms double",
    )
    got = {r.mode: r for r in metrics.latency_percentiles(log).collect()}
    assert got["m"].p50_ms == 2.0 and got["m"].p99_ms != got["m"].p99_ms
    assert got[None].p99_ms == 1.0 and got["none"].p50_ms == 0.0


def test_numbering_keeps_null_keys_orders_and_sparse_ids(spark):
    rows = [("a", i * 7919**3) for i in range(50)] + [(None, 5), (None, 3), ("b", None), ("b", 1)]
    df = spark.createDataFrame(rows, "tenant_id string, id bigint").repartition(5)
    got = {(r.tenant_id, r.id): r.batch_no for r in prefix.with_batch_numbers(df, 10).collect()}
    assert got == {**{("a", i * 7919**3): i // 10 for i in range(50)}, (None, 3): 0, (None, 5): 0, ("b", None): 0, ("b", 1): 0}


def test_seeds_are_cut_before_the_shuffle(spark):
    _, points = vectors(spark)
    plan = ann.seed_centroids(points, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_seeds_have_vectors_and_are_distinct(spark):
    rows = [("t", i, [float(i), 1.0] if i % 25 == 0 else None) for i in range(500)]
    rows += [("t", 0, [9.0, 9.0]), ("t", 25, [25.0, 1.0])]
    points = spark.createDataFrame(rows, "tenant_id string, id bigint, dense array<float>")
    seeds = ann.seed_centroids(points, 8).collect()
    assert sorted(s.list_id for s in seeds) == list(range(8))
    known = {tuple(r[2]) for r in rows[:500] if r[2]}
    assert len({tuple(s.dense) for s in seeds} & known) == 8
    asked = spark.createDataFrame([("t", 1, [100.0, 1.0])], "tenant_id string, query_id bigint, dense array<float>")
    with_vector = points.where("dense IS NOT NULL").dropDuplicates(["id"])
    found = ann.ivf_search(with_vector, asked, ann.seed_centroids(points, 8), nprobe=8, limit=6)
    exact = exact_topk(with_vector, asked, 6)
    assert [r.id for r in found.orderBy("rank").collect()] == [r.id for r in exact.where("mode = 'dense'").orderBy("rank").collect()]


def test_null_groups_are_relevant_sets(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, "a", None)]
    docs = spark.createDataFrame(rows, "id bigint, tenant_id string, category string")
    got = {r.id: r.n_relevant for r in evaluate.relevant_sets(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2}


@pytest.mark.parametrize("margin", [None, 0.0])
def test_percentiles_of_open_brackets(spark, monkeypatch, margin):
    """Fractions at the ends, infinities, and brackets that fail their proof."""
    from siftwell.operators import percentiles

    if margin is not None:
        monkeypatch.setattr(percentiles, "_MARGIN", margin)
    draw = numpy.random.default_rng(4)
    values = {"plain": draw.normal(size=3000), "ties": numpy.repeat([1.0, 2.0, 7.0], 700)}
    values["wide"] = numpy.r_[draw.normal(size=500), [-numpy.inf] * 3, [numpy.inf] * 4]
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    fractions = [0.0, 0.0001, 0.25, 0.5, 0.9999, 1.0]
    got = {(r.k, r.fraction): r.value for r in percentiles.exact_percentiles(df, "k", "v", fractions).collect()}
    for k, v in values.items():
        with numpy.errstate(invalid="ignore"):
            want = numpy.sort(v)
        for f in fractions:
            at = f * (len(v) - 1)
            low, high = want[int(numpy.floor(at))], want[int(numpy.ceil(at))]
            exact = low if low == high else low + (high - low) * (at - numpy.floor(at))
            assert got[k, f] == pytest.approx(exact) or numpy.isinf(exact) and got[k, f] == exact
