from types import SimpleNamespace

import brute
import pytest
from pyspark.sql import functions as F

from siftwell.operators.embed import embed_hashed
from siftwell.plans.search import search
from siftwell.sources import collection, labeled
from siftwell.streaming import ingest

DOC = "id bigint, tenant_id string, text string, category string, created_at bigint"


def points(spark, *rows):
    return embed_hashed(spark.createDataFrame(list(rows), DOC), 16)


def contents(df):
    return {r.id: (r.tenant_id, r.text) for r in df.collect()}


def test_collection_upserts_replays_and_compaction(spark, tmp_path):
    path, new = str(tmp_path / "c"), str(tmp_path / "d")
    base = points(spark, (1, "a", "one", "x", 1), (2, "a", "two", "x", 2), (3, "7", "three", "y", 3))
    collection.recreate_collection(base, path)
    assert contents(collection.read_collection(spark, path)) == {
        1: ("a", "one"), 2: ("a", "two"), 3: ("7", "three")
    }
    first = points(spark, (2, "a", "zwei", "x", 2), (4, "b", "vier", "x", 4))
    for _ in range(2):  # a replayed batch changes nothing
        collection.upsert_points(first, path, 1)
    collection.upsert_points(points(spark, (2, "b", "moved", "x", 9)), path, 2)
    want = {1: ("a", "one"), 2: ("b", "moved"), 3: ("7", "three"), 4: ("b", "vier")}
    current = collection.read_collection(spark, path)
    assert contents(current) == want
    asked = embed_hashed(
        spark.createDataFrame([(1, "a", "zwei two"), (2, "b", "moved")], "query_id bigint, tenant_id string, text string"),
        16,
    )
    found = brute.ranked(search(current, asked, "sparse", 5).collect())
    assert [i for i, _ in found[2]] == [2] and 1 not in found
    collection.compact_collection(spark, path, new)
    assert contents(collection.read_collection(spark, new)) == want
    collection.recreate_collection(base, path)
    assert len(contents(collection.read_collection(spark, path))) == 3
    with pytest.raises(ValueError):
        collection.compact_collection(spark, path, path + "/")
    with pytest.raises(ValueError):
        collection.upsert_points(base, path, 0)


def test_ingest_report_and_separate_vectors(spark, tmp_path):
    path = str(tmp_path / "c")
    docs = spark.createDataFrame([(i, "a", f"text {i}", "x", i) for i in range(20)], DOC)
    report = collection.ingest_documents(docs, lambda d: embed_hashed(d, 16), path).first()
    assert report.points == 20 and report.throughput == pytest.approx(20 / report.seconds)
    update = docs.where("id < 3").withColumn("text", F.lit("changed"))
    vectors = embed_hashed(update, 16).select("id", "dense", "sparse")
    again = collection.ingest_documents(
        update, lambda d: collection.attach_vectors(d, vectors), path, 1
    )
    assert again.first().points == 3
    current = collection.read_collection(spark, path)
    assert current.count() == 20 and current.where("text = 'changed'").count() == 3


def test_tenant_condition_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.recreate_collection(points(spark, (1, "a", "one", "x", 1), (2, "b", "two", "x", 2)), path)
    scan = spark.read.schema(collection.POINT).parquet(path).where("tenant_id = 'a' and created_at > 0")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan
    assert "GreaterThan(created_at,0)" in plan


def test_curve_takes_bits_in_turn(spark):
    from siftwell.sources.layout import z_value

    pairs = [(0, 0), (1, 0), (0, 1), (3, 5), (4095, 4095), (2741, 1365), (65535, 1)]
    df = spark.createDataFrame(pairs, "a int, b int")
    got = [r[0] for r in df.select(z_value(F.col("a"), F.col("b"))).collect()]
    assert got == [sum((a >> i & 1) << 2 * i + 1 | (b >> i & 1) << 2 * i for i in range(16)) for a, b in pairs]


def test_curve_layout_skips_row_groups(spark, tmp_path):
    from siftwell.sources.layout import z_ordered

    rows = spark.range(0, 60_000, 1, 1).select(
        "id", F.lit("a").alias("tenant_id"), F.md5(F.col("id").cast("string")).alias("text"),
        F.concat(F.lit("c"), F.xxhash64("id", F.lit(1)) % 16).alias("category"),
        F.when(F.col("id") % 100 > 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10**6))).alias("created_at"),
        F.array(F.lit(1.0)).alias("dense"),
        F.struct(F.array(F.lit(1).cast("bigint")).alias("indices"), F.array(F.lit(1.0)).alias("values")).alias("sparse"),
    )

    def read(path, condition):
        """Rows of the answer and rows that the scan handed out."""
        found = spark.read.schema(collection.POINT).parquet(path).where(condition).select("id", "category", "created_at")
        answer = {r.id for r in found.collect()}
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return answer, scan.metrics().apply("numOutputRows").value()

    small = {"parquet.block.size": "65536", "parquet.page.size": "8192", "parquet.page.row.count.limit": "500"}
    by_time, by_curve = str(tmp_path / "t"), str(tmp_path / "z")
    collection.recreate_collection(rows, by_time, **small)
    collection.recreate_collection(rows, by_curve, z_ordered, **small)
    both = "category = 'c3' AND created_at BETWEEN 200000 AND 320000"
    answer, scanned = read(by_curve, both)
    assert answer == read(by_time, both)[0] != set()
    assert scanned < 0.1 * 60_000 and scanned < 0.6 * read(by_time, both)[1]
    assert read(by_curve, "category = 'c3'")[1] < 0.4 * 60_000
    assert read(by_curve, "true")[0] == set(range(60_000))


def test_latest_within_one_batch(spark):
    rows = [(1, 1, "old"), (1, 3, "new"), (1, 2, "mid"), (2, 1, None)]
    df = spark.createDataFrame(rows, "id bigint, seq int, v string")
    assert {tuple(r) for r in collection.latest_by_id(df, "seq").collect()} == {(1, 3, "new"), (2, 1, None)}


def test_shared_dir_follows_the_session(spark):
    def session(setting, master):
        conf = SimpleNamespace(get=lambda name, default: {"spark.checkpoint.dir": setting}[name])
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    first = collection.shared_dir(session("hdfs://shared/dir/", "spark://host:7077"))
    second = collection.shared_dir(session("hdfs://shared/dir/", "spark://host:7077"))
    assert first.startswith("hdfs://shared/dir/siftwell-") and first != second
    with pytest.raises(RuntimeError):
        collection.shared_dir(session(None, "spark://host:7077"))
    assert collection.shared_dir(spark)


def test_labeled_corpus(spark, corpus):
    docs, queries = corpus
    assert len(docs) == 120 and len(queries) == 18
    assert [d.id for d in docs] == list(range(120))
    assert all(d.created_at == 1_700_000_000 + d.id * 3600 for d in docs)
    assert [d.tenant_id for d in docs[::40]] == ["acme", "globex", "initech"]
    topics = list(labeled.TOPIC_WORDS)
    assert [d.category for d in docs[:40:8]] == topics
    words = {c: w.split() for c, w in labeled.TOPIC_WORDS.items()}
    every = {w for ws in words.values() for w in ws} | set(labeled.COMMON_WORDS.split())
    for d in docs:
        text = d.text.split()
        assert 8 + 4 + 2 <= len(text) <= 14 + 8 + 12 and set(text) <= every
        assert sum(w in words[d.category] for w in text) >= 8
    for q in queries:
        *topical, shared = q.text.split()
        assert 3 <= len(topical) <= 4 and set(topical) <= set(words[q.category])
        assert shared in labeled.COMMON_WORDS.split()
    again, _ = labeled.labeled_dataset(spark, docs_per_topic=8, queries_per_tenant=6, seed=7)
    assert {r.id: r.text for r in again.repartition(7).collect()} == {d.id: d.text for d in docs}
    other, _ = labeled.labeled_dataset(spark, docs_per_topic=8, queries_per_tenant=6, seed=8)
    assert {r.id: r.text for r in other.collect()} != {d.id: d.text for d in docs}
    assert len({d.text for d in docs}) == 120


def test_vocabulary_of(spark):
    df = spark.createDataFrame([("x", "b b a c"), ("x", "a b"), ("y", "z")], "category string, text string")
    got = {r.category: r.words for r in labeled.vocabulary_of(df, 2).collect()}
    assert got == {"x": ["b", "a"], "y": ["z"]}


def write_files(spark, folder, *batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id bigint, tenant_id string, text string").coalesce(1)
        df = df.withColumns({"category": F.lit("c"), "created_at": F.col("id")})
        df.write.mode("append").parquet(folder)


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_files(spark, source, [(1, "a", "one"), (2, "a", "two")], [(3, "b", "three")])
    schema = spark.read.parquet(source).schema

    def run():
        arriving = ingest.read_files(spark, source, schema, files_per_batch=1)
        ingest.ingest_stream(arriving, lambda df: embed_hashed(df, 16), out, state)

    run()
    run()
    assert collection.read_collection(spark, out).count() == 3
    write_files(spark, source, [(4, "b", "four"), (2, "a", "changed")])
    run()
    stored = collection.read_collection(spark, out)
    assert {r.id: r.dense for r in stored.collect()} == {
        i: pytest.approx(brute.dense(t, 16)) for i, t in enumerate(("one", "changed", "three", "four"), 1)
    }


def test_streams_and_batches_keep_each_others_rows(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [(i, "a", f"base {i}") for i in range(6)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], DOC)
    embedder = lambda df: embed_hashed(df, 8)
    collection.ingest_documents(docs, embedder, path)
    collection.ingest_documents(docs.where("id = 1").withColumn("text", F.lit("upserted")), embedder, path, 1)

    def stream(name, *batches):
        source = str(tmp_path / name)
        write_files(spark, source, *batches)
        arriving = ingest.read_files(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
        ingest.ingest_stream(arriving, embedder, path, str(tmp_path / f"{name}-state"))

    stream("one", [(2, "a", "one")], [(3, "a", "one")])
    stream("two", [(3, "a", "two"), (4, "a", "two")])
    stream("one", [(4, "a", "one again")])
    want = {0: "base 0", 1: "upserted", 2: "one", 3: "two", 4: "one again", 5: "base 5"}
    assert {r.id: r.text for r in collection.read_collection(spark, path).collect()} == want
    assert collection.next_batch_seq(spark, path) == 6
    # The same number by another writer, and an id that moves to another tenant.
    moved = embedder(spark.createDataFrame([(5, "b", "moved", "c", 9)], DOC))
    collection.upsert_points(moved, path, 2)
    current = collection.read_collection(spark, path)
    assert {r.id: r.text for r in current.collect()} == want | {5: "moved"}
    assert {r.id for r in current.where("tenant_id = 'a'").collect()} == {0, 1, 2, 3, 4}


def test_statistics_follow_the_current_rows(spark, tmp_path):
    from siftwell.operators.idf import idf_table
    from siftwell.sources import statistics

    path = str(tmp_path / "c")
    statistics.recreate_with_statistics(
        points(spark, (1, "a", "one two", "x", 1), (2, "a", "two", "x", 1), (3, "b", None, "x", 1), (4, "b", "", "x", 1)), path
    )

    def same():
        current = collection.read_collection(spark, path)
        for scope in ("collection", "tenant"):
            want = idf_table(current, scope).collect()
            assert sorted(statistics.collection_idf(spark, path, scope).collect()) == sorted(want) != []
        totals = {r.tenant_id: (r.documents, r.tokens) for r in statistics.token_totals(spark, path).collect()}
        rows = current.select("tenant_id", "text").collect()
        assert totals == {
            t: (sum(r.tenant_id == t for r in rows), sum(len((r.text or "").split()) for r in rows if r.tenant_id == t))
            for t in {r.tenant_id for r in rows}
        }

    same()
    for _ in range(2):  # a batch that is written again changes nothing
        statistics.upsert_with_statistics(points(spark, (1, "a", "uno", "x", 2), (5, "c", "new two", "x", 2)), path, 2)
        same()
    statistics.upsert_with_statistics(points(spark, (2, "b", "two two three", "x", 3), (3, "b", "now", "x", 3)), path, 3)
    same()
    # A version that arrives late, and one of another writer with the same number.
    statistics.upsert_with_statistics(points(spark, (1, "a", "late", "x", 1), (4, "b", "late four", "x", 1)), path, 1)
    same()
    statistics.upsert_with_statistics(points(spark, (5, "a", "moved", "x", 4)), path, 2, "other")
    same()
    plan = statistics.collection_idf(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "_statistics" in plan and "sparse" not in plan


def test_tenant_condition_reaches_the_upserts(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.recreate_collection(points(spark, (1, "a", "one", "x", 1), (2, "b", "two", "x", 2)), path)
    collection.upsert_points(points(spark, (1, "a", "uno", "x", 3), (3, "b", "tre", "x", 3)), path, 1)
    found = collection.read_collection(spark, path).where("tenant_id = 'a'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "FileScan" in line and "text" in line]
    assert len(wide) == 2 and all("(tenant_id" in line.split("PartitionFilters")[1] for line in wide)
    assert contents(found) == {1: ("a", "uno")}


def test_counts_are_whole_between_batches(spark, tmp_path):
    path = str(tmp_path / "counts")
    schema = spark.createDataFrame([("a", 1)], "tenant_id string, n bigint").schema
    assert ingest.newest_counts(spark, path, schema).collect() == []
    spark.createDataFrame([("a", 1)], schema).write.parquet(f"{path}/batch=0")
    (tmp_path / "counts" / "batch=1").mkdir()  # a batch that is being written
    assert ingest.newest_counts(spark, path, schema).collect() == [("a", 1)]


def test_stream_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    write_files(spark, source, [(1, "a", ""), (2, "a", "")], [(3, "b", "")], [(4, "a", "")])
    schema = spark.read.parquet(source).schema
    stream = ingest.read_files(spark, source, schema, files_per_batch=1)
    counts = ingest.drain_counts(
        ingest.running_counts(stream, "tenant_id"), str(tmp_path / "counts"), str(tmp_path / "state")
    )
    assert {tuple(r) for r in counts.collect()} == {("a", 3), ("b", 1)}


def test_latency_bucket(spark):
    df = spark.createDataFrame([(0.001,), (0.0011,), (2.0,), (2.5,)], "s double")
    assert [r[0] for r in df.select(ingest.latency_bucket(F.col("s"))).collect()] == [
        "0.001", "0.002", "2.0", "+Inf",
    ]


def test_epoch_conversions(spark):
    from siftwell.schema import epoch_seconds, from_epoch

    df = spark.sql("select timestamp'2024-01-01 00:00:00' ts, 1704067200L s")
    row = df.select(epoch_seconds("ts").alias("a"), epoch_seconds(from_epoch("s")).alias("b")).first()
    assert (row.a, row.b) == (1704067200, 1704067200)


def test_last_document_of_an_id_wins_in_a_batch(spark, tmp_path):
    rows = [(1, "t", "old", "c", 1), (1, "t", "new", "c", 2), (2, "t", None, None, None)]
    docs = spark.createDataFrame(rows, "id bigint, tenant_id string, text string, category string, created_at bigint")
    path = str(tmp_path / "c")
    collection.ingest_documents(docs, lambda df: embed_hashed(df, 8), path)
    assert {(r.id, r.text) for r in collection.read_collection(spark, path).collect()} == {(1, "new"), (2, None)}


def test_documents_without_a_vector_stay(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string")
    vectors = spark.createDataFrame([(1, [1.0])], "id bigint, dense array<double>")
    got = {r.id: r.dense for r in collection.attach_vectors(docs, vectors).collect()}
    assert got == {1: [1.0], 2: None}
