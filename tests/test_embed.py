import math

import brute
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text, vectors
from siftwell.operators import embed
from siftwell.operators.idf import idf_table

TEXTS = ["", "!!!", "É", None, "Naïve CAFÉ déjà-vu 42", "a a a b B c1 c1", "x " * 500, "tab\tnew\nline"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(TEXTS))
    return spark.createDataFrame(rows, "id bigint, text string")


def test_tokens_and_hashes_match_plain_python(spark, texts):
    rows = texts.withColumn("t", F.explode(text.tokenize(F.col("text"))))
    for modulus in (1, 2, 97, 256, 384, 2**31 - 1, 2**31):
        for r in rows.select("t", text.hash_mod(F.col("t"), modulus).alias("h")).distinct().collect():
            assert r.h == brute.h(r.t, modulus)
    for r in rows.select("t", text.hash_sign(F.col("t")).alias("s")).collect():
        assert r.s == brute.sign(r.t)
    for r in texts.select("text", text.tokenize(F.col("text")).alias("t")).collect():
        assert r.t == brute.tokens(r.text)
    with pytest.raises(ValueError):
        text.hash_mod(F.lit("x"), 0)


@pytest.mark.parametrize("dim", [1, 2, 7, 384])
def test_hashed_embedding(texts, dim):
    for r in embed.embed_hashed(texts, dim).collect():
        assert r.dense == pytest.approx(brute.dense(r.text, dim), abs=1e-12)
        want = brute.sparse(r.text)
        assert r.sparse["indices"] == sorted(want)
        assert r.sparse["values"] == pytest.approx([want[i] for i in sorted(want)])


def test_long_batches_are_embedded_in_steps(spark, monkeypatch):
    monkeypatch.setattr(embed, "_TEXT_BYTES_PER_STEP", 50)
    rows = [(i, f"word{i} shared " * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    for r in embed.embed_hashed(df, 16).collect():
        assert r.dense == pytest.approx(brute.dense(r.text, 16))
        assert r.sparse["indices"] == sorted(brute.sparse(r.text))


def test_colliding_terms_merge_before_the_log():
    # with one index for all terms the three tokens are one entry of count 3
    original = embed.SPARSE_SPACE
    try:
        embed.SPARSE_SPACE = 1
        out = embed._embed_texts(["a b a"], 4, False, True).to_pylist()[0]
    finally:
        embed.SPARSE_SPACE = original
    assert out == {"n_tokens": 3, "indices": [0], "counts": [3.0]}


def test_long_form_agrees_with_the_arrays(texts):
    dims = embed.signed_hash_sums(texts, "id", 16).collect()
    got = {}
    for r in dims:
        got.setdefault(r.id, [0] * 16)[r.idx] = r.value
    for i, t in enumerate(TEXTS):
        v = got.get(i, [0] * 16)
        assert brute.unit(v) == pytest.approx(brute.dense(t, 16))


def test_bm25(spark):
    rows = [(0, "a a b"), (1, "b c c c d"), (2, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    avg = (3 + 5 + 0) / 3
    for r in embed.embed_bm25(df, 1.5, 0.6).collect():
        counts = brute.term_counts(r.text)
        length = sum(counts.values())
        want = [
            counts[i] * 2.5 / (counts[i] + 1.5 * (0.4 + 0.6 * length / avg)) for i in sorted(counts)
        ]
        assert r.sparse["values"] == pytest.approx(want)


def test_idf_counts_tokenless_documents(spark):
    rows = [(0, "x", "a b"), (1, "x", "b"), (2, "y", "!!"), (3, "y", "b")]
    df = embed.embed_hashed(spark.createDataFrame(rows, "id bigint, tenant_id string, text string"))
    want = {brute.h("a", 2**31): (1, 4), brute.h("b", 2**31): (3, 4)}
    for r in idf_table(df).collect():
        df_, n = want[r.idx]
        assert r.df == df_ and r.idf == pytest.approx(math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)))
    by_tenant = {(r.tenant_id, r.idx): r.df for r in idf_table(df, "tenant").collect()}
    b = brute.h("b", 2**31)
    assert by_tenant == {("x", brute.h("a", 2**31)): 1, ("x", b): 2, ("y", b): 1}
    with pytest.raises(ValueError):
        idf_table(df, "galaxy")


def test_vector_functions(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(vectors.l2_norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(5.0, 0.96), (1.0, 0.0)]


def test_embedder_names(spark, texts):
    dims = texts.where("id = 5")
    assert len(embed.build_embedder("HASH", dim=8)(dims).first().dense) == 8
    assert "sparse" in embed.build_embedder("bm25", dim=8)(texts).columns
    model = embed.build_embedder("model", lambda: lambda batch: [[len(t), 1] for t in batch])
    assert [r.dense for r in model(texts.where("id < 4")).orderBy("id").collect()] == [
        [0.0, 1.0], [3.0, 1.0], [1.0, 1.0], [0.0, 1.0],
    ]
    with pytest.raises(ValueError):
        embed.build_embedder("nope")
    with pytest.raises(ValueError):
        embed.build_embedder("model")


def test_dense_length_is_checked(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id bigint, dense array<double>")
    with pytest.raises(Exception, match="needs 2 values"):
        embed.check_dense_dim(df, 2).collect()
