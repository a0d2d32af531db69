"""Embedders: text column -> dense vector and sparse term weights.

The hashed embedder is one Arrow UDF call per row batch. Each document is
embedded where it is read, so ingest is a single map stage: no token is ever
shuffled, however long or skewed the texts are. (An explode / groupBy of the
token stream gives the same numbers, see ``term_frequencies``, but moves every
token of the corpus through a shuffle.)
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from siftwell.functions.rows import explode_rows
from siftwell.functions.text import (
    SIGN_SUFFIX,
    SPARSE_SPACE,
    TOKEN_PATTERN,
    hash_mod,
    hash_sign,
    tokenize,
)
from siftwell.schema import DENSE_DIM, require_columns
from siftwell.sources.collection import stored

_TOKENS = re.compile(TOKEN_PATTERN)
#: Texts embedded in one go; a row counts as so many bytes more, for its dense vector.
_TEXT_BYTES_PER_STEP, _ROW_BYTES = 1 << 20, 1 << 10
#: Texts handed to a model in one go.
_MODEL_BYTES_PER_STEP = 8 << 20


def _hash_terms(terms: list[str], dim: int):
    """Dense slot, sign and sparse index of each term."""
    digests = b"".join(hashlib.md5(t.encode()).digest() for t in terms)
    halves = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    m = np.uint64(dim)
    slot = (halves[:, 0] % m * np.uint64(2**64 % dim) + halves[:, 1] % m) % m
    index = halves[:, 1] & np.uint64(SPARSE_SPACE - 1)
    parity = [hashlib.md5((t + SIGN_SUFFIX).encode()).digest()[-1] & 1 for t in terms]
    return slot.astype(np.int64), 1 - 2 * np.array(parity, dtype=np.int64), index.astype(np.int64)


def _embed_texts(texts: list[str | None], dim: int, dense: bool, sparse: bool) -> pa.StructArray:
    codes: dict[str, int] = defaultdict(itertools.count().__next__)
    term, count, doc = [], [], []
    for row, text in enumerate(texts):
        tf = Counter(_TOKENS.findall(text.lower() if text else ""))
        term.extend(map(codes.__getitem__, tf))
        count.extend(tf.values())
        doc.extend([row] * len(tf))
    term, count, doc = (np.array(x, dtype=np.int64) for x in (term, count, doc))
    slot, sign, index = _hash_terms(list(codes), dim)
    rows = len(texts)
    fields = {
        "n_tokens": pa.array(np.bincount(doc, weights=count, minlength=rows).astype(np.int64))
    }
    if dense:
        cells = np.bincount(
            doc * dim + slot[term], weights=count * sign[term], minlength=rows * dim
        ).reshape(rows, dim)
        norm = np.sqrt((cells * cells).sum(axis=1, keepdims=True))
        norm[norm == 0] = 1.0
        fields["dense"] = pa.ListArray.from_arrays(
            pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(dim)),
            pa.array((cells / norm).ravel()),
        )
    if sparse:
        # one entry per (document, index): colliding terms merge before weighting
        entry, place = np.unique(doc * SPARSE_SPACE + index[term], return_inverse=True)
        merged = np.bincount(place, weights=count, minlength=len(entry))
        bounds = np.searchsorted(entry, np.arange(rows + 1, dtype=np.int64) * SPARSE_SPACE)
        offsets = pa.array(bounds.astype(np.int32))
        fields["indices"] = pa.ListArray.from_arrays(offsets, pa.array(entry % SPARSE_SPACE))
        fields["counts"] = pa.ListArray.from_arrays(offsets, pa.array(merged))
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def _embedded(texts: pa.Array, dim: int, dense: bool, sparse: bool) -> Iterator[pa.StructArray]:
    """The batch embedded step by step; its terms and vectors are never held together."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.cumsum(lengths + _ROW_BYTES) // _TEXT_BYTES_PER_STEP
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        yield _embed_texts(texts[a:b].to_pylist(), dim, dense, sparse)


def hash_features(
    text: Column, dim: int = DENSE_DIM, dense: bool = True, sparse: bool = True
) -> Column:
    """struct<n_tokens, dense, indices, counts> of a text column.

    ``dense`` is the L2-normalized sum of signed one-hot token hashes (all zero
    for text without tokens); ``indices``/``counts`` are the hashed token
    counts, ascending by index.
    """
    if not 1 <= dim <= 2**31:
        raise ValueError("dim must be in 1..2^31")
    schema = "n_tokens bigint"
    schema += ", dense array<double>" if dense else ""
    schema += ", indices array<bigint>, counts array<double>" if sparse else ""

    @F.arrow_udf(f"struct<{schema}>")
    def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield from _embedded(batch, dim, dense, sparse)

    return features(text)


def sublinear(indices: Column, counts: Column) -> Column:
    """Sparse vector with weight 1 + ln(tf)."""
    return F.struct(
        indices.alias("indices"),
        F.transform(counts, lambda n: F.lit(1.0) + F.log(n)).alias("values"),
    )


def embed_hashed(
    df: DataFrame, dim: int = DENSE_DIM, dense: bool = True, sparse: bool = True
) -> DataFrame:
    """Add ``dense`` and/or ``sparse`` columns computed from ``text``."""
    require_columns(df, "text")
    out = df.withColumn("_f", hash_features(F.col("text"), dim, dense, sparse))
    if dense:
        out = out.withColumn("dense", F.col("_f.dense"))
    if sparse:
        out = out.withColumn("sparse", sublinear(F.col("_f.indices"), F.col("_f.counts")))
    return out.drop("_f")


def embed_bm25(df: DataFrame, k1: float = 1.2, b: float = 0.75, corpus: DataFrame | None = None):
    """Add ``sparse`` with Okapi BM25 document weights (before IDF).

    Average length comes from ``corpus`` (default: the table itself) as a
    scalar subquery, so nothing is collected. Without ``corpus`` the counts are
    stored once, and both the average and the weights are read from them.
    """
    require_columns(df, "text")
    out = df.withColumn("_f", hash_features(F.col("text"), dense=False))
    if corpus is None:
        out = stored(out)
        lengths = out.select(F.avg(F.col("_f.n_tokens").cast("double")))
    else:
        lengths = corpus.select(F.avg(F.size(tokenize(F.col("text"))).cast("double")))
    out = out.withColumn("_ratio", F.col("_f.n_tokens") / lengths.scalar())
    saturation = k1 * (1 - b + b * F.col("_ratio"))
    out = out.withColumn("_sat", saturation).withColumn(
        "sparse",
        F.struct(
            F.col("_f.indices").alias("indices"),
            F.transform(
                F.col("_f.counts"), lambda n: n * (k1 + 1) / (n + F.col("_sat"))
            ).alias("values"),
        ),
    )
    return out.drop("_f", "_ratio", "_sat")


def embed_query_terms(df: DataFrame) -> DataFrame:
    """Add ``sparse`` with plain term counts, the query side of BM25."""
    out = df.withColumn("_f", hash_features(F.col("text"), dense=False))
    return out.withColumn(
        "sparse", F.struct(F.col("_f.indices").alias("indices"), F.col("_f.counts").alias("values"))
    ).drop("_f")


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """The texts in their order, so many at a time that a step stays small (one at least)."""
    size = np.cumsum([len(t) for t in texts]) // _MODEL_BYTES_PER_STEP
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        yield texts[a:b]


def _as_lists(vectors) -> pa.ListArray:
    rows = [np.asarray(v, np.float64).ravel() for v in vectors]
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0), *rows])))


def embed_with_model(
    df: DataFrame,
    make_model: Callable[[], Callable[[list[str]], list]],
    dense_col: str = "dense",
) -> DataFrame:
    """Add a dense column from a user model.

    ``make_model`` runs once per task and returns a function from a list of
    texts to a list of vectors (lists or arrays, also one matrix); texts arrive
    in steps of bounded bytes.
    """
    require_columns(df, "text")

    @F.arrow_udf("array<double>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_model()
        for batch in texts:
            yield pa.concat_arrays([_as_lists(model(part)) for part in _steps([t or "" for t in batch.to_pylist()])])

    return df.withColumn(dense_col, encode(F.col("text")))


def build_embedder(kind: str, make_model=None, dim: int = DENSE_DIM):
    """Embedder by case-insensitive name: ``hash``, ``bm25`` or ``model``.

    Returns a DataFrame -> DataFrame function that adds ``dense`` and ``sparse``.
    """
    name = kind.lower()
    if name == "hash":
        return lambda df: embed_hashed(df, dim)
    if name == "bm25":
        return lambda df: embed_bm25(embed_hashed(df, dim, sparse=False))
    if name == "model":
        if make_model is None:
            raise ValueError("embedder 'model' needs make_model")
        return lambda df: embed_with_model(embed_hashed(df, dim, dense=False), make_model)
    raise ValueError(f"no embedder named {kind!r}; known are hash, bm25 and model")


def check_dense_dim(df: DataFrame, dim: int, col: str = "dense") -> DataFrame:
    """Fail the job on a dense vector whose length is not ``dim``."""
    message = F.concat(F.lit(f"{col} needs {dim} values, got "), F.size(col).cast("string"))
    checked = F.when(F.size(col) == dim, F.col(col)).otherwise(F.raise_error(message))
    return df.withColumn(col, checked)


def postings(df: DataFrame, *keep: str) -> DataFrame:
    """Long form of the sparse vectors: one row per (document, index)."""
    entries = explode_rows(df, keep, F.arrays_zip("sparse.indices", "sparse.values"), "_e")
    return entries.select(
        *keep, F.col("_e.indices").alias("idx"), F.col("_e.values").alias("w")
    )


def term_frequencies(df: DataFrame, *keys: str) -> DataFrame:
    """Token counts per document in long form (one shuffle of partial counts)."""
    tokens = explode_rows(df, keys, tokenize(F.col("text")), "term")
    return tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def signed_hash_sums(df: DataFrame, key: str, dim: int = DENSE_DIM) -> DataFrame:
    """Signed token counts per document and dense slot in long form.

    Terms are counted before they are hashed, so each distinct term of a
    document is hashed once.
    """
    return (
        term_frequencies(df, key)
        .groupBy(key, hash_mod(F.col("term"), dim).alias("idx"))
        .agg(F.sum(F.col("tf") * hash_sign(F.col("term"))).alias("value"))
    )
