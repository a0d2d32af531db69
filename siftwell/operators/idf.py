"""Document frequencies and inverse document frequency weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siftwell.functions.rows import explode_rows
from siftwell.operators.embed import postings
from siftwell.sources.collection import stored

SCOPES = ("collection", "tenant")
#: Weights that are sent to every worker, at most.
SENT_WEIGHTS = 2_000_000


def idf_table(points: DataFrame, scope: str = "collection") -> DataFrame:
    """idx, df, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); per tenant on request.

    Each index occurs once per document, so ``df`` is a plain count whose
    map-side partial result is bounded by the vocabulary a task has seen.
    With scope ``collection`` the text of one tenant influences the *scores* of
    another (never its rows); scope ``tenant`` removes that influence.
    """
    if scope not in SCOPES:
        raise ValueError(f"idf scope must be one of {SCOPES}")
    keys = [] if scope == "collection" else ["tenant_id"]
    terms = explode_rows(points, keys, F.col("sparse.indices"), "idx")
    freq = terms.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("df"))
    if keys:
        sizes = points.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
        freq = freq.join(sizes, "tenant_id")
    else:
        freq = freq.withColumn("n", points.select(F.count(F.lit(1))).scalar())
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return freq.select(*keys, "idx", "df", idf.alias("idf"))


def _tables(weights: pa.Table) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Ascending terms and their weights, of every tenant or, under None, of all."""
    term, weight = weights["idx"].to_numpy(), weights["idf"].to_numpy()
    order = np.argsort(term, kind="stable")
    if "tenant_id" not in weights.column_names:
        return {None: (term[order], weight[order])}
    tenants = weights["tenant_id"].combine_chunks().dictionary_encode()
    code = tenants.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((term, code))
    edges = np.searchsorted(code[order], np.arange(len(tenants.dictionary) + 1))
    parts = [order[a:b] for a, b in zip(edges, edges[1:])]
    return {name: (term[part], weight[part]) for name, part in zip(tenants.dictionary.to_pylist(), parts)}


def _by_table(queries: DataFrame, tables: dict, by_tenant: bool) -> DataFrame:
    """Each query's terms that have a weight, ascending, multiplied by it."""
    shared = queries.sparkSession.sparkContext.broadcast(tables)

    @F.arrow_udf("struct<indices: array<bigint>, values: array<double>>")
    def weighted(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        nothing = np.empty(0, np.int64), np.empty(0)
        for tenant, indices, values in batches:
            n = len(indices)
            row = pc.list_parent_indices(indices).to_numpy(zero_copy_only=False)
            term, w = indices.flatten(), values.flatten().to_numpy(zero_copy_only=False)
            known = pc.is_valid(term).to_numpy(zero_copy_only=False)
            term, row, w = pc.fill_null(term, 0).to_numpy(zero_copy_only=False)[known], row[known], w[known]
            out, kept = np.empty(len(term)), np.zeros(len(term), bool)
            codes = tenant.dictionary_encode()
            group = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)[row]
            for number, name in enumerate(codes.dictionary.to_pylist()) if by_tenant else [(0, None)]:
                mine = np.flatnonzero(group == number) if by_tenant else slice(None)
                terms, weights = shared.value.get(name, nothing)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, term[mine]), len(terms) - 1)
                    kept[mine] = terms[at] == term[mine]
                    out[mine] = w[mine] * weights[at]
            row, term, out = row[kept], term[kept], out[kept]
            order = np.lexsort((out, term, row))
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (term.astype(np.int64), out)]
            yield pa.StructArray.from_arrays(lists, names=["indices", "values"])

    indices, values = F.col("sparse.indices").cast("array<bigint>"), F.col("sparse.values").cast("array<double>")
    found = weighted(F.col("tenant_id").cast("string"), F.coalesce(indices, F.array().cast("array<bigint>")), F.coalesce(values, F.array().cast("array<double>")))
    key = F.col("tenant_id").isNotNull() & F.col("query_id").isNotNull()
    rest = [c for c in queries.columns if c not in ("tenant_id", "query_id", "sparse")]
    return queries.select("tenant_id", "query_id", *rest, F.when(key, found).otherwise(_empty()).alias("sparse"))


def _empty():
    return F.struct(
        F.array().cast("array<bigint>").alias("indices"),
        F.array().cast("array<double>").alias("values"),
    )


def weight_queries(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """Multiply the queries' term weights by IDF; rows without terms are kept.

    IDF goes on the query side because that side is short: the corpus vectors
    stay as they are. Terms the corpus does not have are dropped. Up to
    ``SENT_WEIGHTS`` weights are sent to every worker, which weighs the queries
    where they are read; only rows of one query are brought together, as are the
    terms of all queries where the weights are more.
    """
    on = ["tenant_id", "idx"] if "tenant_id" in idf.columns else ["idx"]
    weights, key = stored(idf.select(*on, "idf")), ["tenant_id", "query_id"]
    facts = weights.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*on).alias("terms")).first()
    if facts["n"] > SENT_WEIGHTS or facts["n"] != facts["terms"]:
        return _by_join(queries, weights, on)
    again = queries.dropna(subset=key).groupBy(*key).count().where("count > 1").select(*key)
    again = stored(again)
    tables = _tables(weights.dropna(subset=on).toArrow())
    if again.isEmpty():
        return _by_table(queries, tables, len(on) > 1)
    repeated = _by_join(queries.join(again, key, "left_semi"), weights, on)
    return _by_table(queries.join(again, key, "left_anti"), tables, len(on) > 1).unionByName(repeated)


def _by_join(queries: DataFrame, idf: DataFrame, on: list[str]) -> DataFrame:
    terms = postings(queries, "tenant_id", "query_id").join(idf, on)
    entry = F.struct("idx", (F.col("w") * F.col("idf")).alias("w"))
    weighted = (
        terms.groupBy("tenant_id", "query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("_t"))
        .select("tenant_id", "query_id", F.struct(
            F.col("_t.idx").alias("indices"), F.col("_t.w").alias("values")).alias("_s"))
    )
    return (
        queries.drop("sparse")
        .join(weighted, ["tenant_id", "query_id"], "left")
        .withColumn("sparse", F.coalesce("_s", _empty()))
        .drop("_s")
    )
