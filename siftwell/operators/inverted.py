"""A stored inverted index of sparse vectors, searched with MaxScore over block maxima.

Documents of a tenant are dealt to shards of about ``shard_docs`` by their id.
A row of the index is one term of one shard: the ids that have it, ascending,
their weights, and the largest and smallest weight of every ``BLOCK`` entries.
Rows are stored by tenant and sorted by term, so a search reads its own terms.

A query walks its terms in a shard, or several small ones together, by what they can add at most. Once the terms
left cannot lift a new document over the k-th score so far, only documents
already met are followed, and of the later terms only blocks that hold one of
them whose own maximum could still matter. What is left is scored again in the
order of the terms, so scores are those of the exhaustive search, bit for bit.

Walks cost a few milliseconds apiece. Where a shard has ``WALKED`` queries or
more, its postings are laid out by document and scored for all of them together
(``blocks``), with equal hits. Queries beyond ``slice_bytes`` are not sent to
every worker: they are dealt out to the shards of their tenant, in groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwell.operators.blocks import SCORE_DIGITS, UNDEFINED, BestOf, by_conditions
from siftwell.operators.idf import weight_queries
from siftwell.operators.ranking import measured_bytes, take_top, vector_bytes
from siftwell.schema import QUERY_FILTERS, require_columns
from siftwell.sources.collection import shuffles_removed, stored

SHARD_DOCS, BLOCK = 8192, 64
SLICE_BYTES = 16 << 20
#: Terms of a slice that are pushed to the scan one by one; more of them are a semi-join.
PUSHED_TERMS = 400
#: Terms of tenants that are sent to the scan, at most; more of them are nearly all terms.
SENT_TERMS = 1_000_000
#: Queries of a shard that walk its terms one by one, fewer than so many.
WALKED = 64
#: Bounds are sums in another order than scores; what is this close is not left out.
_MARGIN = 1e-7

_POSTINGS = (
    "tenant_id string, shard int, idx bigint, ids array<bigint>, weights array<double>, "
    "largest array<double>, smallest array<double>"
)
_HITS = "tenant_id string, query_id bigint, id bigint, score double, blocks bigint, read bigint"


def _in_shards(points: DataFrame, shard_docs: int) -> DataFrame:
    sizes = points.groupBy("tenant_id").agg(F.ceil(F.count(F.lit(1)) / shard_docs).cast("int").alias("shards"))
    shard = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard")
    return points.join(sizes, "tenant_id").select(*points.columns, shard)


def _block_edges(size: int) -> np.ndarray:
    return np.arange(0, size, BLOCK)


def _postings_of(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
    """Terms of one shard."""
    docs = docs.take(pc.sort_indices(docs, [("id", "ascending")]))
    lists = docs["indices"].combine_chunks()
    term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    weight = docs["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(weight).all():
        raise ValueError(f"the index needs finite weights; tenant {key[0].as_py()!r} has others")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ids = np.repeat(docs["id"].to_numpy(), size)
    order = np.argsort(term, kind="stable")
    return _rows_of(key, term[order], weight[order], ids[order])


def _rows_of(key: tuple[pa.Scalar, ...], term: np.ndarray, weight: np.ndarray, ids: np.ndarray) -> pa.Table:
    """One row per term of entries that are sorted by term and id."""
    edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
    ends = np.r_[edges[1:], len(term)]
    # Blocks start anew with every term.
    blocks = np.concatenate([a + _block_edges(b - a) for a, b in zip(edges.tolist(), ends.tolist())] or [edges])
    largest, smallest = (np.maximum.reduceat(weight, blocks), np.minimum.reduceat(weight, blocks)) if len(term) else (weight,) * 2
    offsets = pa.array(np.r_[edges, len(term)].astype(np.int32))
    block_offsets = pa.array(np.r_[np.searchsorted(blocks, edges), len(blocks)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, weight)]
    lists += [pa.ListArray.from_arrays(block_offsets, pa.array(x)) for x in (largest, smallest)]
    names = [pa.array([key[0].as_py()] * len(edges), pa.string()), pa.array([key[1].as_py()] * len(edges), pa.int32())]
    columns = [*names, pa.array(term[edges]), *lists]
    return pa.Table.from_arrays(columns, ["tenant_id", "shard", "idx", "ids", "weights", "largest", "smallest"])


def write_index(points: DataFrame, path: str, shard_docs: int = SHARD_DOCS) -> None:
    """Store the index of the points' ``sparse`` vectors; an existing one is replaced.

    Points without a tenant or an id are left out, like by every search; an id
    occurs once. Weights that are not finite fail the job.
    """
    require_columns(points, "tenant_id", "id", "sparse")
    kept = [F.col(c) if c in points.columns else F.lit(None).alias(c) for c in ("category", "created_at")]
    rows = points.dropna(subset=["tenant_id", "id"]).select(
        F.col("tenant_id").cast("string").alias("tenant_id"), F.col("id").cast("bigint").alias("id"),
        kept[0].cast("string").alias("category"), kept[1].cast("bigint").alias("created_at"),
        F.col("sparse.indices").alias("indices"), F.col("sparse.values").alias("values"),
    )
    rows = _in_shards(rows, shard_docs)
    vectors = rows.where(F.size("indices") > 0).select("tenant_id", "shard", "id", "indices", "values")
    postings = vectors.groupBy("tenant_id", "shard").applyInArrow(_postings_of, _POSTINGS)
    postings = postings.hint("rebalance", "tenant_id").sortWithinPartitions("tenant_id", "idx", "shard")
    with shuffles_removed(points.sparkSession):
        postings.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{path}/postings")
    facts = rows.select("tenant_id", "shard", "id", "category", "created_at")
    facts.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{path}/documents")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POSTINGS).parquet(f"{path}/postings")


def term_statistics(spark: SparkSession, path: str) -> DataFrame:
    """tenant_id, idx, df and the largest weight of every term."""
    terms = read_postings(spark, path)
    return terms.groupBy("tenant_id", "idx").agg(
        F.sum(F.size("ids")).alias("df"), F.max(F.array_max("largest")).alias("largest")
    )


def _joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Postings of several shards as those of one."""
    if len(pc.unique(table["shard"])) <= 1:
        return table
    flat = lambda name: table[name].combine_chunks().flatten().to_numpy()
    term = np.repeat(table["idx"].to_numpy(), pc.list_value_length(table["ids"]).to_numpy())
    ids, weight = flat("ids"), flat("weights")
    order = np.lexsort((ids, term))
    return _rows_of(key, term[order], weight[order], ids[order])


class Shard:
    """The postings of one shard that a slice of queries asks for."""

    def __init__(self, table: pa.Table):
        table = table.take(pc.sort_indices(table, [("idx", "ascending")]))
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy()
        ends = lambda name: np.r_[0, np.cumsum(pc.list_value_length(table[name]).to_numpy())]
        self.terms = table["idx"].to_numpy()
        self.ids, self.doc = np.unique(flat("ids"), return_inverse=True)
        self.weight, self.start = flat("weights"), ends("ids")
        self.largest, self.smallest, self.block = flat("largest"), flat("smallest"), ends("largest")

    def _bounds(self, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least that each term can add."""
        high = np.maximum.reduceat(self.largest, self.block[:-1])[t]
        low = np.minimum.reduceat(self.smallest, self.block[:-1])[t]
        return np.maximum(0, np.maximum(w * high, w * low)), np.minimum(0, np.minimum(w * high, w * low))

    def best(self, term: np.ndarray, w: np.ndarray, k: int, allowed: np.ndarray | None):
        """Documents (numbers in ``ids``) that may be among the best k, blocks of the terms, blocks read."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        mine = self.terms[at] == term
        t, w = at[mine], w[mine]
        blocks = int((self.block[t + 1] - self.block[t]).sum())
        if not len(t):
            return np.empty(0, np.int64), 0, 0
        most, least = self._bounds(t, w)
        prune = bool(np.isfinite(w).all())
        order = np.argsort(-most, kind="stable")
        t, w, most, least = t[order], w[order], most[order], least[order]
        rest_most = np.r_[np.cumsum(most[::-1])[::-1], 0.0]
        rest_least = np.r_[np.cumsum(least[::-1])[::-1], 0.0]
        score, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        live, read = None, 0

        def still(found: np.ndarray, j: int) -> tuple[np.ndarray, float]:
            """Of the documents found, those that may be among the best after term j, and the bound."""
            if len(found) < k:
                return found, -np.inf
            bound = np.partition(score[found], -k)[-k] + rest_least[j + 1]
            bound -= _MARGIN * (1 + abs(bound))
            return found[score[found] + rest_most[j + 1] >= bound], bound

        bound = -np.inf
        for j, (one, weight) in enumerate(zip(t.tolist(), w.tolist())):
            a, b = self.start[one], self.start[one + 1]
            if live is None:
                read += int(self.block[one + 1] - self.block[one])
                score[self.doc[a:b]] += weight * self.weight[a:b]
                seen[self.doc[a:b]] = True
                if prune and j + 1 < len(t):
                    found = np.flatnonzero(seen if allowed is None else seen & allowed)
                    some, bound = still(found, j)
                    if rest_most[j + 1] < bound:  # who is not met yet cannot get there
                        live = some
                continue
            first = self.doc[a : b : BLOCK]
            place = np.searchsorted(first, live, "right") - 1
            held = self.block[one] + np.maximum(place, 0)
            gain = np.maximum(0, np.maximum(weight * self.largest[held], weight * self.smallest[held]))
            matters = (place >= 0) & (score[live] + gain + rest_most[j + 1] >= bound)
            live = live[matters | (score[live] + rest_most[j + 1] >= bound)]
            wanted = np.unique(place[matters])
            read += len(wanted)
            entry = (a + wanted[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            entry = entry[entry < b]
            score[self.doc[entry]] += weight * self.weight[entry]
            live, bound = still(live, j)
        if live is None:
            live = np.flatnonzero(seen if allowed is None else seen & allowed)
            live = still(live, len(t) - 1)[0] if prune else live
        return live, blocks, read

    def scores(self, docs: np.ndarray, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of a few documents, added up in the order of the terms."""
        out = np.zeros(len(docs))
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        for one, weight in zip(at[self.terms[at] == term].tolist(), w[self.terms[at] == term].tolist()):
            a, b = self.start[one], self.start[one + 1]
            entry = a + np.searchsorted(self.doc[a:b], docs)
            has = (entry < b) & (self.doc[np.minimum(entry, b - 1)] == docs)
            out[has] += self.weight[entry[has]] * weight
        return out


class _Conditions:
    """Which documents of a shard a query may find."""

    def __init__(self, ids: np.ndarray, facts: pa.Table):
        order = np.argsort(facts["id"].to_numpy())
        order = order[np.searchsorted(facts["id"].to_numpy()[order], ids)]
        self.category = facts["category"].take(pa.array(order)).to_pylist()
        self.category = np.array(self.category, object)
        self.unknown = pc.is_null(facts["created_at"]).to_numpy()[order]
        self.at = pc.fill_null(facts["created_at"], 0).to_numpy()[order]

    def allowed(self, query: dict) -> np.ndarray | None:
        category, after, before = (query[name] for name in QUERY_FILTERS)
        if category is None and after is None and before is None:
            return None
        ok = np.ones(len(self.at), bool) if category is None else self.category == category
        if after is not None or before is not None:
            ok = ok & ~self.unknown
        ok = ok if after is None else ok & (self.at >= after)
        return ok if before is None else ok & (self.at <= before)


def _by_document(terms: pa.Table, facts: pa.Table) -> pa.Table:
    """The postings of a shard as documents: id, category, created_at, indices, values."""
    size = pc.list_value_length(terms["ids"]).to_numpy()
    flat = lambda name: terms[name].combine_chunks().flatten().to_numpy()
    term, weight = np.repeat(terms["idx"].to_numpy(), size), flat("weights")
    ids, doc = np.unique(flat("ids"), return_inverse=True)
    order = np.lexsort((term, doc))
    term, doc = term[order], doc[order]
    first = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])][: len(term)]  # an id counts once, as in walks
    term, doc, weight = term[first], doc[first], weight[order[first]]
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=len(ids)))].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term, weight)]
    if facts.num_rows:
        at = np.argsort(facts["id"].to_numpy())
        at = pa.array(at[np.searchsorted(facts["id"].to_numpy()[at], ids)])
        known = [facts["category"].take(at), facts["created_at"].take(at)]
    else:
        known = [pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())]
    return pa.table([pa.array(ids), *known, *lists], ["id", "category", "created_at", "indices", "values"])


def _batched(terms: pa.Table, facts: pa.Table, mine: pa.Table, k: int) -> pa.Table:
    docs, tables = _by_document(terms, facts), []
    for part in by_conditions(mine):
        best = BestOf(part, ("sparse",), k)
        best.add(docs)
        tables += best.tables()
    return pa.concat_tables(tables).select(["query_id", "id", "score"])


def _walked(shard: Shard, conditions: _Conditions | None, mine: pa.Table, k: int) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in ("query_id", "id", "score", "blocks", "read")}

    def add(query_id: int, ids: list, scores: list, blocks, read) -> None:
        for name, value in (("query_id", [query_id] * len(ids)), ("id", ids), ("score", scores),
                            ("blocks", [blocks] * len(ids)), ("read", [read] * len(ids))):
            out[name] += value

    plain = mine.drop_columns(["indices", "values"]).to_pylist()
    for query, term, w in zip(plain, mine["indices"], mine["values"]):
        term = term.values.to_numpy() if term.is_valid else np.empty(0, np.int64)
        w = w.values.to_numpy(zero_copy_only=False) if len(term) else np.empty(0)
        allowed = conditions.allowed(query) if conditions else None
        docs, blocks, read = shard.best(term, w, k, allowed)
        if not blocks:
            continue
        found = shard.scores(docs, term, w)
        found = np.where(np.isnan(found), UNDEFINED, np.round(found, SCORE_DIGITS) + 0.0)
        top = np.lexsort((shard.ids[docs], -found))[:k]
        scores = [None if s < UNDEFINED / 2 else s for s in found[top].tolist()]
        add(query["query_id"], shard.ids[docs[top]].tolist(), scores, None, None)
        add(query["query_id"], [None], [None], blocks, read)
    return out


_KINDS = {"query_id": pa.int64(), "id": pa.int64(), "score": pa.float64(), "blocks": pa.int64(), "read": pa.int64()}


def _hits_of(key: tuple[pa.Scalar, ...], terms: pa.Table, facts: pa.Table, mine: pa.Table, k: int, walk: bool) -> pa.Table:
    """Best k of a shard for each of its queries and, of a walk, the blocks of the query's terms and blocks read."""
    if not (terms.num_rows and mine.num_rows):
        out: dict = {}
    elif walk or mine.num_rows < WALKED:
        shard = Shard(_joined(key, terms))
        out = _walked(shard, _Conditions(shard.ids, facts) if facts.num_rows else None, mine, k)
    else:
        out = {name: column.combine_chunks() for name, column in zip(_KINDS, _batched(terms, facts, mine, k).columns)}
    rows = len(out.get("query_id", []))
    columns = [x if isinstance(x := out.get(n, [None] * rows), pa.Array) else pa.array(x, kind) for n, kind in _KINDS.items()]
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * rows, pa.string()), *columns], ["tenant_id", *_KINDS])


def _score_slice(postings: DataFrame, facts: DataFrame, queries: pa.Table, k: int, walk: bool) -> DataFrame:
    shared = postings.sparkSession.sparkContext.broadcast(queries)

    def score(key: tuple[pa.Scalar, ...], terms: pa.Table, facts: pa.Table) -> pa.Table:
        mine = shared.value.filter(pc.equal(shared.value["tenant_id"], key[0].as_py()))
        return _hits_of(key, terms, facts, mine, k, walk)

    grouped = postings.groupBy("tenant_id", "together"), facts.groupBy("tenant_id", "together")
    return grouped[0].cogroup(grouped[1]).applyInArrow(score, _HITS)


def _score_cells(postings: DataFrame, facts: DataFrame, asked: DataFrame, widths: DataFrame, slice_bytes: int, k: int, walk: bool) -> DataFrame:
    """Every group of a tenant's shards with every group of its queries of ``slice_bytes``, about."""
    sizes = asked.groupBy("tenant_id").agg(F.ceil(F.sum(vector_bytes(("sparse",))) / slice_bytes).cast("int").alias("_qs"))
    groups = F.ceil(F.col("shards") / F.col("width")).cast("int").alias("_groups")
    cells = stored(widths.select("tenant_id", groups).join(sizes, "tenant_id"))
    queries = asked.join(cells, "tenant_id").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_qs")).cast("int"))
    queries = queries.withColumn("together", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_qs", "_groups")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(cells.drop("_groups"), "tenant_id")
        return rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1))).drop("_qs")

    query_columns = asked.columns

    def score(key: tuple[pa.Scalar, ...], terms: pa.Table, others: pa.Table) -> pa.Table:
        asks = pc.is_valid(others["query_id"])
        facts = others.filter(pc.invert(asks)).select(["id", "category", "created_at"])
        return _hits_of(key, terms, facts, others.filter(asks).select(query_columns), k, walk)

    cell = ["tenant_id", "together", "_q"]
    others = queries.unionByName(dealt(facts).drop("shard"), allowMissingColumns=True)
    return dealt(postings).groupBy(*cell).cogroup(others.groupBy(*cell)).applyInArrow(score, _HITS)


def _asked(queries: DataFrame) -> DataFrame:
    filters = [
        (F.col(name) if name in queries.columns else F.lit(None)).cast(kind).alias(name) for name, kind in QUERY_FILTERS.items()
    ]
    rows = queries.dropna(subset=["tenant_id", "query_id"]).select(
        F.col("tenant_id").cast("string").alias("tenant_id"), F.col("query_id").cast("bigint").alias("query_id"),
        *filters, F.col("sparse.indices").alias("indices"), F.col("sparse.values").alias("values"),
    )
    return stored(rows)


def _wanted(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings of the queries' terms.

    A few terms are a condition of the scan, whose files are sorted by term: it
    skips row groups and pages. Many are spread over all of them, and beyond
    ``SENT_TERMS`` the postings that nobody asks for are few.
    """
    pairs = stored(asked.select("tenant_id", F.explode("indices").alias("idx")).distinct())
    some = pairs.select("idx").distinct().limit(PUSHED_TERMS + 1)
    terms = [r["idx"] for r in some.collect()]
    if len(terms) <= PUSHED_TERMS:
        conf, threshold = postings.sparkSession.conf, "spark.sql.parquet.pushdown.inFilterThreshold"
        conf.set(threshold, str(max(PUSHED_TERMS, int(conf.get(threshold)))))
        postings = postings.where(F.col("idx").isin(terms))
    elif pairs.count() > SENT_TERMS:
        return postings
    return postings.join(F.broadcast(pairs), ["tenant_id", "idx"], "left_semi")


def _shard_widths(spark: SparkSession, path: str) -> DataFrame:
    """tenant_id, its shards and the number of them that are searched together, ``SHARD_DOCS`` documents or one shard."""
    shards = spark.read.schema("shard int, tenant_id string").parquet(f"{path}/documents")
    sizes = shards.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), (F.max("shard") + 1).alias("shards"))
    width = F.floor(F.lit(SHARD_DOCS) * F.col("shards") / F.col("n")).cast("int")
    return stored(sizes.select("tenant_id", "shards", F.greatest(F.lit(1), width).alias("width")))


def _together(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """Number the groups of shards; small shards, taken one by one, would cost each query a walk apiece."""
    own = widths.select(F.col("tenant_id").alias("tenant_id"), F.col("width").alias("width"))  # both sides are joined later
    group = F.floor(F.col("shard") / F.col("width")).cast("int").alias("together")
    return rows.join(F.broadcast(own), "tenant_id").select(*rows.columns, group)


def _scored(spark: SparkSession, path: str, queries: DataFrame, k: int, slice_bytes: int, walk: bool = False) -> DataFrame:
    """Best k of every shard and, with ``walk``, a row without an id that counts its blocks."""
    if k < 1:
        raise ValueError("k must be at least 1")
    require_columns(queries, "tenant_id", "query_id", "sparse")
    asked = _asked(queries)
    filtered = any(name in queries.columns for name in QUERY_FILTERS)
    widths = _shard_widths(spark, path)
    postings = _together(_wanted(read_postings(spark, path), asked), widths)
    tenants = F.broadcast(asked.select("tenant_id").distinct())
    facts = spark.read.schema("shard int, id bigint, category string, created_at bigint, tenant_id string")
    facts = facts.parquet(f"{path}/documents").where(F.lit(filtered)).join(tenants, "tenant_id", "left_semi")
    facts = _together(facts, widths)
    if measured_bytes(asked, vector_bytes(("sparse",))) > slice_bytes:
        return _score_cells(postings, facts, asked, widths, slice_bytes, k, walk)
    return _score_slice(postings, facts, asked.toArrow(), k, walk)


def index_search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    idf: DataFrame,
    limit: int = 10,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The sparse top ``limit`` of every query, as ``search(points, queries, "sparse")`` gives it."""
    found = _scored(spark, path, weight_queries(queries, idf), limit, slice_bytes)
    hits = found.where("id IS NOT NULL").withColumn("mode", F.lit("sparse"))
    return take_top(hits.select("tenant_id", "mode", "query_id", "id", "score"), limit)


def index_work(spark: SparkSession, path: str, queries: DataFrame, idf: DataFrame, limit: int = 10) -> DataFrame:
    """tenant_id, query_id, blocks of the query's terms and blocks read."""
    found = _scored(spark, path, weight_queries(queries, idf), limit, SLICE_BYTES, walk=True).where("id IS NULL")
    return found.groupBy("tenant_id", "query_id").agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read"))
