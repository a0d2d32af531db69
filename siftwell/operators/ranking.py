"""Exact top-k of many queries over many documents, tenant by tenant.

Scoring is quadratic within a tenant, so what matters is that pairs never
become rows. The queries, with their vectors, are stored once and cut into
slices of bounded bytes. A slice is held by every worker and the documents are
scored where they are read, block by block; a task keeps the best ``k`` per
query over all its blocks and hands them out once. The corpus is not shuffled,
and a tenant that holds a third of it is simply many tasks.

Slices pass through the driver, and each is a pass over the documents. More
queries than ``SENT_BYTES`` are therefore dealt out instead: the queries of a
key in groups of bounded bytes, its documents in groups of bounded number, and
every pair of groups is a cell. A task keeps the documents of a cell, on its own
disk if they are many, and scores the queries as they come in, some at a time.
So neither side is ever held whole, and a document is moved once for each group
of queries, of which there are only as many as keep all cores busy.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwell.operators.blocks import UNDEFINED, BestOf, by_conditions
from siftwell.schema import QUERY_FILTERS, require_columns
from siftwell.sources.collection import released, stored

SLICE_BYTES = 64 << 20
BLOCK_DOCS = 16_384
BLOCK_BYTES = 128 << 20
#: Queries of a search that are sent to every worker, at most; beyond, the queries that a task holds at a time and the documents of a cell.
SENT_BYTES = 64 << 20
CELL_BYTES, CELL_DOCS = 64 << 20, 131_072
#: Partitions that cells are dealt to, at most.
CELL_PARTITIONS = 4096
#: Rows that are dealt out at a time, at least.
ROUND_BYTES = 1 << 30
#: Documents of a cell that a task keeps in memory.
HELD_BYTES = 64 << 20
#: Hits of lists that wait to be merged.
_ROWS_HELD = 500_000
#: Keys are cut into cells until a core has so many, down to so many pairs of a cell and no more cells than make so many queries each.
CELLS_PER_CORE, CELL_PAIRS, CELL_QUERIES = 4, 20_000_000, 2_000


def document_side(points: DataFrame, keys, modes) -> DataFrame:
    cols = [F.col(k).cast("string").alias(k) for k in keys]
    cols.append(F.col("id").cast("bigint").alias("id"))
    for name, kind in (("category", "string"), ("created_at", "bigint")):
        col = F.col(name) if name in points.columns else F.lit(None)
        cols.append(col.cast(kind).alias(name))
    return points.select(*cols, *_vector_columns(modes)).dropna(subset=list(keys))


def _query_side(queries: DataFrame, keys, modes) -> DataFrame:
    cols = [F.col(k).cast("string").alias(k) for k in keys]
    cols.append(F.col("query_id").cast("bigint").alias("query_id"))
    for name, kind in QUERY_FILTERS.items():
        col = F.col(name) if name in queries.columns else F.lit(None)
        cols.append(col.cast(kind).alias(name))
    return queries.select(*cols, *_vector_columns(modes)).dropna(subset=list(keys))


def _vector_columns(modes) -> list[Column]:
    # aliased: points and queries may be selections of the same table
    cols = []
    if "dense" in modes:
        cols.append(F.col("dense").alias("dense"))
    if "sparse" in modes:
        cols += [F.col("sparse.indices").alias("indices"), F.col("sparse.values").alias("values")]
    if "codes" in modes:
        cols.append(F.col("codes").alias("codes"))
    return cols


def vector_bytes(modes) -> Column:
    size = F.lit(128).cast("bigint")
    if "dense" in modes:
        size = size + F.size("dense") * 8
    if "sparse" in modes:
        size = size + F.size("indices") * 16
    if "codes" in modes:
        size = size + F.size("codes") * 8
    return size


def measured_bytes(df: DataFrame, row_bytes: Column) -> int:
    return df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()["b"]


def split_by_key(table: pa.Table, keys) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each distinct key tuple, with one stable sort of the row numbers."""
    codes = np.zeros(table.num_rows, dtype=np.int64)
    for name in keys:
        column = table[name].combine_chunks().dictionary_encode()
        part = pc.fill_null(column.indices, -1).to_numpy(zero_copy_only=False) + 1
        codes = np.unique(codes * (len(column.dictionary) + 1) + part, return_inverse=True)[1]
    if not codes.any():
        if table.num_rows:
            yield tuple(table[k][0].as_py() for k in keys), table
        return
    order = codes.argsort(kind="stable")
    table, codes = table.take(pa.array(order)), codes[order]
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for start, end in zip(edges, edges[1:]):
        part = table.slice(start, end - start)
        yield tuple(part[k][0].as_py() for k in keys), part


def _with_key(block: pa.Table, keys, key) -> pa.Table:
    for position, (name, value) in enumerate(zip(keys, key)):
        column = pa.array([value] * block.num_rows, pa.string())
        block = block.add_column(position, name, column)
    return block


def _relevant(docs: DataFrame, part: DataFrame, queries: pa.Table, keys) -> DataFrame:
    """The documents that a slice can ask for: its keys, categories and time envelope.

    Keys and categories are semi-joins with the slice's own distinct values,
    which are fewer than its rows, so partitions are pruned for any number of
    tenants.
    """
    wanted = F.broadcast(part.select(*keys).distinct())
    docs = docs.join(wanted, list(keys), "left_semi")
    after, before = queries["created_after"], queries["created_before"]
    if len(after) and after.null_count == 0:
        docs = docs.where(F.col("created_at") >= pc.min(after).as_py())
    if len(before) and before.null_count == 0:
        docs = docs.where(F.col("created_at") <= pc.max(before).as_py())
    categories = queries["category_filter"]
    if len(categories) and categories.null_count == 0:
        named = part.select(F.col("category_filter").alias("category")).distinct()
        docs = docs.join(F.broadcast(named), "category", "left_semi")
    return docs


def _score_slice(docs: DataFrame, queries: pa.Table, keys, modes, k, schema):
    """Best k of every task for the queries of one slice, and the broadcast they came by."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = dict(split_by_key(shared.value, keys))
        best: dict[tuple, list[BestOf]] = {}

        def add(block: pa.Table) -> None:
            for key, part in split_by_key(block, keys):
                if key in asked:
                    if key not in best:
                        best[key] = [BestOf(some, modes, k) for some in by_conditions(asked[key])]
                    for one in best[key]:
                        one.add(part)

        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= BLOCK_DOCS or size >= BLOCK_BYTES:
                add(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
        if rows:
            add(pa.Table.from_batches(held))
        for key, found in best.items():
            for table in (table for one in found for table in one.tables()):
                yield from _with_key(table, keys, key).to_batches()

    return docs.mapInArrow(score, schema), shared


def _cells(docs: DataFrame, asked: DataFrame, keys) -> tuple[DataFrame, int, dict[str, int]]:
    """Groups of queries (``_qs``) and documents (``_ds``) of every key, where its cells go, the number of partitions and counts.

    A row is moved once for every group of the other side, so the larger side is
    cut into more groups. A cell of a key that weighs has a partition of its own,
    the largest first; the many others share partitions by hash.
    """
    sizes = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_asked"))
    counts = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_docs"))
    pairs = (F.col("_asked").cast("double") * F.col("_docs")).alias("_pairs")
    facts = stored(sizes.join(counts, list(keys)).select("*", pairs))
    total = facts.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0)).alias("n")).first()["n"]
    most = max(CELL_PAIRS, total / (CELLS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism))
    number = F.least(F.ceil(F.col("_pairs") / most), F.ceil(F.col("_asked") / CELL_QUERIES))
    least = F.ceil(F.col("_docs") / CELL_DOCS)
    qs = F.least(F.ceil(F.sqrt(number * F.col("_asked") / F.col("_docs"))), F.ceil(number / least))
    ds = F.greatest(least, F.ceil(number / qs))
    facts = facts.select(*keys, "_pairs", "_asked", "_docs", qs.cast("int").alias("_qs"), ds.cast("int").alias("_ds"))
    number = F.col("_qs") * F.col("_ds")
    # no more than CELL_PARTITIONS keys weigh so much
    large = facts.where(F.col("_pairs") >= total / CELL_PARTITIONS)
    order = Window.orderBy(F.desc(F.col("_pairs") / number), *keys)
    first = (F.sum(number).over(order.rowsBetween(Window.unboundedPreceding, 0)) - number).alias("_first")
    cells = stored(facts.join(large.select(*keys, first), list(keys), "left"))
    own = F.when(F.col("_first").isNotNull(), number).otherwise(0)
    sums = {"own": own, "rest": number - own}
    sums = {name: F.least(F.lit(CELL_PARTITIONS), F.coalesce(F.sum(n), F.lit(0))) for name, n in sums.items()}
    moved = {"docs": F.sum("_docs"), "asked": F.sum("_asked"), "docs_moved": F.sum(F.col("_docs") * F.col("_qs")),
             "asked_moved": F.sum(F.col("_asked") * F.col("_ds")), "qs": F.max("_qs")}
    sums |= {name: F.coalesce(n, F.lit(0)) for name, n in moved.items()}
    found = cells.agg(*[n.alias(name) for name, n in sums.items()]).first()
    shared = F.lit(found["own"]) + F.pmod(F.xxhash64(*keys), F.lit(max(1, found["rest"])))
    cells = cells.select(*keys, "_qs", "_ds", "_first", F.lit(found["own"]).alias("_own"), shared.alias("_shared"))
    return cells, max(1, found["own"] + found["rest"]), found.asDict()


def _rounds(counts: dict[str, int], asked_bytes: int, docs_bytes: int) -> int:
    """How often cells are dealt out, so that what is moved at a time is about what both sides hold, or ``ROUND_BYTES``."""
    moved = asked_bytes * counts["asked_moved"] / max(1, counts["asked"]) + docs_bytes * counts["docs_moved"] / max(1, counts["docs"])
    return max(1, min(counts["qs"], int(np.ceil(moved / max(ROUND_BYTES, asked_bytes + docs_bytes)))))


def _dealt(rows: DataFrame, cells: DataFrame, keys, own: str, other: str, id_: str) -> DataFrame:
    """Every row in its own group, once for each group of the other side."""
    rows = rows.join(cells, list(keys))
    rows = rows.withColumn(own, F.pmod(F.xxhash64(id_), F.col(f"{own}s")).cast("int"))
    rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
    slot = F.coalesce(F.pmod(F.col("_first") + F.col("_q") * F.col("_ds") + F.col("_d"), F.col("_own")), F.col("_shared"))
    return rows.withColumn("_slot", slot.cast("int")).drop("_qs", "_ds", "_first", "_own", "_shared")


def _size(rows: DataFrame, row_bytes: Column) -> tuple[int, bool]:
    """Bytes of the rows, and whether their terms fit a narrow type: half of what is moved are terms."""
    ends = [F.lit(0), F.lit(0)]
    if "indices" in rows.columns:
        ends = [F.coalesce(F.min(F.array_min("indices")), F.lit(0)), F.coalesce(F.max(F.array_max("indices")), F.lit(0))]
    facts = rows.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("size"), ends[0].alias("a"), ends[1].alias("b")).first()
    return facts["size"], facts["a"] >= -(2**31) and facts["b"] < 2**31


def _wide(rows: DataFrame, codes: str, terms: str) -> DataFrame:
    """Vectors of both sides in the same types; codes and their tables stay apart."""
    kinds = {"dense": "array<double>", "indices": terms, "values": "array<double>"}
    rows = rows.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items() if c in rows.columns})
    return rows.withColumnRenamed("codes", codes)


def _runs(batch: pa.RecordBatch, names) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows that are equal in the named columns; a null begins none."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for name in names:
        column = batch.column(name)
        change |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield tuple(batch.column(name)[a].as_py() for name in names), batch.slice(a, b - a)


def _naming(rows: pa.Table, value) -> pa.Table:
    """The rows once for every time that their ``wanted`` list names the value, and its first place there from 1."""
    lists = rows["wanted"].combine_chunks()
    hit = pc.equal(lists.flatten(), value).to_numpy(zero_copy_only=False).nonzero()[0]
    row = pc.list_parent_indices(lists).to_numpy()[hit]
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    place = hit - (np.cumsum(size) - size)[row] + 1
    place = place[np.searchsorted(row, row)]
    return rows.take(pa.array(row)).append_column("_place", pa.array(place)).append_column("_row", pa.array(row))


class _Blocks:
    """The documents of a cell in blocks, with the list of each; beyond ``HELD_BYTES`` in a file without a name."""

    def __init__(self):
        self.values, self.tables, self.size = [], [], 0
        self.file = self.writer = self.reader = None

    def add(self, value, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches)
        self.values.append(value)
        if self.writer is None and self.size + table.nbytes <= HELD_BYTES:
            self.size += table.nbytes
            self.tables.append(table)
            return
        if self.writer is None:
            self.file = tempfile.TemporaryFile()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            self.writer = pa.ipc.new_file(pa.PythonFile(self.file, "w"), table.schema, options=options)
        self.writer.write_batch(table.combine_chunks().to_batches()[0])

    def __iter__(self) -> Iterator[tuple[object, pa.Table]]:
        if self.writer is not None and self.reader is None:
            self.writer.close()
            self.file.seek(0)
            self.reader = pa.ipc.open_file(pa.PythonFile(self.file, "r"))
        for i, value in enumerate(self.values):
            block = i - len(self.tables)
            yield value, self.tables[i] if block < 0 else pa.Table.from_batches([self.reader.get_batch(block)])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _BestOfLists:
    """The best ``k`` dense hits per query over all lists of a cell seen so far, for each breadth.

    A hit of a query's n-th list counts for every breadth of n or more.
    """

    def __init__(self, k: int, breadths):
        self.k, self.breadths = k, breadths
        none = np.empty(0, np.int64)
        self.held, self.more, self.size = (none, none, np.empty(0), none, none), [], 0

    def add(self, best: BestOf, value: int) -> None:
        row, doc, score = best.held["dense"]
        place, query = (best.queries[name].to_numpy()[row] for name in ("_place", "_row"))
        self.more.append((query, doc, score, place, np.full(len(row), value)))
        self.size += len(row)
        if self.size >= _ROWS_HELD:
            self._merge()

    def _merge(self) -> None:
        row, doc, score, place, value = (np.concatenate(x) for x in zip(self.held, *self.more))
        order = np.lexsort((-doc, -score, row))
        keep = np.zeros(len(row), bool)
        for breadth in self.breadths:
            mine = order[place[order] <= breadth]
            keep[mine[np.arange(len(mine)) - np.searchsorted(row[mine], row[mine]) < self.k]] = True
        kept = order[keep[order]]
        self.held, self.more, self.size = tuple(x[kept] for x in (row, doc, score, place, value)), [], 0

    def table(self, asked: pa.Table) -> pa.Table:
        """The hits of the queries of a cell, with the number of the list and its place for the query."""
        self._merge()
        row, doc, score, place, value = self.held
        names = {"mode": pa.array(["dense"] * len(row), pa.string()), "query_id": asked["query_id"].take(pa.array(row)).combine_chunks()}
        hits = {"id": pa.array(doc, pa.int64()), "score": pa.array(score, mask=score < UNDEFINED / 2)}
        return pa.table(names | hits | {"list_id": pa.array(value, pa.int64()), "list_rank": pa.array(place, pa.int64())})


def _score_cells(
    docs: DataFrame, asked: DataFrame, row_bytes: Column, keys, modes, k, slice_bytes, schema, breadths=None
) -> tuple[DataFrame, DataFrame]:
    """Best k of every cell: a group of a key's queries with a group of its documents.

    With ``breadths``, a cell's documents come sorted by ``list_id``, and each
    list is searched by the queries that name it in their ``wanted`` lists. A query
    is dealt out once, however many lists it names, and its best k of each breadth
    leave the task, not those of each list.
    """
    within = ["list_id"] if breadths else []
    cells, partitions, counts = _cells(docs, asked, keys)
    (asked_bytes, narrow), (docs_bytes, narrow_docs) = _size(asked, vector_bytes(modes)), _size(docs, vector_bytes(modes))
    rounds, terms = _rounds(counts, asked_bytes, docs_bytes), "array<int>" if narrow and narrow_docs else "array<bigint>"
    cell = [*keys, "_q", "_d"]
    # bytes of a query tell how many make a slice
    queries = _wide(asked.withColumn("_bytes", row_bytes), "tables", terms).withColumn("_side", F.lit(1))
    queries = _dealt(queries, cells, keys, "_q", "_d", "query_id")
    dealt = _dealt(_wide(docs, "codes", terms).withColumn("_side", F.lit(0)), cells, keys, "_d", "_q", "id")
    both = queries.unionByName(dealt, allowMissingColumns=True)
    runs = [*cell, "_side", *within]

    def in_round(number: int) -> DataFrame:
        # groups of queries go to rounds, those of small keys by the key
        rows = both.where(F.pmod(F.xxhash64(*keys) + F.col("_q"), F.lit(rounds)) == number) if rounds > 1 else both
        return rows.repartitionById(partitions, "_slot").drop("_slot").sortWithinPartitions(*runs)

    doc_columns = [c for c in docs.columns if c not in (*keys, *within)]

    def in_slices(table: pa.Table) -> list[BestOf]:
        number = np.cumsum(table["_bytes"].to_numpy()) // slice_bytes
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        slices = [table.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]
        return [BestOf(some, modes, k) for part in slices for some in ([part] if within else by_conditions(part))]

    def best_of(asked: pa.Table, blocks: _Blocks) -> Iterator[pa.Table]:
        """Hits of some queries among the documents of a cell, list by list if they name lists."""
        lists, at = _BestOfLists(k, breadths) if within else None, None
        best = [] if within else in_slices(asked)
        for value, block in blocks:
            if within and value != at:
                for one in best:
                    lists.add(one, int(at))
                best, at = in_slices(_naming(asked, value)), value
            for one in best:
                one.add(block)
        if not within:
            for one in best:
                yield from one.tables()
            return
        for one in best:
            lists.add(one, int(at))
        yield lists.table(asked)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows, size = None, [], 0, 0
        blocks = _Blocks()

        def finished() -> Iterator[pa.RecordBatch]:
            """A block of documents is kept; hits of queries are handed out."""
            if held and at[len(cell)] == 0:
                blocks.add(at[-1] if within else None, held)
            elif held and blocks.values:
                asked = pa.Table.from_batches(held).rename_columns({"tables": "codes"} if "codes" in modes else {})
                for table in best_of(asked, blocks):
                    yield from _with_key(table, keys, at[: len(keys)]).to_batches()

        try:
            for batch in batches:
                for now, part in _runs(batch, runs):
                    side = now[len(cell)]
                    if now != at:
                        yield from finished()
                        if at is not None and at[: len(cell)] != now[: len(cell)]:
                            blocks.close()
                            blocks = _Blocks()
                        at, held, rows, size = now, [], 0, 0
                    # "codes" of queries and documents are columns of different types
                    names = [c for c in part.schema.names if c != "codes"] if side == 1 else doc_columns
                    step = part.num_rows if side == 0 else max(1, part.num_rows * CELL_BYTES // max(1, part.nbytes))
                    for a in range(0, part.num_rows, step):
                        some = part.slice(a, step).select(names)
                        most = (BLOCK_DOCS, BLOCK_BYTES) if side == 0 else (2**31, CELL_BYTES)
                        if held and (rows >= most[0] or size + some.nbytes > most[1]):
                            yield from finished()
                            held, rows, size = [], 0, 0
                        held.append(some)
                        rows, size = rows + some.num_rows, size + some.nbytes
            yield from finished()
        finally:
            blocks.close()

    found = [in_round(i).mapInArrow(score, schema) for i in range(rounds)]
    # what a round has moved is gone before the next begins
    return reduce(DataFrame.union, found if rounds == 1 else [stored(x) for x in found]), cells


def block_topk(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    modes=("dense",),
    keys=("tenant_id",),
    slice_bytes: int = SLICE_BYTES,
    points_stored: bool = False,
) -> DataFrame:
    """Best ``k`` per (key, query, mode) of every task: a superset of the top k.

    One pass over ``points`` per slice of queries serves all requested modes.
    Only documents whose ``keys`` equal the query's are ever compared; null keys
    match nothing. A slice holds ``slice_bytes`` of query vectors and results,
    about. With several slices the documents are stored first, so that what they
    are computed from is computed once (unless ``points_stored``), and each slice is finished and stored
    before the next is sent out. Beyond ``SENT_BYTES`` nothing is sent: both
    sides are dealt out in cells, whose queries are scored slice by slice.
    """
    return _block_topk(points, queries, k, modes, keys, slice_bytes, points_stored)[0]


def _block_topk(points, queries, k, modes=("dense",), keys=("tenant_id",), slice_bytes=SLICE_BYTES, points_stored=False):
    """``block_topk`` and, if cells were dealt out, the stored tables that only they read."""
    if k < 1:
        raise ValueError("k must be at least 1")
    require_columns(points, *keys, "id")
    require_columns(queries, *keys, "query_id")
    schema = ", ".join(f"{name} string" for name in keys)
    schema += ", mode string, query_id bigint, id bigint, score double"
    docs = document_side(points, keys, modes)
    asked = stored(_query_side(queries, keys, modes))
    row_bytes = vector_bytes(modes) + F.lit(24 * k * len(modes))
    total = measured_bytes(asked, row_bytes)
    slices = max(1, -(-total // slice_bytes))
    if (slices > 1 or total > SENT_BYTES) and not points_stored:
        docs = stored(docs)
    if total > SENT_BYTES:
        found, cells = _score_cells(docs, asked, row_bytes, keys, modes, k, slice_bytes, schema)
        return found, [asked, cells, *([] if points_stored else [docs])]
    number = F.pmod(F.xxhash64("query_id", *keys), F.lit(slices))
    results = []
    for i in range(slices):
        part = asked.where(number == i)
        rows = part.toArrow()
        found, shared = _score_slice(_relevant(docs, part, rows, keys), rows, keys, modes, k, schema)
        if slices == 1:
            return found, []
        results.append(stored(found))
        shared.destroy()
    return reduce(DataFrame.union, results), []


def settled(found: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The hits of cells, stored, so that what was dealt out leaves the disks before they are ranked."""
    if tables:
        found = stored(found)
        released(*tables)
    return found


def listed_topk(
    points: DataFrame, queries: DataFrame, wanted: DataFrame, k: int, slice_bytes: int = SLICE_BYTES, breadths=None
) -> DataFrame:
    """A superset of the best ``k`` dense hits of every query in the lists of its tenant that ``wanted`` names.

    ``points`` carry ``list_id``, ``wanted`` is tenant_id, query_id, list_id and
    perhaps rank. With ``breadths`` it holds the best of the lists up to each of
    these ranks. Beyond ``SENT_BYTES``, counted per query and list, a query is not
    repeated for its lists: it is dealt out once with their numbers.
    """
    keys, modes = ("tenant_id",), ("dense",)
    require_columns(points, *keys, "id", "list_id")
    require_columns(queries, *keys, "query_id")
    row_bytes = vector_bytes(modes) + F.lit(24 * k)
    if "rank" not in wanted.columns:
        wanted = wanted.withColumn("rank", F.lit(1))
    entry = F.struct("rank", F.col("list_id").cast("string").alias("list_id"))
    lists = wanted.groupBy("tenant_id", "query_id").agg(F.sort_array(F.collect_list(entry)).alias("_wanted"))
    # a query's lists stand in the order of their ranks, which begin at 1 or beyond every breadth
    lists = lists.select("tenant_id", "query_id", F.col("_wanted.list_id").alias("wanted"))
    # grows with the queries: never a broadcast through the driver, however small its files
    asked = stored(_query_side(queries, keys, modes).join(lists.hint("merge"), ["tenant_id", "query_id"]))
    if measured_bytes(asked, row_bytes * F.size("wanted")) <= SENT_BYTES:
        asked = asked.withColumn("list_id", F.explode("wanted")).drop("wanted")
        return settled(*_block_topk(points, asked, k, modes, ("tenant_id", "list_id"), slice_bytes))
    docs = stored(document_side(points, ("tenant_id", "list_id"), modes))
    schema = "tenant_id string, mode string, query_id bigint, id bigint, score double, list_id bigint, list_rank bigint"
    every = [np.iinfo(np.int64).max]
    found, cells = _score_cells(docs, asked, row_bytes, keys, modes, k, slice_bytes, schema, breadths or every)
    return settled(found.drop("list_rank"), [docs, asked, cells])


def id_order(mode: Column) -> Column:
    """Tie-break key: larger id first for dense scores, smaller id first otherwise."""
    return F.when(mode == "dense", -F.col("id")).otherwise(F.col("id"))


def take_top(scored: DataFrame, k: int, by=("tenant_id", "mode", "query_id")) -> DataFrame:
    """Add ``rank`` and keep ranks 1..k per group.

    The literal rank bound lets Spark cut every task's rows to k per group
    before the shuffle, so a hot query never gathers more than k x tasks rows.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("score"), id_order(F.col("mode")))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_query(scored: DataFrame) -> DataFrame:
    """Rows dealt by query once; ranking, fusing and ranking again then move nothing more."""
    return scored.repartition("tenant_id", "query_id")


def topk_candidates(points: DataFrame, queries: DataFrame, k: int, modes=("dense",), **plan) -> DataFrame:
    """A superset of the top k, which ``take_top`` cuts."""
    return settled(*_block_topk(points, queries, k, modes, **plan))


def exact_topk(points: DataFrame, queries: DataFrame, k: int, modes=("dense",), **plan) -> DataFrame:
    """tenant_id, mode, query_id, id, score, rank of the exact top k."""
    return take_top(topk_candidates(points, queries, k, modes, **plan), k)


def clamp_limit(k, low: int = 1, high: int = 20) -> Column:
    """Per-query result limit forced into ``low``..``high``."""
    value = F.col(k) if isinstance(k, str) else k
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))
