"""SimHash near-duplicates: fingerprints, pivot distances, connected groups.

A fingerprint has ``parts`` words of 64 bits; every part takes the shingle
hashes through a mixing step of its own (the first takes them as they are).
Copies share a fingerprint and are one point from the start. Points meet in
tables: a table is a choice of bits, and its points are dealt by them.

* ``block_masks``: pairs within ``max_bits`` of 64 agree on ``equal`` of
  ``blocks`` bit blocks if ``blocks - equal >= max_bits``: no pair is missed.

In a meeting the Hamming distances to ``PIVOTS`` reference fingerprints are
computed once per point; by the triangle inequality a pair whose distance to any
pivot differs by more than ``max_bits`` is discarded (the first pivot orders the
points, so whole stretches are never looked at), and survivors are verified by
their own distance. Only links that join two groups of the task leave it.
Large meetings are cut into tiles and every pair of tiles is a meeting of its
own. Groups are closed by large-star / small-star rounds on tables.

Null and wordless texts have fingerprint zero and are linked like any other.
Repeated rows share a fingerprint; null ids never name a group unless all its
ids are null. Fewer words than a shingle: the whole sequence is the shingle.
Other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from siftwell.llm.shared import bounded_batches, shared_folder, table, written

SEED = 42
MAX_BITS = 4
BLOCKS, EQUAL = 6, 2
TILE = 2048
PIVOTS = 12
_STEP = 65_536


def _mixed(hashes: np.ndarray, part: int) -> np.ndarray:
    if not part:
        return hashes
    x = hashes + np.uint64(part * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text in their order, in steps; none without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :].tolist()
    first = starts[:n].tolist()
    one = xxhash.xxh64_intdigest
    for k in range(0, n, _STEP):
        spans = zip(first[k : k + _STEP], last[k : k + _STEP])
        yield np.array([one(joined[a:b], SEED) for a, b in spans], "<u8")


def fingerprint(text: str | None, words: int, parts: int = 1) -> np.ndarray:
    """Fingerprint of a text as ``parts`` 64-bit words (0 without words)."""
    counts, n = np.zeros((parts, 64), np.int64), 0
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        for part in range(parts):
            octets = _mixed(hashes, part).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little")
            counts[part] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0]


def with_fingerprints(
    docs: DataFrame, words: int, parts: int = 1, text_column: str = "text", name: str = "fp"
) -> DataFrame:
    """The rows with their fingerprint, an array of signed longs."""
    bounded_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            fps = [fingerprint(x.as_py(), words, parts).view(np.int64) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fps, pa.list_(pa.int64()))], [*batch.schema.names, name]
            )

    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields]).add(name, T.ArrayType(T.LongType()))
    return docs.mapInArrow(compute, schema)


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def block_masks(blocks: int, equal: int) -> list[list[int]]:
    """Bit masks of every choice of ``equal`` of ``blocks`` neighbouring bit blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [[_signed(sum(chosen))] for chosen in combinations(pieces, equal)]


def meetings(points: DataFrame, masks: list[list[int]], tile: int) -> DataFrame:
    """``t, key, a, b, point, fp``: points that agree on the bits of table t, tile by tile."""

    def key(mask: list[int]):
        return F.xxhash64(*(F.col("fp")[p].bitwiseAND(F.lit(m)) for p, m in enumerate(mask)))

    keys = F.array(*(F.struct(F.lit(i).alias("t"), key(m).alias("key")) for i, m in enumerate(masks)))
    keyed = points.select("point", F.explode(keys).alias("k")).select("point", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").count().where(F.col("count") > 1)
    tiles = F.ceil(F.col("count") / tile).cast("int")
    dealt = keyed.join(sizes.select("t", "key", tiles.alias("tiles")), ["t", "key"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("point", "t"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = dealt.select("*", other.alias("other")).select(
        "t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "point"
    )
    # The fingerprints follow only those that meet somebody.
    return met.join(points.select("point", "fp"), "point").select("t", "key", "a", "b", "point", "fp")


def pivots(parts: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, (PIVOTS, parts), np.uint64)


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def links(fps: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that join the points of each group as far as they are linked: a forest.

    ``fps`` has a row per point; ``group`` is sorted.
    """
    distance = np.stack([bits_apart(fps, p) for p in pivots(fps.shape[1])], axis=1)
    order = np.lexsort((distance[:, 0], group))
    fps, group, distance = fps[order], group[order], distance[order]
    parent = np.arange(len(fps))
    left, right = [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    live, step = np.arange(len(fps)), 0
    while len(live):
        step += 1
        live = live[live + step < len(fps)]
        near = (group[live] == group[live + step]) & (
            distance[live + step, 0] - distance[live, 0] <= max_bits
        )
        live = live[near]  # later rows are further off the pivot still
        i, j = live, live + step
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        for p in range(1, PIVOTS):
            close = np.abs(distance[i, p] - distance[j, p]) <= max_bits
            i, j = i[close], j[close]
        close = bits_apart(fps[i], fps[j]) <= max_bits
        for x, y in zip(i[close].tolist(), j[close].tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(x)
                right.append(y)
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def linked(points: DataFrame, max_bits: int, masks: list[list[int]], tile: int) -> DataFrame:
    """Links ``u > v`` between points, enough to connect every group."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            new = np.zeros(len(columns[0]), bool)
            for c in columns[:4]:
                new[1:] |= c[1:] != c[:-1]
            i, j = links(columns[5].view(np.uint64), np.cumsum(new), max_bits)
            u, v = columns[4][i], columns[4][j]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"]
            )

        held = None  # the last meeting of a batch may go on in the next
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[:5]]
            columns.append(batch.column(5).flatten().to_numpy().reshape(len(columns[0]), -1))
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            same = np.ones(len(columns[0]), bool)
            for c in columns[:4]:
                same &= c == c[-1]
            cut = int(np.argmax(same)) if len(same) else 0
            held = [c[cut:] for c in columns]
            if cut:
                yield found([c[:cut] for c in columns])
        if held is not None and len(held[0]):
            yield found(held)

    met = meetings(points, masks, tile).repartition("t", "key", "a", "b")
    ordered = met.sortWithinPartitions("t", "key", "a", "b")
    return ordered.mapInArrow(link, "u bigint, v bigint").distinct()


def closed(edges: DataFrame, folder: str) -> DataFrame:
    """``u, v``: v is the smallest member of u's group, for every member but that one."""

    def low(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first())

    edges, before, turn = written(edges, folder, "edges-0"), None, 0
    while (now := state(edges)) != before:
        before, turn = now, turn + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = low(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), folder, f"large-{turn}")
        small = large.join(low(large), "u")
        pairs = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(pairs.union(small.select("u", F.col("m").alias("v"))).distinct(), folder, f"edges-{turn}")
    return edges


def groups_of(prints: DataFrame, folder: str, max_bits: int, masks: list[list[int]], tile: int = TILE) -> DataFrame:
    """``fp, group, component_id`` of every fingerprint among ``prints`` (``id, fp``)."""
    points = prints.groupBy("fp").agg(F.min("id").alias("least"))
    points = written(points.withColumn("point", F.monotonically_increasing_id()), folder, "points")
    members = closed(linked(points.select("point", "fp"), max_bits, masks, tile), folder)
    rooted = points.join(members, points.point == members.u, "left").select(
        "fp", "least", F.coalesce("v", "point").alias("group")
    )
    names = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    return rooted.join(names, "group").select("fp", "group", "component_id")


def near_duplicate_groups(
    docs: DataFrame,
    words: int = 5,
    max_bits: int = MAX_BITS,
    id_column: str = "doc_id",
    text_column: str = "text",
    blocks: int = BLOCKS,
    equal: int = EQUAL,
    tile: int = TILE,
) -> DataFrame:
    """``id, fingerprint`` (hex), ``component_id`` of every row: the smallest id of its group.

    64-bit fingerprints; every pair within ``max_bits`` is linked.
    """
    if blocks - equal < max_bits:
        raise ValueError("blocks - equal must be at least max_bits, or pairs are lost")
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    prints = written(with_fingerprints(rows, words).select("id", "fp"), folder, "prints")
    named = groups_of(prints, folder, max_bits, block_masks(blocks, equal), tile)
    return prints.join(named, "fp").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_per_group(
    docs: DataFrame,
    words: int = 5,
    max_bits: int = MAX_BITS,
    id_column: str = "doc_id",
    text_column: str = "text",
    blocks: int = BLOCKS,
    equal: int = EQUAL,
    tile: int = TILE,
) -> DataFrame:
    """The documents, one of each group of ``near_duplicate_groups``: that of the smallest id, null last.

    Of several rows with that id the smallest fingerprint stays, of equal ones
    any. All columns pass, whatever their names. Rows whose id occurs once are
    kept or dropped by their id; only those of repeated ids are hashed again.
    """
    if blocks - equal < max_bits:
        raise ValueError("blocks - equal must be at least max_bits, or pairs are lost")
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    prints = written(with_fingerprints(rows, words).select("id", "fp"), folder, "prints")
    named = groups_of(prints, folder, max_bits, block_masks(blocks, equal), tile)
    alike = prints.groupBy("id", "fp").agg(F.count("*").alias("n")).join(named.select("fp", "group"), "fp")
    first = F.min(F.struct(F.col("id").isNull(), "id", "fp")).alias("w")
    stay = alike.groupBy("group").agg(first).select(F.col("w.id").alias("_id"), F.col("w.fp").alias("_fp"))
    marked = alike.join(stay, F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    fate = marked.withColumn("stays", F.col("_fp").isNotNull()).groupBy("id").agg(
        (F.sum("n") > 1).alias("repeated"), F.max("stays").alias("stays"),
        F.collect_set(F.when(F.col("stays"), F.col("fp"))).alias("fps"),
    )
    fate = written(fate.where("repeated OR NOT stays"), folder, "fate")

    key, fp, turn = (_unused(docs, name) for name in ("key", "fp", "turn"))
    keyed = docs.withColumn(key, _key(id_column))
    fate = fate.withColumn("id", _key("id")).withColumnRenamed("id", key)
    once = keyed.join(fate.select(key), key, "left_anti")
    again = keyed.join(fate.where("repeated AND stays").select(key), key, "left_semi")
    again = with_fingerprints(again, words, text_column=text_column, name=fp)
    chosen = fate.select(key, F.explode("fps").alias(fp))
    order = Window.partitionBy(key, fp).orderBy(key)
    again = again.join(chosen, [key, fp]).withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _key(column: str):
    """An id as text, null apart from every value."""
    value = F.col(column)
    return F.when(value.isNull(), "n").otherwise(F.concat(F.lit("v"), value.cast("string")))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), words=4)
