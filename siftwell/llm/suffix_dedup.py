"""Removal of long repeated byte strings with suffix arrays over shards.

A string of ``size`` bytes is removed if it starts anywhere else. Equal strings
must meet in one shard, and most text need not meet anything:

1. Of every window of ``size`` bytes the piece of ``PIECE`` bytes with the
   smallest hash is its anchor, at the same place in equal windows. Neighbouring
   windows with one anchor are a stretch; a text has about one per 75 bytes.
2. Anchors are counted over all texts. A stretch whose anchor occurs once has no
   repeated window; if all stretches of an anchor are equal, all their windows
   are repeated. Neither needs its bytes.
3. The different stretches of the other anchors are dealt to shards by anchor.
   Every shard is a suffix array by induced sorting with common prefixes
   (``suffix_sort``); a window is repeated if it shares ``size`` bytes with a
   neighbour in suffix order. The stretches of an anchor with more than ``hot``
   occurrences would fill a shard and are dealt again: windows that hold the
   anchor at 64 neighbouring places have a core in common, all their bytes but
   63, and meet by it. A core that occurs once, or in equal stretches only, is
   done; the others go to shards by their core or, still more than ``hot``, are
   dealt by 16, 4 and 1 places. One place is the window itself, so no group is
   ever larger.
4. Repeated windows go back to their texts, once per different text, and the
   covered bytes are cut out.

Texts are told apart by a 128-bit hash; anchors and stretches by 64 bits each.

Null text is an empty one. Texts shorter than ``size`` keep everything. Rows
are separate texts: of repeated rows every one is cut. An empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from siftwell.llm.shared import bounded_batches, shared_folder, table, text_or_empty, written
from siftwell.llm.suffix_sort import repeated_windows

SIZE = 200
PIECE = 50
#: A sorted byte takes about 150 bytes of a worker's memory.
SHARD_BYTES = 1 << 20
#: Stretches of an anchor before it is dealt again, by so many places of it at once.
HOT = 4_000
CELLS = (64, 16, 4, 1)
#: Repeated windows of a stretch.
RUNS = "array<struct<first: bigint, n: bigint>>"
_CHUNK = 1 << 19
_PLACE_BITS = 20


class Roller:
    """Hashes of any slice of a text from running sums modulo 2**64."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.signs = random.integers(0, 2**64, 256, np.uint64)
        factor = int(random.integers(0, 2**63)) * 2 + 1
        inverse = pow(factor, -1, 2**64)
        self.up = self._powers(factor)
        self.down = self._powers(inverse)

    @staticmethod
    def _powers(x: int) -> np.ndarray:
        out = np.full(_CHUNK + 4096, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.signs[data] * self.up[: len(data)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (sums[b] - sums[a]) * self.down[a]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_rollers: list[Roller] = []


def rollers() -> list[Roller]:
    if not _rollers:
        _rollers.extend([Roller(3), Roller(4), Roller(5)])
    return _rollers


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(data: bytes, size: int, piece: int) -> dict[str, np.ndarray]:
    """Stretches of a text: anchor hash, stretch hash, first window, number of windows.

    Long texts go chunk by chunk; a chunk holds whole windows, so every window
    belongs to one stretch.
    """
    out = []
    first, second, _ = rollers()
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, max(0, len(whole) - size + 1), _CHUNK - size):
        part = whole[begin : begin + _CHUNK - 1]
        n = min(len(part) - size + 1, _CHUNK - size)
        part = part[: n + size - 1]
        sums = first.sums(part)
        at = np.arange(len(part) - piece + 1)
        hashes = first.slices(sums, at, at + piece)
        keys = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
        anchor = (sliding_least(keys, size - piece + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[start, n])
        anchor = anchor[start]
        shape = ((anchor - start) << 10 | count).astype(np.uint64)
        other = second.slices(second.sums(part), start, start + count + size - 1)
        other = (other ^ shape) * np.uint64(0x9E3779B97F4A7C15)
        out.append((hashes[anchor], other ^ (other >> np.uint64(29)), start + begin, count))
    names = ("anchor", "stretch", "start", "count")
    if not out:
        return {k: np.empty(0, np.int64) for k in names}
    a, s, b, c = (np.concatenate(x) for x in zip(*out))
    return dict(zip(names, (a.view(np.int64), s.view(np.int64), b, c)))


def text_key(data: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), "<i8").tolist())


def _arrow(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def anchors(docs: DataFrame, size: int, piece: int) -> DataFrame:
    """``anchor, stretch`` of every stretch of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretches(t.as_py().encode(), size, piece) for t in batch.column(0)]
            yield _arrow({k: np.concatenate([f[k] for f in found]) for k in ("anchor", "stretch")})

    return docs.select(text_or_empty("t")).mapInArrow(scan, "anchor bigint, stretch bigint")


def located(docs: DataFrame, size: int, piece: int) -> DataFrame:
    """The stretches with their texts; copies within a batch are one row with their number (``times``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, found = Counter(t.as_py().encode() for t in batch.column(0)), []
            for data, times in copies.items():
                f, key = stretches(data, size, piece), text_key(data)
                n = len(f["anchor"])
                f |= {"d1": np.full(n, key[0]), "d2": np.full(n, key[1]), "times": np.full(n, times)}
                found.append(f)
            names = ("anchor", "stretch", "d1", "d2", "start", "count", "times")
            yield _arrow({k: np.concatenate([f[k] for f in found]).astype(np.int64) for k in names})

    return docs.select(text_or_empty("t")).mapInArrow(
        scan,
        "anchor bigint, stretch bigint, d1 bigint, d2 bigint, start bigint, count bigint, times bigint",
    )


def packed(docs: DataFrame, once: bool) -> DataFrame:
    """``d1, d2, id, z``: texts compressed for the way; copies within a batch ``once`` or each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(1)]
            if once:
                place = {x: i for i, x in enumerate(texts)}
                texts, batch = list(place), batch.take(pa.array(place.values(), pa.int64()))
            keys = np.array([text_key(x) for x in texts], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(0), pa.array(list(map(squeeze, texts)), pa.binary())],
                ["d1", "d2", "id", "z"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", text_or_empty("t")).mapInArrow(pack, f"d1 bigint, d2 bigint, id {kind}, z binary")


def cut_out(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``anchor, stretch, times, total, bytes`` of the wanted stretches, from any copy of their texts.

    Copies that were read in different batches repeat a stretch.
    """
    lists = wanted.groupBy("d1", "d2").agg(
        F.collect_list(F.struct("start", "count", "anchor", "stretch", "times", "total")).alias("w")
    )
    names, long = ("anchor", "stretch", "times", "total"), pa.int64()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, parts = [], []
            for z, w in zip(batch.column(0), batch.column(1)):
                data = open_(z.as_py())
                for x in w.as_py():
                    rows.append([x[n] for n in names])
                    parts.append(data[x["start"] : x["start"] + x["count"] + size - 1])
            table = np.array(rows, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, long) for c in table.T), pa.array(parts, pa.binary())], [*names, "bytes"]
            )

    return texts.join(lists, ["d1", "d2"]).select("z", "w").mapInArrow(
        cut, "anchor bigint, stretch bigint, times bigint, total bigint, bytes binary"
    )


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true flags as (first, number)."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def sharded(cuts: DataFrame, shards: int, size: int) -> DataFrame:
    """Repeated windows of the stretches by shard: ``whole, anchor, stretch, runs``."""

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["whole", "anchor", "stretch"])
        found = repeated_windows(frame["bytes"].tolist(), size)
        rows = []
        names = zip(frame["whole"], frame["anchor"], frame["stretch"], frame["times"], found)
        for whole, anchor, stretch, times, flags in names:
            flags = np.ones(len(flags), bool) if times > 1 else flags
            if flags.any():
                rows.append((whole, anchor, stretch, [{"first": a, "n": n} for a, n in _ranges(flags)]))
        return pd.DataFrame(rows, columns=["whole", "anchor", "stretch", "runs"])

    dealt = cuts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(sort, f"whole boolean, anchor bigint, stretch bigint, runs {RUNS}")


def anchor_place(data: bytes, size: int, piece: int) -> int:
    """Where the anchor of a stretch stands in its bytes."""
    part = np.frombuffer(data[:size], np.uint8)
    first = rollers()[0]
    at = np.arange(size - piece + 1)
    hashes = first.slices(first.sums(part), at, at + piece)
    return int((hashes >> np.uint64(_PLACE_BITS)).argmin())


def cells_of(data: bytes, place: int, cell: int, size: int) -> list[tuple[int, int, int, bytes]]:
    """A stretch by the cells of its anchor's place: cell, first window, windows, core.

    Window ``i`` holds the anchor at ``place - i``; the core is what all windows
    of a cell have in common, whichever of them the stretch has.
    """
    n, out = len(data) - size + 1, []
    for c in range((place - n + 1) // cell, place // cell + 1):
        low, high = c * cell, c * cell + cell - 1
        first, last = max(0, place - high), min(n - 1, place - low)
        out.append((c, first, last - first + 1, data[place - low : place - high + size]))
    return out


_ROOT = "root bigint, branch bigint, at bigint, n bigint, key bigint, part bigint, times bigint, place bigint, bytes binary"


def in_cells(hot: DataFrame, cell: int, size: int, piece: int) -> DataFrame:
    """The stretches of hot anchors cut by cells; ``root, branch`` is the stretch, ``at`` the first window in it."""
    names = [c.split()[0] for c in _ROOT.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                data, place = x["bytes"], x["place"]
                place = anchor_place(data, size, piece) if place < 0 else place
                for c, first, n, core in cells_of(data, place, cell, size):
                    mine = data[first : first + n + size - 1]
                    key = xxhash.xxh3_64_intdigest(b"%d,%d," % (x["key"], c) + core)
                    part = xxhash.xxh3_64_intdigest(b"%d,%d," % (place - first, n) + mine)
                    rows.append((x["root"], x["branch"], x["at"] + first, n, key, part, x["times"], place - first, mine))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            for k in (4, 5):
                columns[k] = np.array(columns[k], np.uint64).view(np.int64)
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return hot.mapInArrow(deal, _ROOT)


def dealt_again(hot: DataFrame, limit: int, size: int, piece: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of the stretches of hot anchors.

    ``anchor, stretch, times, bytes`` for the shards; where those parts come
    from (``key, part, anchor, stretch, at``); and runs that are known already.
    """
    rows = hot.select(
        F.col("anchor").alias("root"), F.col("stretch").alias("branch"), F.lit(0).cast("bigint").alias("at"),
        F.col("anchor").alias("key"), "times", F.lit(-1).cast("bigint").alias("place"), "bytes",
    )
    parts, origins, known = [], [], []
    for level, cell in enumerate(CELLS):
        cut = written(in_cells(rows, cell, size, piece), folder, f"cells-{level}")
        totals = cut.groupBy("key").agg(F.sum("times").alias("total"), (F.min("part") == F.max("part")).alias("alike"))
        met = cut.join(totals.where("total > 1"), "key")
        run = F.array(F.struct(F.col("at").alias("first"), F.col("n").alias("n")))
        known.append(met.where("alike").select(F.col("root").alias("anchor"), F.col("branch").alias("stretch"), run.alias("runs")))
        open_ = met.where("NOT alike")
        small = open_.where(F.col("total") <= limit)
        alike = small.groupBy(F.col("key").alias("anchor"), F.col("part").alias("stretch"))
        parts.append(alike.agg(F.sum("times").alias("times"), F.min("bytes").alias("bytes")))
        origins.append(small.select("key", "part", F.col("root").alias("anchor"), F.col("branch").alias("stretch"), "at"))
        if cell == 1 or open_.where(F.col("total") > limit).isEmpty():
            break
        rows = open_.where(F.col("total") > limit).select("root", "branch", "at", "key", "times", "place", "bytes")
    return tuple(reduce(DataFrame.unionByName, x) for x in (parts, origins, known))


def removed(covers: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs from (first window, number of windows)."""
    if not len(covers):
        return []
    covers = covers[np.argsort(covers[:, 0], kind="stable")]
    ends = np.maximum.accumulate(covers.sum(1) + size - 1)
    new = np.r_[True, covers[1:, 0] > ends[:-1]]
    first = covers[new, 0]
    last = np.r_[ends[:-1][new[1:]], ends[-1]]
    return list(zip(first.tolist(), last.tolist()))


def remove_repeats(
    docs: DataFrame,
    size: int = SIZE,
    id_column: str = "doc_id",
    text_column: str = "text",
    piece: int = PIECE,
    shard_bytes: int = SHARD_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """``id, n_bytes, spans`` (removed, end exclusive), ``kept`` (bytes that stay) of every row."""
    if not 0 < piece <= size < 1000:
        raise ValueError("piece must be between 1 and size, and size below 1000")
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    totals = anchors(docs, size, piece).groupBy("anchor").agg(
        F.count("*").alias("total"), F.min("stretch").alias("low"), F.max("stretch").alias("high")
    )
    shared = totals.where("total > 1").select("anchor", "total", (F.col("low") == F.col("high")).alias("alike"))
    met = located(docs, size, piece).join(shared, "anchor")
    met = written(met, folder, "met")
    mixed = met.where(~F.col("alike"))
    picked = mixed.groupBy("anchor", "stretch", "total").agg(
        F.sum("times").alias("times"), F.min(F.struct("d1", "d2", "start", "count")).alias("p")
    )
    picked = picked.select("anchor", "stretch", "total", "times", "p.*")
    cuts = written(cut_out(packed(docs, once=True), picked, size), folder, "cuts")
    columns = ["anchor", "stretch", "times", "bytes"]
    cold = cuts.where(F.col("total") <= hot).select(*columns)
    # Copies that were read apart have cut a stretch more than once.
    burning = cuts.where(F.col("total") > hot).dropDuplicates(["anchor", "stretch"])
    parts, origins, known = dealt_again(burning, hot, size, piece, folder)
    parts = written(parts, folder, "parts")
    amount = cold.unionByName(parts).agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-amount // shard_bytes))
    # Parts are told from whole stretches by a mark, their keys being hashes of other things.
    found = written(sharded(cold.withColumn("whole", F.lit(True)).unionByName(parts.withColumn("whole", F.lit(False))), shards, size), folder, "runs")
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("at")).alias("first"), r["n"].alias("n")))
    of_parts = found.where("NOT whole").select(F.col("anchor").alias("key"), F.col("stretch").alias("part"), "runs")
    of_parts = origins.join(of_parts, ["key", "part"]).select("anchor", "stretch", moved.alias("runs"))
    of_hot = known.unionByName(of_parts).groupBy("anchor", "stretch").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    windows = found.where("whole").drop("whole").unionByName(of_hot)
    back = mixed.join(windows, ["anchor", "stretch"]).select("d1", "d2", "start", "runs")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("count").alias("n")))
    covers = met.where("alike").select("d1", "d2", "start", whole.alias("runs")).unionByName(back)
    covers = covers.distinct().groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "runs")).alias("c"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, spans, kept = [], [], []
            for z, c in zip(batch.column(1), batch.column(2)):
                data = open_(z.as_py())
                pairs = [(x["start"] + r["first"], r["n"]) for x in c.as_py() or () for r in x["runs"]]
                pairs = np.array(pairs, np.int64).reshape(-1, 2)
                gone = removed(pairs, size, len(data))
                edges = [0, *(x for span in gone for x in span), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    out = packed(docs, once=False).join(covers, ["d1", "d2"], "left").select("id", "z", "c").mapInArrow(
        cut, f"id {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )
    return out.withColumnRenamed("id", id_column)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
