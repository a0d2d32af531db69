"""Best-fit packing of token sequences, in rounds over classes of equal size.

Every document becomes one piece, longer ones are cut at the sequence size.
Pieces of one length are interchangeable, and so are sequences with one gap:
a round works on runs (gap, number of sequences) and classes (length, number
of pieces), at most ``size`` classes whatever the input. In a round

1. runs and classes stand sorted by size;
2. every run asks for its successor: the longest class that fits its gap;
3. runs that ask for the same class are ranked, tightest gap first, and the
   class serves them in that order until it is empty (a run may be split);
4. gaps shrink by what came in, and the next round begins.

Pieces above half the size open their sequences at the start; when no gap fits
anything, as many sequences open as the rest needs at least. The pieces then
get a rank within their length by a salted running count and look up the run
that took this rank, so no piece passes through the driver.

Null text is empty. An empty document still has its end token. Repeated rows
are packed each by itself, an empty table packs into nothing, and other
columns are not read. Equal pieces are told apart by the place where they were
read, which is stored with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siftwell.llm.shared import bounded_batches, shared_folder, table, text_or_empty, written
from siftwell.llm.tokens import tokenizer

SIZE = 4096
END_ID = 1
#: Pieces that one task ranks, about.
RANKED = 200_000


def plan(lengths: np.ndarray, counts: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Slots: pieces ``rank .. rank + n`` of ``length`` go to sequences ``first ..`` at ``offset``."""
    order = np.argsort(lengths)
    length, left = np.asarray(lengths)[order], np.asarray(counts)[order].astype(np.int64)
    taken = np.zeros(len(length), np.int64)
    gap, first, n = (np.empty(0, np.int64) for _ in range(3))
    slots, opened = [], 0

    def fill(which, first_, n_, gap_):
        """Record that runs take the next pieces of their classes."""
        start = np.cumsum(n_) - n_
        new = np.r_[True, which[1:] != which[:-1]] if len(which) else np.empty(0, bool)
        start = start - np.repeat(start[new], np.diff(np.r_[np.flatnonzero(new), len(which)]))
        slots.append((length[which], taken[which] + start, n_, first_, size - gap_))
        np.add.at(taken, which, n_)
        np.subtract.at(left, which, n_)

    large = np.flatnonzero((2 * length > size) & (left > 0))
    if len(large):
        n = left[large].copy()
        first = np.cumsum(n) - n
        opened = int(n.sum())
        fill(large, first, n, np.full(len(large), size))
        gap = size - length[large]
    while left.any():
        there = np.flatnonzero(left)
        wants = np.searchsorted(length[there], gap, "right") - 1
        keep = wants >= 0
        gap, first, n, wants = gap[keep], first[keep], n[keep], wants[keep]
        if not len(gap):
            more = -(-int((length * left).sum()) // size)
            gap, first, n = np.array([size]), np.array([opened]), np.array([more])
            opened += more
            continue
        order = np.argsort(gap, kind="stable")  # the classes asked for are then in order too
        gap, first, n, which = gap[order], first[order], n[order], there[wants[order]]
        before = np.cumsum(n) - n
        new = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        before -= np.repeat(before[new], np.diff(np.r_[new, len(which)]))
        got = np.clip(left[which] - before, 0, n)
        hit, rest = got > 0, got < n
        fill(which[hit], first[hit], got[hit], gap[hit])
        gap, first, n = (
            np.r_[gap[hit] - length[which[hit]], gap[rest]],
            np.r_[first[hit], first[rest] + got[rest]],
            np.r_[got[hit], (n - got)[rest]],
        )
    names = ("length", "rank", "n", "first", "offset")
    if not slots:
        return {k: np.empty(0, np.int64) for k in names}
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*slots)]
    order = np.lexsort((columns[1], columns[0]))
    return {k: x[order] for k, x in zip(names, columns)}


def pieces(
    docs: DataFrame, tokenizer_path: str, size: int, end_id: int, id_column: str, text_column: str
) -> DataFrame:
    """One row per piece, with the place where it was read (``uid``)."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = tokenizer(tokenizer_path), np.asarray([end_id], "<u4")
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.r_[model.ids(value.as_py()), end].astype("<u4")
                for k in range(0, len(ids), size):
                    part = ids[k : k + size]
                    source.append(i)
                    piece.append(k // size)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            keys = batch.column(0).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(uid, uid + len(piece)), pa.int64()), keys, pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["uid", "id", "piece", "start", "length", "ids_crc32"],
            )
            uid += len(piece)

    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        cut, f"uid bigint, id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """``rank`` of each piece within its length: a running count over salted parts of the length."""
    salts = max(1, -(-total // RANKED))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    part = Window.partitionBy("length", "salt").orderBy("uid")
    inner = cut.withColumn("rank", F.row_number().over(part) - 1)
    if salts == 1:
        return inner.drop("salt")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("length", "salt").count()
    bases = sizes.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return (
        inner.join(bases.drop("count"), ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .drop("salt", "base")
    )


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = SIZE,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    cut = written(
        pieces(docs, tokenizer_path, size, end_id, id_column, text_column), folder, "pieces"
    )
    classes = cut.groupBy("length").count().collect()  # at most ``size`` rows
    total = sum(x["count"] for x in classes)
    slots = plan(
        np.array([x["length"] for x in classes], np.int64),
        np.array([x["count"] for x in classes], np.int64),
        size,
    )
    shared = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        ends = np.searchsorted(s["length"], np.arange(size + 2))
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for one in np.unique(length):
                low, high = ends[one], ends[one + 1]
                mine = length == one
                at[mine] = low + np.searchsorted(s["rank"][low:high], rank[mine], "right") - 1
            sequence = s["first"][at] + rank - s["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence), pa.array(s["offset"][at])],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = cut.schema["id"].dataType.simpleString()
    placed = (
        ranked(cut, total)
        .withColumn("rank", F.col("rank").cast("bigint"))
        .mapInArrow(
            place,
            f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
            "sequence_id bigint, offset bigint",
        )
    )
    return placed.withColumnRenamed("id", id_column)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))
