"""Periodic runs of words: block convolution at dyadic scales, extension of what it finds.

A run is a stretch of consecutive words in which words ``period`` apart are
equal, ``period`` being the smallest such distance, of at least
``max(min_length, 2 * period)`` words, that no neighbour extends.

* The documents of a batch are one sequence of integers; no integer is in two
  documents, so nothing crosses their ends.
* At a scale the sequence is cut into blocks of ``b`` words (3, then 5, 10, 20
  ...). A run of a period from ``2 * b - 1`` to ``4 * b - 2`` holds a whole block
  whose copy, one period on, is in the run, too. The sums of squared differences
  between a block and every place of the window at these distances are one
  product of number theoretic transforms, exact modulo a prime, for all blocks
  at once; a sum of zero is a copy (a sum that is a multiple of the prime is
  found out by the next step). A block with a word that does not occur again
  within the largest distance has no copy and is left out before.
* A block and the distance of its copy are a seed, which is extended to both
  sides word by word; stretches that are long enough are runs. Of equal
  stretches the smallest distance is the period. Copies inside a run already
  known, a multiple of its period away, are that run again and no seed.

Work is n log^2 n for the transforms; one document never leaves its task.

Null texts have no words; rows are documents, repeated rows each have their
runs; very long texts are a sequence of their own. Columns ``runs``, ``n_words``
and ``collapsed`` of the input are replaced, others pass. An empty table gives
an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftwell.llm.shared import bounded_batches, table
from siftwell.llm.sql import CRC_TABLE, crc32

MIN_LENGTH = 12
#: A prime with roots of unity of every order 2**k up to 2**27, and a generator.
PRIME, GENERATOR = 15 * 2**27 + 1, 31
#: Words of a sequence, unless one document is longer; numbers in a transform at once.
SEQUENCE, CELLS = 400_000, 1 << 18
_P = np.uint64(PRIME)


@lru_cache(maxsize=128)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    powers = np.ones(1, np.uint64)
    while len(powers) < half:
        powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), PRIME)) % _P])
    return powers


def transform(rows: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each row in place; the result is in bit-reversed order."""
    count, size = rows.shape
    half = size // 2
    while half:
        pair = rows.reshape(count, size // (2 * half), 2, half)
        left, right = pair[:, :, 0], pair[:, :, 1]
        apart = (left + (_P - right)) * _roots(half, False) % _P
        left += right
        left %= _P
        right[...] = apart
        half //= 2
    return rows


def inverse(rows: np.ndarray) -> np.ndarray:
    """The way back from bit-reversed order, in place."""
    count, size = rows.shape
    half = 1
    while half < size:
        pair = rows.reshape(count, size // (2 * half), 2, half)
        left, right = pair[:, :, 0], pair[:, :, 1]
        turned = right * _roots(half, True) % _P
        right[...] = (left + (_P - turned)) % _P
        left += turned
        left %= _P
        half *= 2
    rows *= np.uint64(pow(size, -1, PRIME))
    rows %= _P
    return rows


def copies(x: np.ndarray, places: np.ndarray, b: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances from ``near`` to ``far`` at which blocks of ``b`` words occur again.

    ``x`` goes on for ``far + b`` numbers after the last block.
    """
    size = 1 << (far - near + b - 1).bit_length()
    squares = np.cumsum(np.r_[np.uint64(0), x * x % _P])
    at, distance = [], []
    step = max(1, CELLS // size)
    for k in range(0, len(places), step):
        part = places[k : k + step]
        window = np.zeros((len(part), size), np.uint64)
        window[:, : far - near + b] = x[part[:, None] + np.arange(near, far + b)]
        block = np.zeros_like(window)
        block[:, -np.arange(b)] = x[part[:, None] + np.arange(b)]  # backwards: products are correlations
        product = inverse(transform(window) * transform(block) % _P)[:, : far - near + 1]
        ends = part[:, None] + np.arange(near, far + 1)
        total = squares[ends + b] - squares[ends] + (squares[part + b] - squares[part])[:, None]
        i, j = np.nonzero((total + np.uint64(2) * (_P - product)) % _P == 0)
        at.append(part[i])
        distance.append(j + near)
    return np.concatenate(at), np.concatenate(distance)


def _equal_right(x: np.ndarray, i: int, d: int) -> int:
    """First place from ``i`` on whose number differs from that ``d`` further."""
    step, end = 16, len(x) - d
    while i < end:
        stop = min(i + step, end)
        differ = x[i:stop] != x[i + d : stop + d]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = stop, 2 * step
    return end


def _equal_left(x: np.ndarray, i: int, d: int) -> int:
    """Start of the equal stretch that ends before ``i``."""
    step = 16
    while i > 0:
        start = max(0, i - step)
        differ = (x[start:i] != x[start + d : i + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, step = start, 2 * step
    return 0


def _scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block length, least and largest distance."""
    yield 3, 1, 8
    b = 5
    while 2 * (2 * b - 1) <= longest:
        yield b, 2 * b - 1, 4 * b - 2
        b *= 2


def sequence_runs(ids: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of the runs of a sequence, none of them longer than ``longest``."""
    n = len(ids)
    if min(n, longest) < min_length:
        return []
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n, np.int64)  # distance to the next place of the same number
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: dict[tuple[int, int], int] = {}
    for b, near, far in _scales(longest):
        reach = again[: n // b * b].reshape(-1, b).max(axis=1)
        places = np.flatnonzero(reach <= far) * b
        open_ = np.ones(len(places), bool)
        for (left, right), period in found.items():
            if period <= b:  # all copies of a block deep in this run are a multiple of its period away
                low, high = np.searchsorted(places, (left, right - b - far + 1))
                open_[low:high] = False
        places = places[open_]
        if not len(places):
            continue
        # What follows the end equals nothing.
        x = np.concatenate([ids, np.arange(n, n + far + b) + int(ids.max())]).astype(np.uint64)
        at, distance = copies(x, places, b, near, far)
        fresh = np.ones(len(at), bool)
        for (left, right), period in found.items():
            low, high = np.searchsorted(at, (left, right - b - near + 1))
            inside = at[low:high] + b + distance[low:high] <= right
            fresh[low:high] &= ~(inside & (distance[low:high] % period == 0))
        at, distance = at[fresh], distance[fresh]
        order = np.lexsort((at, distance))
        known, upto = 0, 0
        for s, d in zip(at[order].tolist(), distance[order].tolist()):
            if d == known and s + b + d <= upto:
                continue  # the stretch before
            start, end = _equal_left(ids, s, d), _equal_right(ids, s, d) + d
            known, upto = d, end
            if end - start >= max(min_length, 2 * d):
                found.setdefault((start, end), d)
    return [(start, end, period) for (start, end), period in found.items()]


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: all of it after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        depth[start + period] += 1
        depth[end] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def runs_of_all(documents: list[list], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """``(start, end, period)`` by start, then period, of each list of words."""
    parts, begin, base = [], [0], 0
    for words in documents:
        names = dict.fromkeys(words)
        names = dict(zip(names, range(base, base + len(names))))
        parts.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
        begin.append(begin[-1] + len(words))
        base += len(names)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    found = sequence_runs(np.concatenate([np.empty(0, np.int64), *parts]), max(map(len, documents), default=0), min_length)
    owners = np.searchsorted(begin, [start for start, _, _ in found], "right") - 1
    for owner, (start, end, period) in zip(owners.tolist(), found):
        runs[owner].append((start - begin[owner], end - begin[owner], period))
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in runs]


def periodic_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    rewrite: Callable[[object, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """The documents with ``n_words``, ``runs`` (start, length, period) and the ``collapsed`` text.

    ``rewrite(id, n)`` may name the words of a document by their numbers, in the
    order in which they are to be read; None leaves them as they are.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("runs", "n_words", "collapsed")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*docs.schema.fields]).add("n_words", T.LongType())
    schema = schema.add("runs", T.ArrayType(run)).add("collapsed", T.StringType())
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def results(documents: list[list[bytes]]) -> Iterator[tuple]:
        for words, runs in zip(documents, runs_of_all(documents, min_length)):
            rows = [{"start": s, "length": e - s, "period": p} for s, e, p in runs]
            yield len(words), rows, b" ".join(collapsed_words(words, runs)).decode()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_column))
            texts = batch.column(batch.schema.get_field_index(text_column))
            out, held, size = [], [], 0
            for key, text in zip(ids, texts):
                words = (text.as_py() or "").encode().split()
                if rewrite and words and (places := rewrite(key.as_py(), len(words))) is not None:
                    words = [words[i] for i in places.tolist()]
                if held and size + len(words) > SEQUENCE:
                    out += results(held)
                    held, size = [], 0
                held.append(words)
                size += len(words)
            out += results(held)
            counts, runs, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(runs, arrow), pa.array(kept, pa.string())],
                [*batch.schema.names, "n_words", "runs", "collapsed"],
            )

    return docs.mapInArrow(find, schema)


def planted(doc_id, n: int) -> np.ndarray | None:
    """The contract's documents: one in ten repeats the words from a place of its own on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    runs = F.col("runs")
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    return docs.withColumn("best", F.array_max(ranked)).select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.l") / -F.col("best.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP13_SQL = (
    r"""
with recursive """ + CRC_TABLE + r""", d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w0
  from documents
), h as (
  select r, doc_id, w0, len(w0) as n, """ + crc32("[unicode(x) for x in string_split(doc_id::varchar, '')]") + r""" as h
  from d, crc_table
), g as (
  select *, h // 10 as g, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from h
), p as (
  select *, 1 + (n - a) // (3 + g % 8) as p from g
), w as (
  select r, doc_id, case when a is null then w0
    else [w0[1 + case when i < a then i else a + (i - a) % p end] for i in range(n)] end as w
  from p
), e as (
  select r, unnest(range(len(w))) as i, unnest(w) as word from w
), same as (
  select x.r, y.i - x.i as q, x.i from e x join e y on x.r = y.r and x.word = y.word and x.i < y.i
), stretches as (
  select r, q, min(i) as start, max(i) + 1 + q as stop
  from (select *, i - row_number() over (partition by r, q order by i) as island from same)
  group by r, q, island
), runs as (
  select r, start, stop - start as length, min(q) as period
  from stretches where stop - start >= greatest(12, 2 * q) group by r, start, stop
), each as (
  select r, count(*) as n_runs, max((length, -start, -period)) as best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from runs group by r
), gone as (
  select distinct r, unnest(range(start + period, start + length)) as i from runs
), kept as (
  select r, string_agg(word, ' ' order by i) as words from e anti join gone using (r, i) group by r
)
select doc_id, coalesce(n_runs, 0) as n_runs, -best[2] as start, best[1] as length, -best[3] as period,
  1000 * best[1] // -best[3] as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
  sha256(coalesce(words, '')) as collapsed_sha256
from w left join each using (r) left join kept using (r)
"""
)
