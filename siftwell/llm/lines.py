"""Line dedup: documents probe a sharded minimal perfect hash of frequent line keys.

Pass one counts, per key, the documents that hold it (a key once per document,
summed inside the task before the shuffle). Keys that are frequent enough are
dealt to shards by hash; each shard builds levels of bit arrays (a key takes
the bit that no other key of its level wants; the rest goes on to the next
level), so the number of bits set before a key's own bit is its slot, and the
slots are exactly as many as the keys. A slot holds a 64-bit fingerprint of
another half of the 128-bit key hash and the count. Pass two probes documents
against bundles of shards of at most ``bundle_bytes``; a bundle is read to the
driver and sent out by itself, and more keys mean more passes over what the
earlier ones left. Lines are never joined.

Null and empty texts are one empty line. Empty keys are kept unless
``min_chars`` is 0. A row is a document: repeated rows each count. Columns
named ``n_lines`` or ``n_dropped`` in the input are replaced, others pass. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from siftwell.llm.shared import bounded_batches, shared_folder, table, written

BLANK = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
SHARD_KEYS = 65_536
BUNDLE_BYTES = 64 << 20
LEVELS = 24
#: About this many bytes per key: bits, ranks, fingerprint, count.
_KEY_BYTES = 16


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def key_hashes(lines: list[bytes], min_chars: int) -> np.ndarray:
    """128-bit key hash of each line as two words; shorter keys are all zero."""
    keys = (line.strip(BLANK).lower() for line in lines)
    digest, none = xxhash.xxh3_128_digest, bytes(16)
    if min_chars > 1:
        parts = [digest(k) if len(k.decode()) >= min_chars else none for k in keys]
    else:
        parts = [digest(k) if len(k) >= min_chars else none for k in keys]
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_shard(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Levels of one shard: (level, bits, words, fingerprints, counts); level -1 holds the rest."""
    rows = []
    for level in range(LEVELS):
        if not len(first):
            return rows
        bits = -(-max(64, int(1.5 * len(first))) // 64) * 64
        at = (_mix(first, level) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits)[at] == 1
        order = np.argsort(at[alone])
        flags = np.zeros(bits, np.uint8)
        flags[at[alone]] = 1
        words = np.packbits(flags, bitorder="little").tobytes()
        rows.append((level, bits, words, second[alone][order].tobytes(), counts[alone][order].tobytes()))
        first, second, counts = first[~alone], second[~alone], counts[~alone]
    if len(first):
        rows.append((-1, 0, first.tobytes(), second.tobytes(), counts.tobytes()))
    return rows


class Bundle:
    """Neighbouring shards as arrays that many lines probe at once."""

    def __init__(self, rows: list, low: int, high: int):
        self.low, self.high = low, high
        self.rest: dict[tuple[int, int], int] = {}
        levels = sorted({r.level for r in rows if r.level >= 0})
        self.bits = np.zeros((len(levels), high - low), np.uint64)
        self.offset = np.zeros((len(levels), high - low), np.int64)
        words, prints, counts, base = [], [], [], 0
        for r in sorted(rows, key=lambda r: (r.level, r.shard)):
            if r.level < 0:
                a, b, c = (np.frombuffer(x, d) for x, d in ((r.words, "<u8"), (r.prints, "<u8"), (r.counts, "<i8")))
                self.rest.update(zip(zip(a.tolist(), b.tolist()), c.tolist()))
                continue
            self.bits[r.level, r.shard - low] = r.bits
            self.offset[r.level, r.shard - low] = base
            base += r.bits
            words.append(np.frombuffer(r.words, "<u8"))
            prints.append(np.frombuffer(r.prints, "<u8"))
            counts.append(np.frombuffer(r.counts, "<i8"))
        join = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
        self.words, self.prints, self.counts = join(words, "<u8"), join(prints, "<u8"), join(counts, "<i8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def lookup(self, keys: np.ndarray, shards: int) -> np.ndarray:
        """Count of each key, 0 if it has no slot here."""
        found = np.zeros(len(keys), np.int64)
        shard = keys[:, 0].view(np.int64) % shards
        live = np.flatnonzero((shard >= self.low) & (shard < self.high) & keys.any(axis=1))
        shard -= self.low
        for level in range(len(self.bits)):
            live = live[self.bits[level, shard[live]] > 0] if not self.rest else live
            if not len(live):
                return found
            bits = np.maximum(self.bits[level, shard[live]], np.uint64(1))
            at = self.offset[level, shard[live]] + (_mix(keys[live, 0], level) % bits).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            there = self.bits[level, shard[live]] > 0
            there &= (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot = self.before[word] + np.bitwise_count(below)
            hit, slot = live[there], slot[there]
            found[hit] = np.where(self.prints[slot] == keys[hit, 1], self.counts[slot], 0)
            live = live[~there]
        for i in live if self.rest else ():
            found[i] = self.rest.get((int(keys[i, 0]), int(keys[i, 1])), 0)
        return found


def count_keys(docs: DataFrame, text_column: str, min_chars: int) -> DataFrame:
    """Documents per line key: ``h1, h2, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = []
            for value in batch.column(0):
                keys = key_hashes(split_lines(value.as_py()), min_chars)
                mine.append(np.unique(keys[keys.any(axis=1)], axis=0))
            keys = np.concatenate(mine) if mine else np.empty((0, 2), "<u8")
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys = keys[order]
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)][: len(keys)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[new, 0].view(np.int64)), pa.array(keys[new, 1].view(np.int64)),
                 pa.array(np.diff(np.r_[new, len(keys)]), pa.int64())],
                ["h1", "h2", "n"],
            )

    counted = docs.select(text_column).mapInArrow(count, "h1 bigint, h2 bigint, n bigint")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def hash_shards(frequent: DataFrame, shards: int) -> DataFrame:
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rows = build_shard(
            frame["h1"].to_numpy().view(np.uint64),
            frame["h2"].to_numpy().view(np.uint64),
            frame["n"].to_numpy(),
        )
        out = pd.DataFrame(rows, columns=["level", "bits", "words", "prints", "counts"])
        out.insert(0, "shard", frame["shard"].iloc[0])
        return out

    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int")
    return (
        frequent.withColumn("shard", shard)
        .groupBy("shard")
        .applyInPandas(
            build, "shard int, level int, bits bigint, words binary, prints binary, counts binary"
        )
    )


def drop_frequent_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = 1,
    text_column: str = "text",
    shard_keys: int = SHARD_KEYS,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """The documents with the text that stays, ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark)
    docs = docs.drop("n_lines", "n_dropped")
    frequent = written(
        count_keys(docs, text_column, min_chars).where(F.col("n") >= min_docs), folder, "frequent"
    )
    shards = max(1, -(-frequent.count() // shard_keys))
    arrays = written(hash_shards(frequent, shards), folder, "shards")
    step = max(1, bundle_bytes // (_KEY_BYTES * shard_keys))
    out, schema = docs, T.StructType([*docs.schema.fields])
    for name in ("n_lines", "n_dropped"):
        schema = schema.add(name, T.LongType())
    for low in range(0, shards, step):
        high = min(low + step, shards)
        rows = arrays.where(F.col("shard").between(low, high - 1)).collect()
        bundle = spark.sparkContext.broadcast(vars(Bundle(rows, low, high)))  # plain arrays
        out = out.mapInArrow(_probe(bundle, text_column, min_chars, min_docs, shards), schema)
        if high < shards:
            out = written(out, folder, f"after-{high}")
    return out


def _probe(bundle, text_column: str, min_chars: int, min_docs: int, shards: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Bundle.__new__(Bundle)
        vars(arrays).update(bundle.value)
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            texts = [split_lines(value.as_py()) for value in batch.column(at)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            lines = [line for text in texts for line in text]
            keep = arrays.lookup(key_hashes(lines, min_chars), shards) < min_docs
            begin, kept = np.cumsum(sizes) - sizes, []
            for i, text in enumerate(texts):
                mine = keep[begin[i] : begin[i] + sizes[i]]
                kept.append(b"\n".join(text if mine.all() else [x for x, k in zip(text, mine) if k]))
            dropped = sizes - (np.add.reduceat(keep, begin, dtype=np.int64) if len(texts) else 0)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[text_column] = pa.array([x.decode() for x in kept], pa.string())
            if "n_lines" in columns:  # an earlier bundle has counted them
                columns["n_dropped"] = pa.compute.add(columns["n_dropped"], pa.array(dropped))
            else:
                columns |= {"n_lines": pa.array(sizes), "n_dropped": pa.array(dropped)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return probe


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


OP9_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
l as (
  select r, doc_id, generate_subscripts(string_split(t, chr(10)), 1) as i,
    unnest(string_split(t, chr(10))) as line
  from d
), k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
), f as (
  select key from k where length(key) >= 1 group by key having count(distinct r) >= 10
)
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key
group by r, doc_id
"""
