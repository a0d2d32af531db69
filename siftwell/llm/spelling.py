"""Spelling variants: words one code point apart, found in a bit-sliced position index.

Words are maximal runs of letters, counted over all documents (summed in the
task, then by Spark). Two words are near if one inserted, deleted or replaced
code point makes one the other; a word's form is its near word of largest count
(ties: the smallest word) if that is ``ratio`` times its own, and its root is
where the forms lead.

* Groups. Let the shorter word of a near pair have ``m`` code points, those
  that are not known to be equal. The difference is in one place, so the first
  or the last ``m // 2`` of them agree: a word goes to a group by its head and
  to one by its tail, with the words of its length and those one longer, and
  again with those one shorter. Groups of more than ``limit`` words are dealt
  again by half of what is left, until a group differs in one place only, so a
  frequent head never makes a large group and no pair is lost.
* Index. In a group a word is a bit. For each position and letter a bitset has
  the words with that letter there. Reading a query letter by letter, three
  bitsets are kept for 64 words at a time: those that agree so far (``exact``),
  those with one replaced letter (``replaced``) and those with one letter more,
  which are looked up one position on (``longer``).
* A pair may meet by its head and by its tail; the length of its common head
  says in which group it counts. Tasks hand out, per word and group, the number
  of near words and the best of them, never pairs.

Null texts have no words; an empty table gives an empty one. Repeated rows are
counted each. Very long runs are words like others. Only the id and the text are
read, other columns have no effect.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftwell.llm.shared import bounded_batches, shared_folder, table, written
from siftwell.llm.sql import CRC_TABLE, crc32

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a group before it is dealt again.
LIMIT = 4096
#: Words counted before they leave a task; letters of an index, places of words and their groups at once.
COUNTED, LETTERS, PLACES = 200_000, 1 << 21, 1 << 19
_ALL = np.uint64(2**64 - 1)


def word_counts(
    docs: DataFrame,
    min_chars: int,
    id_column: str,
    text_column: str,
    change: Callable[[object], Callable[[bytes], bytes] | None] | None = None,
) -> DataFrame:
    """``word, n`` of the words of at least ``min_chars`` letters."""
    bounded_batches(docs.sparkSession)
    # One byte is one code point: letters end at U+00FF, anything beyond is no letter.
    letters = re.compile(rb"[a-z\xc0-\xff]{%d,}" % min_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            names = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(held.values(), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                found = letters.findall((text.as_py() or "").encode("latin-1", "replace").lower())
                changed = change(key.as_py()) if change and found else None
                if changed:
                    for word, n in Counter(found).items():
                        word = changed(word)
                        if len(word) >= min_chars:
                            held[word] += n
                else:
                    held.update(found)
                if len(held) > COUNTED:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(id_column, text_column)
    counted = rows.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Each word of a group in the two groups by half of what is left."""
    half = F.floor((F.col("base") - F.col("head") - F.col("tail")) / 2).cast("int")
    deeper = F.explode(F.array(
        F.struct(F.concat("path", F.lit("h")).alias("path"), (F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.concat("path", F.lit("t")).alias("path"), F.col("head").alias("head"), (F.col("tail") + half).alias("tail")),
    ))
    return rows.select("word", "n", "base", deeper.alias("p")).select("word", "n", "base", "p.*")


def _keyed(rows: DataFrame) -> DataFrame:
    ends = F.xxhash64(F.expr("left(word, head)"), F.expr("right(word, tail)"))
    return rows.withColumn("key", ends)


def word_groups(vocabulary: DataFrame, min_chars: int, limit: int, folder: str) -> DataFrame:
    """``word, n, base, path, key``: groups in which near words of ``base`` and one more code points meet."""
    length = F.char_length("word")
    bases = F.explode(F.array_compact(F.array(length, F.when(length > min_chars, length - 1))))
    rows = vocabulary.select("word", "n", bases.alias("base"))
    rows = _dealt(rows.select("*", F.lit("").alias("path"), F.lit(0).alias("head"), F.lit(0).alias("tail")))
    group, done, turn = ["base", "path", "key"], [], 0
    while True:
        rows = _keyed(rows)
        splits = (F.col("base") - F.col("head") - F.col("tail")) > 1
        large = rows.where(splits).groupBy(group).count().where(F.col("count") > limit).select(group)
        large = written(large, folder, f"large-{turn}")
        if large.isEmpty():
            done.append(rows.select("word", "n", *group))
            break
        done.append(rows.join(large, group, "left_anti").select("word", "n", *group))
        deeper = _dealt(rows.join(large, group, "left_semi"))
        rows, turn = written(deeper, folder, f"deeper-{turn}"), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def common_head(base: int, path: str) -> tuple[int, int]:
    """Pairs count in the group of this path if their common head is at least the first, under the second."""
    head = tail = least = 0
    most = 2**31
    for step in path:
        half = (base - head - tail) // 2
        if step == "h":
            head += half
            least = max(least, head)
        else:
            most = min(most, head + half)
            tail += half
    return least, most


def near_words(letters: np.ndarray, length: np.ndarray, group: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs: a word of ``base`` letters and a near one, as long or one longer, of its group.

    ``letters`` has a row per word, filled up with 0; ``group`` is sorted.
    """
    rows, size = len(letters), int(letters.max(initial=0)) + 1
    place = np.arange(rows)
    lanes, lane, bit = -(-rows // 64), place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)

    def members(chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(lanes, np.uint64)
        np.bitwise_or.at(out, lane[chosen], bit[chosen])
        return out

    def slice_of(position: int) -> np.ndarray:
        """Bitset of each lane and letter at a position; letter 0 has none."""
        out = np.zeros(lanes * size, np.uint64)
        if position < letters.shape[1]:
            np.bitwise_or.at(out, lane * size + letters[:, position], bit)
        out[::size] = 0
        return out

    new = np.r_[True, group[1:] != group[:-1]]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    last = np.r_[np.flatnonzero(new)[1:], rows][np.cumsum(new) - 1] - 1
    asking = np.flatnonzero((length == base) & (first < last))
    spread = lane[last[asking]] - lane[first[asking]] + 1
    query = np.repeat(asking, spread)
    where = lane[first[query]] + np.arange(len(query)) - np.repeat(np.cumsum(spread) - spread, spread)
    low = np.maximum(first[query] - 64 * where, 0).astype(np.uint64)
    high = np.minimum(last[query] - 64 * where, 63).astype(np.uint64)
    exact = (_ALL << low) & (_ALL >> (np.uint64(63) - high))
    replaced, longer = np.zeros_like(exact), np.zeros_like(exact)
    here = slice_of(0)
    for i in range(base):
        there = slice_of(i + 1)
        cell = where * size + letters[query, i]
        hit = here[cell]
        longer = (longer | exact) & there[cell]
        replaced = (replaced & hit) | (exact & ~hit)
        exact &= hit
        here = there
    found = (replaced & members(length == base)[where]) | ((longer | exact) & members(length == base + 1)[where])
    some = np.flatnonzero(found)
    bits = np.unpackbits(found[some, None].view(np.uint8), axis=1, bitorder="little")
    i, j = np.nonzero(bits)
    return query[some[i]], 64 * where[some[i]] + j


def _code_points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters as small numbers from 1, a row per word filled up with 0, and the lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    names, small = np.unique(points, return_inverse=True)
    out = np.zeros((len(words), width), np.int32)
    out[np.arange(width) < length[:, None]] = small + 1
    return out, length


def best_near(words: list[str], n: np.ndarray, group: np.ndarray, span: np.ndarray, base: int) -> tuple:
    """Word numbers with their count of near words and the number of the best.

    Words are in code-point order within a group; ``span`` has the common heads that count.
    """
    letters, length = _code_points(words, base + 1)
    one, other = near_words(letters, length, group, base)
    equal = letters[one, :base] == letters[other, :base]
    head = np.where(equal.all(axis=1), base, equal.argmin(axis=1))
    mine = (head >= span[one, 0]) & (head < span[one, 1])
    one, other = one[mine], other[mine]
    longer = length[other] > base  # asked in one direction only
    one, other = np.r_[one, other[longer]], np.r_[other, one[longer]]
    order = np.lexsort((other, -n[other], one))
    one, other = one[order], other[order]
    begin = np.flatnonzero(np.r_[True, one[1:] != one[:-1]][: len(one)])
    return one[begin], np.diff(np.r_[begin, len(one)]), other[begin]


def near_counts(groups: DataFrame) -> DataFrame:
    """``word, n_near, best`` (``minus, word``: minus its count) of the words with a near word."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            words, n = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
            base = rows[0][2]
            new = [i == 0 or rows[i][3:] != rows[i - 1][3:] for i in range(len(rows))]
            spans = {path: common_head(base, path) for path in {r[3] for r in rows}}
            span = np.array([spans[r[3]] for r in rows], np.int64)
            one, count, best = best_near(words, n, np.cumsum(new), span, base)
            return pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in one.tolist()], pa.string()), pa.array(count, pa.int64()),
                 pa.array(-n[best], pa.int64()), pa.array([words[i] for i in best.tolist()], pa.string())],
                ["word", "n_near", "minus", "best"],
            )

        held, places, group, now = [], 0, [], None

        def end_group() -> None:
            nonlocal places
            if len(group) > 1:  # a word alone is near nothing
                held.extend(group)
                places += len(group) * (len(group) // 64 + 2)
            group.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2:] != now:
                    end_group()
                    if held and (held[0][2] != row[2] or places > PLACES or len(held) * row[2] > LETTERS):
                        yield found(held)
                        held, places = [], 0
                    now = row[2:]
                group.append(row)
        end_group()
        if held:
            yield found(held)

    order = ["base", "path", "key"]
    met = groups.select("word", "n", *order).repartition(*order).sortWithinPartitions(*order, "word")
    near = met.mapInArrow(find, "word string, n_near bigint, minus bigint, best string")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "best")).alias("best"))


def roots(links: DataFrame, folder: str) -> DataFrame:
    """``word, root``: where ``word, form`` links lead; every step doubles the way."""
    links, turn = written(links.select("word", F.col("form").alias("root")), folder, "roots-0"), 0
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(further, "root", "left")
        turn += 1
        longer = longer.select("word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved"))
        longer = written(longer, folder, f"roots-{turn}")
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return links


def spelling_variants(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = LIMIT,
    change: Callable[[object], Callable[[bytes], bytes] | None] | None = None,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with ``min_count`` occurrences.

    ``change(id)`` may give a function by which the words (Latin-1 bytes) of a
    document are shortened before they are counted.
    """
    folder = shared_folder(docs.sparkSession)
    counted = word_counts(docs, min_chars, id_column, text_column, change)
    vocabulary = written(counted.where(F.col("n") >= min_count), folder, "words")
    near = near_counts(word_groups(vocabulary, min_chars, limit, folder))
    strong = -F.col("best.minus") >= ratio * F.col("n")
    formed = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, F.col("best.best")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"),
    )
    formed = written(formed, folder, "formed")
    leads = roots(formed.where("form IS NOT NULL"), folder)
    return formed.join(leads, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spoilt(doc_id) -> Callable[[bytes], bytes] | None:
    """The contract's misspellings: one in 31 words of a document loses a letter."""
    if doc_id is None:
        return None
    seed = zlib.crc32(f"{doc_id}:".encode())

    def change(word: bytes) -> bytes:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
        if h % 31:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return change


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), change=spoilt)


OP11_SQL = (
    r"""
with recursive """ + CRC_TABLE + r""", d as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), r as (
  select doc_id, run, count(*) as n, string_split(coalesce(doc_id::varchar || ':', '') || run, '') as letters
  from d where length(run) >= 7 group by doc_id, run
), h as (
  select doc_id, run, n, """ + crc32("""flatten([case when unicode(x) < 128 then [unicode(x)::bigint]
        else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end for x in letters])""") + r""" as h
  from r, crc_table
), v as (
  select word, sum(n)::bigint as n from (
    select n, case when h % 31 = 0 and doc_id is not null
      then substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) else run end as word
    from h
  ) where length(word) >= 7 group by word having sum(n) >= 2
), cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from v)
), near as (
  select a.word, a.n, b.word as other, b.n as m from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word != b.word
  union
  select v.word, v.n, cut.word, cut.n from v join cut on v.word = cut.rest
  union
  select cut.word, cut.n, v.word, v.n from v join cut on v.word = cut.rest
), best as (
  select word, count(*) as n_near, max(m) as m,
    min(other order by other) filter (where m = top) as other
  from (select *, max(m) over (partition by word) as top from near) group by word
), f as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 10 * v.n then other end as form,
    case when m >= 10 * v.n then m end as form_n
  from v left join best using (word)
), way as (
  select word, form as last, 1 as k from f where form is not null
  union all
  select way.word, f.form, k + 1 from way join f on way.last = f.word where f.form is not null
)
select f.word, form, coalesce(arg_max(way.last, k), f.word) as root, n, n_near, form_n
from f left join way using (word) group by f.word, form, n, n_near, form_n
"""
)
