"""Near-duplicates by SetSketch registers: banded, estimated by likelihood, verified.

Two texts are near-duplicates if their sets of shingles share ``share`` percent
of their union. Texts of one set are one point.

* Registers. Hash function ``i`` gives every shingle an exponential variate; the
  register is the smallest of them, truncated to powers of ``BASE``: the larger
  the set, the larger the register. Registers of parts merge by maximum.
* Bands. Points meet where all ``ROWS`` registers of one of ``BANDS`` bands are
  equal. A register of two sets of similarity s is equal with probability s or
  a little more, so a pair meets with ``1 - (1 - s**4)**20`` or more:
  0.9999996 at 0.85.
* Likelihood. The numbers of registers that are larger, smaller and equal have
  known probabilities for every similarity, given the sizes of the sets; a pair
  is left out where its likeliest similarity explains them ``e**DOUBT`` times
  better than any from ``share`` on, or where the sizes alone rule it out.
* Links. Pairs that remain are verified by the exact overlap of their sets,
  made anew from the texts of the points concerned and of no others. First each
  point of a meeting faces one hub (meetings are dealt into bounded ones, each
  with a hub of its own) and its likeliest hub is verified; closing these links
  leaves few meetings with points of several groups. There the registers of all
  points of different groups are compared in bounded tiles, and points with a
  likely partner are compared by their sets. Pairs leave a task only where they
  join groups, and copies are never expanded.

Texts without words have empty sets and are linked with nothing; texts of fewer
words than a shingle have the whole sequence as one. Null ids are named by no
group unless all its ids are null. Repeated rows are one point. Very long texts
are hashed in steps. Only the id and the text are read, other columns have no
effect. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siftwell.llm.shared import bounded_batches, shared_folder, table, written
from siftwell.llm.simhash import closed, shingle_hashes

BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Truncation: registers are from 0 to LAST, powers of BASE from the rate RATE on.
BASE, RATE, LAST = 1.02, 20.0, 2047
#: A difference of log-likelihoods that is no doubt any more (the chance is under 1e-6).
DOUBT = 12.0
WORDS, SHARE = 5, 80
#: Points that share a hub; points and shingles of a tile.
HUB, TILE, SET_TILE = 64, 2048, 1 << 20
_CHUNK = 4096
_FACTORS = np.random.default_rng(12).integers(0, 2**63, (REGISTERS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def _limits() -> np.ndarray:
    """Uniform 64-bit values up to which a register is at least LAST, LAST - 1, ..., 1."""
    share = -np.expm1(-RATE * BASE ** (1.0 - np.arange(LAST, 0, -1)))
    return np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


_LIMITS = _limits()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set (or list) of shingle hashes; all 0 of an empty one."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        x = hashes[k : k + _CHUNK] * _FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=1))
    return (LAST - np.searchsorted(_LIMITS, least)).astype(np.uint16)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, other)


def _apart(x: np.ndarray) -> np.ndarray:
    """Chance that a register is larger by the share ``x`` of the union that only its set has."""
    return -np.log1p(-np.clip(x, 0, 1) * ((BASE - 1) / BASE)) / np.log(BASE)


def log_likelihood(more: np.ndarray, less: np.ndarray, one: np.ndarray, other: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Of similarity ``s``, given how many registers are larger and smaller and the sizes of the sets."""
    u = one / (one + other)
    first, second = _apart(u - (1 - u) * s), _apart(1 - u - u * s)
    equal = REGISTERS - more - less
    terms = ((more, first), (less, second), (equal, 1 - first - second))
    return sum(k * np.log(np.maximum(p, 1e-12)) for k, p in terms)


def likely(more: np.ndarray, less: np.ndarray, one: np.ndarray, other: np.ndarray, share: int) -> np.ndarray:
    """Pairs that may share ``share`` percent, by the sizes of the sets and the joint likelihood."""
    small, large = np.minimum(one, other), np.maximum(one, other)
    most = small / large  # of two sets of these sizes
    steps = np.arange(33)[:, None] / 32
    below = log_likelihood(more, less, one, other, steps * np.minimum(most, share / 100)).max(axis=0)
    least = np.minimum(share / 100, most)
    enough = log_likelihood(more, less, one, other, least + steps * (most - least)).max(axis=0)
    return (100 * small >= share * large) & (below - enough <= DOUBT)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, words)]))


def digest(hashes: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.tobytes())


def with_sketches(rows: DataFrame, words: int) -> DataFrame:
    """``id, digest, n, registers`` of ``id, text``."""
    bounded_batches(rows.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), words)
                out.append((digest(hashes), len(hashes), sketch(hashes).tobytes()))
            names, counts, registers = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(registers, pa.binary())],
                ["id", "digest", "n", "registers"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(compute, f"id {kind}, digest string, n bigint, registers binary")


def sets_of(rows: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """``point, set`` of the points ``needed`` (``point, digest, id, copies``), made from their texts."""
    ids = needed.select(F.col("id").alias("_id")).distinct()
    texts = rows.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {}
            for text in batch.column(0):
                hashes = shingle_set(text.as_py(), words)
                sets[digest(hashes)] = hashes.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sets), pa.string()), pa.array(list(sets.values()), pa.list_(pa.int64()))],
                ["digest", "set"],
            )

    made = texts.mapInArrow(compute, "digest string, set array<bigint>")
    found = made.join(needed.select("point", "digest", "copies"), "digest")
    once = found.select("point", "set")
    # Rows of one id and text would give their set more than once.
    return once if needed.where("copies > 1").isEmpty() else once.dropDuplicates(["point"])


def _share(tiles):
    return F.pmod(F.xxhash64("point", "t"), tiles).cast("int")


def hub_pairs(keyed: DataFrame) -> DataFrame:
    """``u > v``: each point of a meeting with the hub of its share of the meeting."""
    sizes = keyed.groupBy("t", "key").count().where(F.col("count") > 1)
    tiles = F.ceil(F.col("count") / HUB).cast("int")
    dealt = keyed.join(sizes.select("t", "key", tiles.alias("tiles")), ["t", "key"])
    shares = dealt.groupBy("t", "key", _share(F.col("tiles")).alias("own")).agg(
        F.collect_list("point").alias("points"), F.min("point").alias("v")
    )
    return shares.select(F.explode("points").alias("u"), "v").where("u > v").distinct()


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def best_hubs(pairs: DataFrame, points: DataFrame, share: int) -> DataFrame:
    """Of the pairs of each ``u`` the one with the most equal registers, if it is a likely one."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _registers(batch.column(2)), _registers(batch.column(3))
            one, other = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
            keep = pa.array(likely(more, less, one, other, share))
            equal = pa.array(REGISTERS - more - less, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), equal.filter(keep)], ["u", "v", "equal"]
            )

    def side(name: str) -> DataFrame:
        own = {"point": name, "registers": f"{name}_registers", "n": f"{name}_n"}
        return points.select(*(F.col(a).alias(b) for a, b in own.items()))

    both = pairs.join(side("u"), "u").join(side("v"), "v")
    # Sizes alone rule out pairs before their registers are compared.
    fits = 100 * F.least("u_n", "v_n") >= share * F.greatest("u_n", "v_n")
    both = both.where(fits).select("u", "v", "u_registers", "v_registers", "u_n", "v_n")
    weighed = both.mapInArrow(weigh, "u bigint, v bigint, equal bigint")
    return weighed.groupBy("u").agg(F.max_by("v", F.struct("equal", "v")).alias("v"))


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs whose sets are similar."""
    one = sets.select(F.col("point").alias("u"), F.col("set").alias("a"))
    other = sets.select(F.col("point").alias("v"), F.col("set").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    alike = 100 * common >= share * (F.size("a") + F.size("b") - common)
    return pairs.join(one, "u").join(other, "v").where(alike).select("u", "v")


def partners(registers: np.ndarray, n: np.ndarray, group: np.ndarray, share: int) -> np.ndarray:
    """Rows that have a likely partner in another group."""
    order = np.argsort(n, kind="stable")
    registers, n, group = registers[order], n[order], group[order]
    some = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, 100 * n[i] // share, "right"))  # beyond, sets are too large
        j = np.flatnonzero(group[i + 1 : stop] != group[i]) + i + 1
        if not len(j):
            continue
        mine, theirs = registers[i], registers[j]
        more, less = (mine > theirs).sum(axis=1), (mine < theirs).sum(axis=1)
        near = j[likely(more, less, np.full(len(j), n[i]), n[j], share)]
        some[near] = True
        some[i] |= len(near) > 0
    out = np.zeros(len(n), bool)
    out[order] = some
    return out


def links(sets: list[np.ndarray], group: np.ndarray, share: int) -> tuple[list[int], list[int]]:
    """Row numbers of similar sets of different groups, enough to join all groups that have any."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, group = size[order], group[order].copy()
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    ends = np.cumsum(size)
    marked = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    left, right = [], []
    for i in range(len(size) - 1):
        stop = int(np.searchsorted(size, 100 * size[i] // share, "right"))
        open_ = np.flatnonzero(group[i + 1 : stop] != group[i]) + i + 1
        if not len(open_):
            continue
        first, last = int(open_[0]), int(open_[-1])
        mine = ids[ends[i] - size[i] : ends[i]]
        marked[mine] = 1
        starts = ends[first : last + 1] - size[first : last + 1]
        base = int(starts[0])
        common = np.add.reduceat(marked[ids[base : int(ends[last])]], starts - base)[open_ - first]
        marked[mine] = 0
        for j in open_[100 * common >= share * (size[i] + size[open_] - common)].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                left.append(int(order[i]))
                right.append(int(order[j]))
    return left, right


def _tiled(keyed: DataFrame, tiles: DataFrame) -> DataFrame:
    """Points of meetings in pairs of tiles ``a <= b``."""
    dealt = keyed.join(tiles, ["t", "key"]).withColumn("own", _share(F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pair = F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
    return dealt.select("*", other).select("t", "key", *pair, "point", "group", "n")


def _by_meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns after the first four of each stretch of rows that agree in those, across batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:4]], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if (key := tuple(keys[a].tolist())) != now and held:
                yield [pa.concat_arrays(c) for c in zip(*held)]
                held = []
            now = key
            held.append([c.slice(a, b - a) for c in batch.columns[4:]])
    if held:
        yield [pa.concat_arrays(c) for c in zip(*held)]


def links_between_groups(
    keyed: DataFrame, members: DataFrame, points: DataFrame, rows: DataFrame, words: int, share: int, folder: str
) -> DataFrame:
    """Links between points of different groups that meet, enough to join the groups."""
    group = F.coalesce("v", "point").alias("group")
    keyed = keyed.join(members, keyed.point == members.u, "left").select("t", "key", "point", "n", group)
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("m"), F.min("group").alias("a"), F.max("group").alias("b"))
    open_ = sizes.where("a != b").select("t", "key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    place = ["t", "key", "a", "b"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for point, group, n, registers in _by_meeting(batches):
            some = partners(_registers(registers), n.to_numpy(), group.to_numpy(), share)
            if some.any():
                yield pa.RecordBatch.from_arrays([point.filter(pa.array(some))], ["point"])

    met = _tiled(keyed, open_).join(points.select("point", "registers"), "point")
    met = met.select(*place, "point", "group", "n", "registers").repartition(*place).sortWithinPartitions(*place)
    chosen = written(met.mapInArrow(choose, "point bigint").distinct(), folder, "chosen")

    few = keyed.join(chosen, "point", "left_semi")
    weight = F.ceil(F.sum(F.col("n") + 64) / SET_TILE).cast("int").alias("tiles")
    sizes = few.groupBy("t", "key").agg(weight, F.min("group").alias("a"), F.max("group").alias("b"))
    met = _tiled(few, sizes.where("a != b").select("t", "key", "tiles"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for point, group, values in _by_meeting(batches):
            sets = np.split(values.flatten().to_numpy(), np.cumsum(values.value_lengths().to_numpy())[:-1])
            i, j = links(sets, group.to_numpy(), share)
            names = point.to_numpy()
            u, v = names[np.array(i, np.int64)], names[np.array(j, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    needed = points.join(chosen, "point", "left_semi").select("point", "digest", F.col("least").alias("id"), "copies")
    met = met.join(sets_of(rows, needed, words), "point").select(*place, "point", "group", "set")
    return met.repartition(*place).sortWithinPartitions(*place).mapInArrow(link, "u bigint, v bigint").distinct()


def sketched_groups(
    docs: DataFrame, words: int = WORDS, share: int = SHARE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row: the smallest id of its group, and whether it is its own."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    prints = written(with_sketches(rows, words), folder, "prints")
    full = prints.where("n > 0")
    # The rows of one set: its smallest id, and how many have that id.
    alike = full.groupBy("digest", "id").agg(
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers")
    )
    lowest = F.struct(F.col("id").isNull().alias("none"), "id", "copies")
    points = alike.groupBy("digest").agg(
        F.min(lowest).alias("low"), F.first("n").alias("n"), F.first("registers").alias("registers")
    )
    points = points.select("digest", F.col("low.id").alias("least"), "low.copies", "n", "registers")
    points = written(points.withColumn("point", F.monotonically_increasing_id()), folder, "points")
    band = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.expr(f"substring(registers, {2 * ROWS * t + 1}, {2 * ROWS})")).alias("key")) for t in range(BANDS)]
    keyed = points.select("point", "n", F.explode(F.array(*band)).alias("band")).select("point", "n", "band.t", "band.key")

    pairs = written(best_hubs(hub_pairs(keyed), points, share), folder, "pairs")
    ends = pairs.select(F.col("u").alias("point")).union(pairs.select("v")).distinct()
    needed = points.join(ends, "point", "left_semi").select("point", "digest", F.col("least").alias("id"), "copies")
    members = closed(verified(pairs, sets_of(rows, needed, words), share), f"{folder}/hubs")
    between = links_between_groups(keyed, members, points, rows, words, share, folder)
    members = closed(between.union(members.select("u", "v")), f"{folder}/all")

    named = points.join(members, points.point == members.u, "left")
    named = written(named.select("digest", "least", F.coalesce("v", "point").alias("group")), folder, "named")
    names = named.groupBy("group").agg(F.min("least").alias("component_id"))
    component = named.join(names, "group").select("digest", "component_id")
    out = full.select("id", "digest", "n").join(component, "digest").select("id", "n", "component_id")
    out = out.union(prints.where("n = 0").select("id", "n", "id"))
    return out.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op12_setsketch_near_dedup(spark, sf_dir: str) -> DataFrame:
    return sketched_groups(table(spark, sf_dir, "documents"), share=85)


OP12_SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select r, doc_id, list_sort(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] end)) as s
  from d where len(w) > 0
), p as (
  select s, len(s) as n, min(doc_id) as low, row_number() over () as id from s group by s
), e as (
  select id, n, unnest(s) as x from p
), k as (
  select e.*, c, row_number() over (partition by id order by c, x) as place
  from e join (select x, count(*) as c from e group by x) using (x)
), pairs as (  -- similar sets share one of their rarest shingles
  select distinct a.id as a, b.id as b, a.n as m, b.n as n from k a join k b on a.x = b.x and a.id < b.id
  where a.place <= a.n - (85 * a.n + 99) // 100 + 1 and b.place <= b.n - (85 * b.n + 99) // 100 + 1
    and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), linked as (
  select a, b from pairs join e x on x.id = a join e y on y.id = b and x.x = y.x
  group by a, b, m, pairs.n having 100 * count(*) >= 85 * (m + pairs.n - count(*))
), ways as (
  select a, b from linked union select b, a from linked
), reach as (
  select id as a, id as b from p union select reach.a, ways.b from reach join ways on reach.b = ways.a
), named as (
  select a as id, min(low) as component_id from reach join p on p.id = reach.b group by a
)
select doc_id, coalesce(p.n, 0)::bigint as n_shingles,
  case when s.r is null then doc_id else component_id end as component_id,
  s.r is null or doc_id is not distinct from component_id as kept
from d left join s using (r, doc_id) left join p using (s) left join named using (id)
"""
