"""Mixing sources to target weights by weighted fair queueing.

Every source gets a share of all words in proportion to its weight, at most
``max_epochs`` times its own words; what it cannot use is shared again. Its
documents stand in a shuffled order (a hash of their id, then id) and are
offered up to ``max_epochs`` times; an offer's virtual finish time is the
source's words up to and including it, divided by the source's target. The
offers of all sources, sorted by finish time, are taken until the budget (all
words) is reached.

Running sums over a large source or over all offers would put it into one
task. Both are made in two steps instead: sums per (source, hash range) and per
range of finish time, running totals over these sums, and the running sum
inside a range. The ranges follow the number of documents, so a task stays
about ``RANGE`` rows. Only the sums pass through one task: one row per source,
and one per range of finish time.

Null text has size 0; documents of size 0 take 0 words. The null source is a
source of its own and the last. Rows equal in id, source and size are alike and
their offers count one by one. A corpus without words takes nothing; an empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwell.llm.shared import shared_folder, table, text_or_empty, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def _shuffled(column: str) -> Column:
    """A fixed shuffle: the first 60 bits of md5."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(column).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def allotted(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``source, source_size, target``: water filling over the sources.

    A source is full if even the final level (words per weight) gives it more
    than its cap. Ordered by cap per weight the full ones come first, so one
    pass of running sums finds the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.array(*map(F.lit, weights))[((F.row_number().over(by_name) - 1) % len(weights))]
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(all_rows),
            "heavy": F.sum("weight").over(all_rows)
            - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "used": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        }
    )
    level = (F.col("total") - F.col("used")) / F.col("heavy")
    s = s.withColumn("full", F.col("cap") <= F.col("weight") * level)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_open = F.first(F.when(~F.col("full"), level), ignorenulls=True)
    s = s.withColumn("level", first_open.over(everything))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("level")
    )
    return s.select("source", "source_size", "weight", target.alias("target"))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column) -> DataFrame:
    """Adds ``running``: the sum of ``value`` up to the row, within ``keys``, bucket by bucket."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = bases.select(*(F.col(c).alias(f"_b_{c}") for c in (*keys, bucket)), "_base")
    same = F.lit(True)
    for c in (*keys, bucket):
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    joined = df.withColumn("_in", F.sum(value).over(inside)).join(b, same)
    return joined.withColumn("running", F.col("_in") + F.col("_base")).select(*df.columns, "running")


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """``id, source, size`` of every row."""
    words = F.regexp_count(text_or_empty(text_column), F.lit(WORD)).cast("bigint")
    return docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words.alias("size"))


def shares(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``id, source, size, rows, source_size, target, n``: how often rows alike in all three are taken."""
    folder = shared_folder(rows.sparkSession)
    # Rows alike in all three are one row with a count: ties cannot differ between runs.
    alike = rows.groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    alike = written(alike.withColumn("place", _shuffled("id")), folder, "alike")
    words = F.col("size") * F.col("rows")
    ranges = max(1, -(-alike.count() // RANGE))
    sources = alike.groupBy("source").agg(F.sum(words).alias("source_size"))
    targets = written(allotted(sources, weights, max_epochs), folder, "targets")
    dealt = alike.withColumn("bucket", F.floor(F.col("place") / F.lit(-(-(2**60) // ranges))))
    placed = running_total(dealt, ["source"], "bucket", [F.col("place"), F.col("id"), F.col("size")], words)
    t = targets.withColumnRenamed("source", "_source")
    queued = placed.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = written(queued, folder, "queued")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]

    offer = queued.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    finish = (F.col("epoch") * F.col("source_size") + F.col("running")) / F.col("target")
    offers = offer.select("id", "source", "size", "rows", "epoch", finish.alias("finish"))
    # The budget is reached near time 1. Only sums by range of finish time are ordered (one row
    # for thousands of offers); the range that crosses the budget is then known to the plan.
    slices = ranges * max_epochs
    slot = F.least(F.floor(F.col("finish") * slices), F.lit(2 * slices)).cast("bigint")
    offers = offers.withColumn("slot", slot)
    sums = offers.groupBy("slot").agg(F.sum(words).alias("words"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("slot", "words", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    edge = sums.where(F.col("base") + F.col("words") > budget).orderBy("slot").first()
    # Ranges before it are taken whole, those after it not at all: neither is sorted or moved.
    whole = offers.where(F.col("slot") < edge["slot"] if edge else F.lit(True)).withColumn("n", F.col("rows"))
    order = Window.partitionBy("slot").orderBy("finish", F.col("source").isNull(), "source", "id", "size", "epoch")
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.lit(budget - edge["base"] if edge else 0) - (F.sum(words).over(order) - words)
    crossing = offers.where(F.col("slot") == edge["slot"] if edge else F.lit(False)).withColumn(
        "n", F.greatest(F.lit(0), F.least(F.col("rows"), F.floor(room / F.col("size"))))
    )
    copies = whole.unionByName(crossing).groupBy("id", "source", "size").agg(F.sum("n").alias("n"))
    c = copies.select(
        F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), "n"
    )
    mine = F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    return queued.join(c, mine, "left").select(
        "id", "source", "size", "rows", "source_size", "target", F.coalesce("n", F.lit(0)).alias("n")
    )


def dealt_copies(row: Column) -> Column:
    """Copies of the row-th of ``rows`` alike rows that are taken ``n`` times: as even as possible."""
    more = (row <= F.col("n") % F.col("rows")).cast("int")
    return (F.floor(F.col("n") / F.col("rows")) + more).cast("bigint")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """``id, source, size, source_size, target, copies, taken`` of every document."""
    mixed = shares(sized(docs, id_column, text_column, source_column), weights, max_epochs)
    each = mixed.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    copies = dealt_copies(F.col("row"))
    return each.select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def taken_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The documents as rows, each as often as the mix takes it (not at all for 0)."""
    rows = sized(docs, id_column, text_column, source_column)
    key = F.to_json(F.struct("id", "source", "size"), {"ignoreNullFields": "false"})
    mixed = shares(rows, weights, max_epochs).where("n > 0").select(key.alias("_k"), "rows", "n")
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    words = F.regexp_count(text_or_empty(text_column), F.lit(WORD)).cast("bigint")
    own = F.struct(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words.alias("size"))
    marked = docs.select(*columns, F.to_json(own, {"ignoreNullFields": "false"}).alias("_k"))
    turn = Window.partitionBy("_k").orderBy("_k")
    dealt = marked.join(mixed, "_k").withColumn("_row", F.row_number().over(turn))
    times = F.explode(F.array_repeat(F.lit(1), dealt_copies(F.col("_row")).cast("int")))
    return dealt.withColumn("_time", times).select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns))
    )


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP6_SQL = r"""
with d as (
  select doc_id as id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents
), z as (
  select id, source, size, count(*) as n,
    ('0x' || substr(md5('mix:' || coalesce(id::varchar, '')), 1, 15))::bigint as place
  from d group by id, source, size
), s0 as (
  select source, sum(size * n)::bigint as source_size from z group by source
), s1 as (
  select *, 3 * source_size as cap,
    [5, 2, 1][1 + (row_number() over (order by source is null, source) - 1) % 3] as weight
  from s0
), s2 as (
  select *, (sum(source_size) over ()
      - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over ()
      - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0))::double as level
  from s1 window o as (order by cap::double / weight, source is null, source)
), s3 as (
  select source, source_size, case when cap <= weight * level then cap::double
    else weight * (select level from s2 where cap > weight * level
      order by cap::double / weight, source is null, source limit 1) end as target
  from s2
), q as (
  select z.*, source_size, target,
    sum(size * n) over (partition by z.source order by place, id, size rows unbounded preceding) as running
  from z join s3 on z.source is not distinct from s3.source
), o as (
  select *, (epoch * source_size + running)::double / target as finish
  from q, (values (0), (1), (2)) as e(epoch) where size > 0
), c as (
  select *, sum(size * n) over (order by finish, source is null, source, id, size, epoch
      rows unbounded preceding) - size * n as served, (select sum(source_size) from s0) as budget
  from o
), t as (
  select id, source, size, sum(greatest(0, least(n, floor((budget - served)::double / size)))) as copies
  from c group by id, source, size
)
select q.id as doc_id, q.size, q.source_size, q.target,
  (q.size * (coalesce(copies, 0) // n + case when i <= coalesce(copies, 0) % n then 1 else 0 end))::bigint as taken
from q left join t on q.id is not distinct from t.id and q.source is not distinct from t.source
  and q.size = t.size, unnest(range(1, n + 1)) as r(i)
"""
