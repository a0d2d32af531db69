"""Points on disk: one Parquet folder per ingested batch, newest batch wins.

Layout: ``<path>/batch_seq=<n>/writer=<w>/tenant_id=<t>/*.parquet``. Batch 0 is
the base; later batches are upserts, and every writer (batch jobs, each stream)
has folders of its own, so that none overwrites another's. A version is (batch,
writer); every version holds an id once. A tenant condition prunes folders, and
files sorted by time let ranges on ``created_at`` skip row groups.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftwell.schema import DOCUMENT

POINT = T.StructType(
    [
        *DOCUMENT.fields,
        T.StructField("dense", T.ArrayType(T.DoubleType())),
        T.StructField(
            "sparse",
            T.StructType(
                [
                    T.StructField("indices", T.ArrayType(T.LongType())),
                    T.StructField("values", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
        T.StructField("batch_seq", T.LongType()),
        T.StructField("writer", T.StringType()),
    ]
)

VERSION = ("batch_seq", "writer")
#: Writers of the base and of batch jobs.
BASE, BATCH = "base", "batch"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    The caller knows its path and removes it with the job's other checkpoints.
    Where the setting is missing, local mode sets one for the whole session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/siftwell-{os.urandom(8).hex()}"


#: Whether the shuffles of a job go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What the jobs inside shuffle is removed from the disks as they end; a later reader shuffles it again."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def stored(df: DataFrame) -> DataFrame:
    """Write a result that several steps read, and read it back.

    The table lies in shared storage, so a lost executor costs nothing, and what
    was shuffled for it is removed at once.
    """
    path = f"{shared_dir(df.sparkSession)}/table"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again, what is made from them being stored."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(name) for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def latest_by_id(df: DataFrame, *order: str) -> DataFrame:
    """The last version of each id; partial maxima keep a hot id cheap."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy("id").agg(row.alias("_row")).select("_row.*")


def last_documents(documents: DataFrame, *order: str) -> DataFrame:
    """The last row of each id, like ``latest_by_id``, for tables of wide rows.

    Ids that occur once are told by their numbers alone: their rows, all but a
    few, are neither grouped nor, while the repeated ids are few, shuffled.
    """
    again = documents.groupBy(F.col("id").alias("_id")).count().where("count > 1").select("_id")
    same = F.col("id").eqNullSafe(F.col("_id"))
    repeated = latest_by_id(documents.join(again, same, "left_semi"), *order)
    return documents.join(again, same, "left_anti").unionByName(repeated)


def _layout(points: DataFrame) -> DataFrame:
    """Files by tenant: AQE splits a large tenant and packs small ones."""
    return points.hint("rebalance", "tenant_id").sortWithinPartitions("tenant_id", "created_at")


def recreate_collection(
    points: DataFrame, path: str, layout: Callable[[DataFrame], DataFrame] = _layout, **options
) -> None:
    """Create or replace the collection; each id must occur once (``last_documents``).

    ``layout`` orders the rows of the files: by time, or ``layout.z_ordered`` for
    conditions on category and time. ``options`` go to the Parquet writer.
    """
    base = points.withColumns({"batch_seq": F.lit(0).cast("bigint"), "writer": F.lit(BASE)})
    with shuffles_removed(base.sparkSession):
        layout(base).write.options(**options).mode("overwrite").partitionBy(*VERSION, "tenant_id").parquet(path)


def upsert_points(points: DataFrame, path: str, batch_seq: int, writer: str = BATCH) -> None:
    """Write one batch of upserts; writing the same batch again changes nothing.

    Each id must occur once (``last_documents``). ``next_batch_seq`` gives a
    number after all others; the batch of another writer is never touched.
    """
    if batch_seq < 1:
        raise ValueError("batch_seq of an upsert starts at 1")
    target = f"{path}/batch_seq={batch_seq}/writer={writer}"
    with shuffles_removed(points.sparkSession):
        _layout(points).write.mode("overwrite").partitionBy("tenant_id").parquet(target)


def next_batch_seq(spark: SparkSession, path: str) -> int:
    """One more than the largest batch number of the collection, 1 at least.

    Lists the folder, reads no file.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
    taken = [int(n.removeprefix("batch_seq=")) for n in names if n.startswith("batch_seq=")]
    return max(taken, default=0) + 1


def attach_vectors(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Points from documents and separately computed vectors, matched by id.

    A document without a vector stays, with null vectors; it takes no part in
    the searches that need them. Several vectors of an id give as many points.
    """
    return documents.join(vectors, "id", "left")


def ingest_documents(
    documents: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    path: str,
    batch_seq: int = 0,
    order: tuple[str, ...] = ("created_at", "text"),
) -> DataFrame:
    """Embed and write documents; returns one row points, seconds, throughput.

    Of several documents with one id the last by ``order`` is written.

    Batch 0 creates the collection, later numbers are upserts. Partitions take
    the place of client batches and threads.
    """
    spark = documents.sparkSession
    start = time.perf_counter()
    documents = last_documents(documents, *order)
    if batch_seq == 0:
        recreate_collection(embed(documents), path)
    else:
        upsert_points(embed(documents), path, batch_seq)
    seconds = time.perf_counter() - start
    writer = BATCH if batch_seq else BASE
    written = spark.read.schema(POINT).parquet(path)
    written = written.where((F.col("batch_seq") == batch_seq) & (F.col("writer") == writer))
    return written.agg(F.count(F.lit(1)).alias("points")).select(
        "points", F.lit(seconds).alias("seconds"), (F.col("points") / seconds).alias("throughput")
    )


def newest_points(versions: DataFrame) -> DataFrame:
    """Current row per id: upserts first, then the base rows they do not replace.

    Versions are resolved on ids and version numbers alone; whole rows are read
    by a semi-join afterwards, so a condition on the result reaches their scan
    (not that of the version numbers, or an old row of another tenant would come
    back). The base is joined without a shuffle while the upserted ids are few.
    """
    upserts = versions.where(F.col("batch_seq") > 0)
    newest = F.max(F.struct(*VERSION)).alias("_v")
    winners = upserts.groupBy(F.col("id").alias("_id")).agg(newest)
    same = F.col("id").eqNullSafe(F.col("_id"))
    version = same & (F.struct(*VERSION) == F.col("_v"))
    base = versions.where(F.col("batch_seq") == 0)
    kept = base.join(winners.select("_id"), same, "left_anti")
    return kept.unionByName(upserts.join(winners, version, "left_semi"))


def read_collection(spark: SparkSession, path: str, schema: T.StructType = POINT) -> DataFrame:
    return newest_points(spark.read.schema(schema).parquet(path)).drop(*VERSION)


def compact_collection(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the current rows as the base of a new collection."""
    if os.path.normpath(path) == os.path.normpath(new_path):
        raise ValueError("compact into a new path")
    recreate_collection(read_collection(spark, path), new_path)
