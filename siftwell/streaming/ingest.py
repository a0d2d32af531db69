"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftwell.operators.metrics import LATENCY_BOUNDS
from siftwell.sources.collection import last_documents, next_batch_seq, upsert_points


def read_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files_per_batch: int = 64,
    name_pattern: str = "*.parquet",
) -> DataFrame:
    """Parquet files of a folder as a stream, ``files_per_batch`` per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", name_pattern)
        .parquet(folder)
    )


def append_files(stream: DataFrame, out: str, checkpoint: str, partition_by=()) -> None:
    """Drain the stream into a Parquet file sink.

    The sink's log together with the checkpoint makes each input file count
    exactly once, also when the job is restarted after a failure.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.option("path", out).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()


class _Notes:
    """Short texts in files beside a checkpoint; a note is written whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        place = self._path("")
        self.store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.store.mkdirs(place)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def kept(self, name: str, make: Callable[[], str]) -> str:
        """The note of this name; ``make`` gives its text the first time."""
        path = self._path(name)
        if not self.store.exists(path):
            draft = self._path(f"_{name}-{os.urandom(8).hex()}")
            out = self.store.create(draft)
            out.writeBytes(make())
            out.close()
            self.store.rename(draft, path)
        file = self.store.open(path)
        text = self.jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        file.close()
        return text


def ingest_stream(
    documents: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    order: tuple[str, ...] = ("created_at", "text"),
) -> None:
    """Embed arriving documents and upsert them into a collection.

    A micro-batch becomes the newest version of its ids: it takes a number after
    all that the collection holds when it first runs. The number is noted beside
    the checkpoint, so a batch that is run again overwrites its own folder; the
    stream's folders carry its own name, so nobody else's are overwritten. Within
    a batch the last document of an id by ``order`` counts.
    """
    spark = documents.sparkSession
    notes = _Notes(spark, f"{checkpoint}/versions")
    writer = notes.kept("writer", lambda: f"stream-{os.urandom(8).hex()}")

    def upsert(batch: DataFrame, number: int) -> None:
        seq = int(notes.kept(str(number), lambda: str(next_batch_seq(spark, path))))
        upsert_points(embed(last_documents(batch, *order)), path, seq, writer)

    query = (
        documents.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    """Rows per key so far; state is one counter per key."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def latency_bucket(seconds: Column) -> Column:
    """Smallest histogram bound that holds the value, ``+Inf`` beyond the last."""
    chain = None
    for bound in LATENCY_BOUNDS:
        hit = seconds <= bound
        label = F.lit(str(bound))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.lit("+Inf"))


def running_latency_buckets(stream: DataFrame) -> DataFrame:
    """Counts per mode and histogram bucket so far (buckets not yet cumulated)."""
    bucket = latency_bucket(F.col("latency_ms") / 1000.0)
    return stream.groupBy("mode", bucket.alias("le")).agg(F.count(F.lit(1)).alias("n"))


def drain_counts(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a complete-mode aggregate to the end of its input; returns the last result.

    Each micro-batch writes a table of its own below ``path`` and only then
    removes the one before the last, so the result has no bound on the driver
    and whoever reads between batches finds a whole table.
    """
    spark = counts.sparkSession
    last = []

    def replace(result: DataFrame, number: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(number)
        for old in last[:-2]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        del last[:-2]

    query = (
        counts.writeStream.foreachBatch(replace)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return newest_counts(spark, path, counts.schema)


def newest_counts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The last whole result below ``path``; none yet gives an empty table."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = []
    for status in store.listStatus(folder) if store.exists(folder) else ():
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if status.getPath().getName().startswith("batch=") and store.exists(marker):
            done.append(int(status.getPath().getName().removeprefix("batch=")))
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={max(done)}")
