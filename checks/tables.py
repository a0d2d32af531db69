"""The driver's tables in the library's layouts. All rows, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwell.sources.labeled import created_at


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_documents(rows: DataFrame) -> DataFrame:
    """documents: source is the tenant, lang the category."""
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("tenant_id"),
        "text",
        F.col("lang").alias("category"),
        created_at(F.col("doc_id")).alias("created_at"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return as_documents(table(spark, sf, "documents"))


def tenant_of(number: str, tenants: int = 20):
    return F.concat(F.lit("src"), (F.col(number) % tenants).cast("string"))


def turns(spark: SparkSession, sf: str, tenants: int = 20) -> DataFrame:
    """Every conversation turn as a query to one of the tenants.

    The role decides the optional conditions: system turns ask for English,
    assistant turns for German, and user turns carry a time range.
    """
    role, start = F.col("role"), F.col("conv_id")
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        tenant_of("conv_id", tenants).alias("tenant_id"),
        "text",
        F.when(role == "system", "en").when(role == "assistant", "de").alias("category_filter"),
        F.when(role == "user", created_at(start)).alias("created_after"),
        F.when(role == "user", created_at(start + 500)).alias("created_before"),
        F.col("turn").alias("turn"),
    )


def plain_turns(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("query_id", "tenant_id", "text")


def document_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a query for the documents of its tenant and category."""
    return documents(spark, sf).select(
        F.col("id").alias("query_id"), "tenant_id", "text", "category"
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings: the label is the tenant."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("tenant_id"),
        F.col("embedding").alias("dense"),
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).withColumnRenamed("id", "query_id")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a latency log: type is the mode, value the milliseconds."""
    return events(spark, sf).select(
        F.col("event_type").alias("mode"),
        F.col("event_id").alias("query_id"),
        F.col("value").alias("latency_ms"),
        "ts",
    )


def ingest_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as an ingest log: four tenants, one row per point."""
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        "ts",
    )
