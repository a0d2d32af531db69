"""Term statistics kept with a collection: one additive table per version.

Every version of a collection has a table of changes beside it: per tenant and
term how many documents more (or fewer) have the term, and per tenant how many
documents and tokens there are more. A document that replaces another takes the
old one's share back, also from another tenant. Statistics of the current rows
are sums over these tables; the points themselves are not read again.

Layout: ``<path>/_statistics/batch_seq=<n>/writer=<w>``, which readers of the
points skip. Writing the changes of a version again replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftwell.functions.rows import explode_rows
from siftwell.functions.text import tokenize
from siftwell.sources.collection import POINT, VERSION, BASE, BATCH, newest_points, recreate_collection, upsert_points

CHANGES = T.StructType().add("tenant_id", "string").add("idx", "long").add("df", "long").add("documents", "long").add("tokens", "long")


def _folder(path: str, batch_seq: int, writer: str) -> str:
    return f"{path}/_statistics/batch_seq={batch_seq}/writer={writer}"


def changes(points: DataFrame, sign: int) -> DataFrame:
    """The statistics of points as rows: one per tenant and term, one per tenant (``idx`` null)."""
    signed = F.lit(sign).cast("bigint")
    terms = explode_rows(points, ["tenant_id"], F.col("sparse.indices"), "idx")
    terms = terms.groupBy("tenant_id", "idx").agg(F.sum(signed).alias("df"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    tokens = F.coalesce(F.size(tokenize(F.col("text"))), F.lit(0)) * signed
    tenants = points.groupBy("tenant_id").agg(F.sum(signed).alias("documents"), F.sum(tokens).alias("tokens"))
    return terms.select("tenant_id", "idx", "df", zero.alias("documents"), zero.alias("tokens")).unionByName(
        tenants.select("tenant_id", none.alias("idx"), zero.alias("df"), "documents", "tokens")
    )


def write_statistics(spark: SparkSession, path: str, batch_seq: int, writer: str) -> None:
    """The changes that a version of the collection makes to all others.

    Reads that version, and of the others the ids, and the terms and texts of
    the rows it replaces. Rows that a later version already replaces change
    nothing.
    """
    versions = spark.read.schema(POINT).parquet(path)
    mine = (F.col("batch_seq") == batch_seq) & (F.col("writer") == writer)
    columns = ["id", "tenant_id", "text", "sparse"]
    own = versions.where(mine).select(*columns)
    if batch_seq == 0:
        added, removed = own, own.limit(0)
    else:
        ids = own.select(F.col("id").alias("_id"))
        same = F.col("id").eqNullSafe(F.col("_id"))
        others = newest_points(versions.where(~mine)).select(*columns, *VERSION)
        replaced = others.join(ids, same, "left_semi")
        later = F.struct(*VERSION) > F.struct(F.lit(batch_seq).cast("bigint").alias("batch_seq"), F.lit(writer).alias("writer"))
        winners = replaced.where(later).select(F.col("id").alias("_id"))
        added, removed = own.join(winners, same, "left_anti"), replaced.where(~later)
    both = changes(added, 1).unionByName(changes(removed, -1))
    summed = both.groupBy("tenant_id", "idx").agg(*(F.sum(c).alias(c) for c in ("df", "documents", "tokens")))
    kept = summed.where("df != 0 OR documents != 0 OR tokens != 0")
    kept.hint("rebalance").write.mode("overwrite").parquet(_folder(path, batch_seq, writer))


def recreate_with_statistics(points: DataFrame, path: str) -> None:
    """``recreate_collection``, and the statistics of the new base."""
    recreate_collection(points, path)
    write_statistics(points.sparkSession, path, 0, BASE)


def upsert_with_statistics(points: DataFrame, path: str, batch_seq: int, writer: str = BATCH) -> None:
    """``upsert_points``, and the changes that the batch makes to the statistics."""
    upsert_points(points, path, batch_seq, writer)
    write_statistics(points.sparkSession, path, batch_seq, writer)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """tenant_id, idx (null: all of the tenant), df, documents, tokens of the current rows."""
    sums = spark.read.schema(CHANGES).parquet(f"{path}/_statistics").groupBy("tenant_id", "idx")
    summed = sums.agg(*(F.sum(c).alias(c) for c in ("df", "documents", "tokens")))
    return summed.where("df != 0 OR documents != 0 OR tokens != 0")


def collection_idf(spark: SparkSession, path: str, scope: str = "collection") -> DataFrame:
    """The table of ``idf_table`` for the current rows, from the statistics alone."""
    if scope not in ("collection", "tenant"):
        raise ValueError("idf scope must be collection or tenant")
    kept = read_statistics(spark, path)
    keys = [] if scope == "collection" else ["tenant_id"]
    terms = kept.where("idx IS NOT NULL").groupBy(*keys, "idx").agg(F.sum("df").alias("df")).where("df > 0")
    sizes = kept.where("idx IS NULL").groupBy(*keys).agg(F.sum("documents").alias("n"))
    terms = terms.join(sizes, keys) if keys else terms.withColumn("n", sizes.select("n").scalar())
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.select(*keys, "idx", "df", idf.alias("idf"))


def token_totals(spark: SparkSession, path: str) -> DataFrame:
    """tenant_id, documents, tokens: average lengths for BM25 without reading a text."""
    return read_statistics(spark, path).where("idx IS NULL AND documents > 0").select("tenant_id", "documents", "tokens")
