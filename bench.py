"""Headline timings at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The tables, one small file each, are first written as several files. The corpus
is ingested once into a collection on disk, as a user would; the searches answer
every conversation turn from it. Every timing runs its result to the end,
including the work done while the plan is built.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from checks import queries as q, tables as t
from checks.compare import session
from siftwell.operators import ann, embed, idf as idf_ops, inverted, metrics
from siftwell.operators.ranking import exact_topk
from siftwell.plans.search import search, search_modes
from siftwell.sources import collection

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    work = collection.shared_dir(spark)
    timings: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    tables = f"{work}/sf"
    for name in ("documents", "conversations", "embeddings", "events"):
        t.table(spark, SF_DIR, name).repartition(int(CPUS)).write.parquet(f"{tables}/{name}.parquet")
    documents = t.documents(spark, tables)
    drain(embed.embed_hashed(documents.limit(200)))  # start the Python workers
    n_docs, n_queries = documents.count(), t.plain_turns(spark, tables).count()

    timed("ingest_points", lambda: collection.ingest_documents(documents, embed.embed_hashed, f"{work}/points").collect())
    points = spark.read.schema(collection.POINT).parquet(f"{work}/points").drop(*collection.VERSION)
    timed("idf_table", lambda: idf_ops.idf_table(points).write.parquet(f"{work}/idf"))
    idf = spark.read.parquet(f"{work}/idf")
    asked = embed.embed_hashed(t.plain_turns(spark, tables))
    for mode in ("dense", "sparse", "hybrid"):
        timed(f"search_{mode}", lambda: drain(search(points, asked, mode, idf=idf)))
    timed("write_index", lambda: inverted.write_index(points, f"{work}/index"))
    timed("search_sparse_index", lambda: drain(inverted.index_search(spark, f"{work}/index", asked, idf)))
    few = collection.stored(asked.where("query_id < 25000").limit(100))
    timed("search_sparse_100", lambda: drain(search(points, few, "sparse", idf=idf)))
    timed("search_sparse_index_100", lambda: drain(inverted.index_search(spark, f"{work}/index", few, idf)))
    timed("search_all_modes", lambda: drain(search_modes(points, asked, idf=idf)))
    timed("search_hybrid_slices", lambda: drain(search(points, asked, idf=idf, slice_bytes=4 << 20)))
    filtered = embed.embed_hashed(t.turns(spark, tables))
    timed("search_hybrid_filtered", lambda: drain(search(points, filtered, idf=idf)))

    vectors, vector_queries = t.vectors(spark, tables), t.vector_queries(spark, tables)
    timed("train_lists", lambda: ann.train_centroids(vectors, q.SETTINGS["n_lists"]).write.parquet(f"{work}/centroids"))
    centroids = spark.read.parquet(f"{work}/centroids")
    timed("write_lists", lambda: ann.write_lists(vectors, centroids, f"{work}/lists"))
    listed = spark.read.parquet(f"{work}/lists").withColumn("tenant_id", F.col("tenant_id").cast("string"))
    timed("vectors_exact", lambda: drain(exact_topk(vectors, vector_queries, 10)))
    timed("vectors_ivf", lambda: drain(ann.ivf_search(listed, vector_queries, centroids, q.VECTOR_NPROBE)))
    log = t.query_log(spark, tables)
    timed("latency_percentiles", lambda: drain(metrics.latency_percentiles(log)))
    for name in ("tokenize_terms", "bm25_topk", "mode_recall_summary", "running_counter", "upsert_latest"):
        timed(name, lambda: drain(q.QUERIES[name](spark, tables)))

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "documents": n_docs,
                "search_queries": n_queries,
                "ingest_points_per_sec": round(n_docs / timings["ingest_points"], 1),
                "queries_per_sec": {
                    m: round(n_queries / timings[f"search_{m}"], 1)
                    for m in ("dense", "sparse", "hybrid")
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
