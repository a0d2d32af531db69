import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """3 tenants x 5 topics x 8 documents and 18 queries, as plain Python rows."""
    from siftwell.sources.labeled import labeled_dataset

    documents, queries = labeled_dataset(spark, docs_per_topic=8, queries_per_tenant=6, seed=7)
    return documents.orderBy("id").collect(), queries.orderBy("query_id").collect()


@pytest.fixture(scope="session")
def tables(spark, corpus):
    """documents, points, queries (embedded, dim 256) as cached tables."""
    from siftwell.operators.embed import embed_hashed

    documents = spark.createDataFrame(corpus[0]).repartition(4, "id").cache()
    queries = spark.createDataFrame(corpus[1]).repartition(2, "query_id")
    return documents, embed_hashed(documents, 256).cache(), embed_hashed(queries, 256).cache()
