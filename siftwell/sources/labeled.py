"""Labeled corpora with known relevant sets, generated inside Spark.

Every random choice is a hash of (seed, row id, slot), so rows are generated
independently, in any order, on any executor, and always the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftwell.functions.text import hash_mod, vocabulary
from siftwell.operators.embed import term_frequencies

# Topic vocabularies, shared words, tenants, first time stamp and
# spacing of the generated corpus.
TOPIC_WORDS = {
    "databases": "index query transaction schema replication sharding postgres sql engine "
    "primary key foreign key normalization acid isolation vacuum autovacuum "
    "connection pool prepared statement explain analyze btree hash join",
    "networking": "tcp udp packet router switch latency throughput congestion handshake "
    "dns resolver bgp routing table subnet cidr firewall nat gateway "
    "http header tls certificate socket port bandwidth proxy load balancer",
    "machinelearning": "gradient descent neural network embedding transformer attention loss "
    "training validation overfitting regularization dropout batch epoch tensor "
    "vector similarity cosine retrieval ranking recall precision benchmark",
    "cooking": "recipe onion garlic simmer saute knife chopping board skillet oven "
    "flour butter sugar dough bake pastry whisk oven temperature rise "
    "spice cumin paprika marinade grill roast season salt pepper broth",
    "finance": "portfolio equity bond yield interest rate dividend valuation risk hedge "
    "cash flow balance sheet revenue margin liability asset depreciation audit "
    "market volatility option future derivative arbitrage liquidity spread index",
}
COMMON_WORDS = "system data value using based process result table field record set"
TENANTS = ("acme", "globex", "initech")
FIRST_CREATED_AT = 1_700_000_000
SECONDS_PER_ID = 3600


def created_at(doc_id: Column) -> Column:
    return F.lit(FIRST_CREATED_AT).cast("bigint") + doc_id * SECONDS_PER_ID


def _draw(seed: int, row: Column, slot: Column) -> Column:
    token = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), slot)
    return hash_mod(token, 2**31)


def _between(draw: Column, low: int, high: int) -> Column:
    return (F.lit(low) + F.pmod(draw, F.lit(high - low + 1))).cast("int")


def _picks(seed: int, row: Column, slot: str, count: Column, words: Column) -> Column:
    """``count`` words drawn with replacement."""

    def pick(i: Column) -> Column:
        draw = _draw(seed, row, F.concat(F.lit(slot), i.cast("string")))
        return F.get(words, F.pmod(draw, F.size(words)).cast("int"))

    return F.transform(F.sequence(F.lit(1), count), pick)


def _shuffled(seed: int, row: Column, words: Column) -> Column:
    keyed = F.transform(
        words,
        lambda w, i: F.struct(
            _draw(seed, row, F.concat(F.lit("order"), i.cast("string"))), i, w.alias("w")
        ),
    )
    return F.transform(F.sort_array(keyed), lambda x: x["w"])


def default_vocabulary(spark: SparkSession) -> DataFrame:
    """category, words of the five fixed topics."""
    rows = [(c, w) for c, w in TOPIC_WORDS.items()]
    df = spark.createDataFrame(rows, "category string, line string")
    return df.select("category", vocabulary(F.col("line")).alias("words"))


def vocabulary_of(documents: DataFrame, size: int = 30) -> DataFrame:
    """category, words: the ``size`` most frequent terms of each category."""
    freq = term_frequencies(documents, "category")
    order = Window.partitionBy("category").orderBy(F.desc("tf"), "term")
    top = freq.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size)
    return top.groupBy("category").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]
        ).alias("words")
    )


def labeled_rows(spark: SparkSession, tenants=TENANTS, docs_per_topic: int = 30) -> DataFrame:
    """id, tenant_id, category: ids run over tenants, then topics, then documents."""
    topics = list(TOPIC_WORDS)
    per_tenant = len(topics) * docs_per_topic
    ids = spark.range(len(tenants) * per_tenant)
    tenant = F.get(F.lit(list(tenants)), F.floor(F.col("id") / per_tenant).cast("int"))
    topic = F.pmod(F.floor(F.col("id") / docs_per_topic), F.lit(len(topics))).cast("int")
    return ids.select("id", tenant.alias("tenant_id"), F.get(F.lit(topics), topic).alias("category"))


def _all_topics(vocab: DataFrame) -> Column:
    """All vocabularies as one array, in category order (a small scalar)."""
    return vocab.select(F.sort_array(F.collect_list(F.struct("category", "words")))).scalar()


def generate_documents(rows: DataFrame, vocab: DataFrame, seed: int = 13) -> DataFrame:
    """One document per ``id, tenant_id, category`` row.

    8-14 words of its own topic, 4-8 shared words and 1-3 groups of 2-4 words
    of any topic, shuffled.
    """
    row = F.col("id")

    def n(slot: str, low: int, high: int) -> Column:
        return _between(_draw(seed, row, F.lit(slot)), low, high)

    def noise(i: Column) -> Column:
        at = i.cast("string")
        draw = _draw(seed, row, F.concat(F.lit("noise_topic"), at))
        words = F.get(F.col("_all"), F.pmod(draw, F.size("_all")).cast("int"))["words"]
        count = _between(_draw(seed, row, F.concat(F.lit("noise_size"), at)), 2, 4)

        def pick(j: Column) -> Column:
            slot = F.concat(F.lit("noise"), at, F.lit("_"), j.cast("string"))
            return F.get(words, F.pmod(_draw(seed, row, slot), F.size(words)).cast("int"))

        return F.transform(F.sequence(F.lit(1), count), pick)

    common = F.lit(COMMON_WORDS.split())
    ready = rows.join(vocab, "category").withColumn("_all", _all_topics(vocab))
    words = F.concat(
        _picks(seed, row, "topic", n("n_topic", 8, 14), F.col("words")),
        _picks(seed, row, "common", n("n_common", 4, 8), common),
        F.flatten(F.transform(F.sequence(F.lit(1), n("n_noise", 1, 3)), noise)),
    )
    return (
        ready.withColumn("_w", words)
        .withColumn("text", F.array_join(_shuffled(seed, row, F.col("_w")), " "))
        .select("id", "tenant_id", "text", "category", created_at(row).alias("created_at"))
    )


def generate_queries(rows: DataFrame, vocab: DataFrame, seed: int = 13) -> DataFrame:
    """One query per ``query_id, tenant_id`` row: 3-4 words of a drawn topic, 1 shared.

    Topic words are drawn without replacement by position, so a word that the
    vocabulary lists twice may occur twice.
    """
    row = F.col("query_id")
    draw = F.pmod(_draw(seed, row, F.lit("query_topic")), F.size("_all")).cast("int")
    ready = rows.withColumn("_all", _all_topics(vocab)).withColumn(
        "_topic", F.get(F.col("_all"), draw)
    )
    words = F.col("_topic.words")
    positions = F.sort_array(
        F.transform(
            words,
            lambda w, i: F.struct(
                _draw(seed, row, F.concat(F.lit("sample"), i.cast("string"))), i, w.alias("w")
            ),
        )
    )
    count = F.least(_between(_draw(seed, row, F.lit("n_words")), 3, 4), F.size(words))
    shared = _picks(seed, row, "query_common", F.lit(1), F.lit(COMMON_WORDS.split()))
    sample = F.transform(F.slice(positions, F.lit(1), count), lambda x: x["w"])
    text = F.array_join(F.concat(sample, shared), " ")
    return ready.select("query_id", text.alias("text"), "tenant_id", F.col("_topic.category").alias("category"))


def query_rows(spark: SparkSession, tenants=TENANTS, queries_per_tenant: int = 10) -> DataFrame:
    ids = spark.range(len(tenants) * queries_per_tenant)
    tenant = F.get(F.lit(list(tenants)), F.floor(F.col("id") / queries_per_tenant).cast("int"))
    return ids.select(F.col("id").alias("query_id"), tenant.alias("tenant_id"))


def labeled_dataset(
    spark: SparkSession,
    tenants=TENANTS,
    docs_per_topic: int = 30,
    queries_per_tenant: int = 10,
    seed: int = 13,
) -> tuple[DataFrame, DataFrame]:
    """Documents and queries of the default labeled corpus."""
    vocab = default_vocabulary(spark)
    return (
        generate_documents(labeled_rows(spark, tenants, docs_per_topic), vocab, seed),
        generate_queries(query_rows(spark, tenants, queries_per_tenant), vocab, seed),
    )
