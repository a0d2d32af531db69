"""SQL twins of the registered queries, written independently of the library."""

from __future__ import annotations

# The words that all generated texts share.
COMMON_WORDS = "system data value using based process result table field record set"

DOCS = """docs AS (SELECT doc_id AS id, source AS tenant_id, text, lang AS category,
  1700000000 + doc_id * 3600 AS created_at FROM documents)"""

TURNS = """asked AS (SELECT conv_id * 1000 + turn AS query_id, 'src' || (conv_id % 20) AS tenant_id,
  text, turn,
  CASE role WHEN 'system' THEN 'en' WHEN 'assistant' THEN 'de' END AS category_filter,
  CASE WHEN role = 'user' THEN 1700000000 + conv_id * 3600 END AS created_after,
  CASE WHEN role = 'user' THEN 1700000000 + (conv_id + 500) * 3600 END AS created_before
  FROM conversations)"""

DOC_QUERIES = "asked AS (SELECT id AS query_id, tenant_id, text, category FROM docs)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def terms(name: str, source: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {source})
  GROUP BY {key}, term)"""


def chunk(digest: str, start: int) -> str:
    return f"('0x' || substr({digest}, {start}, 8))::BIGINT"


def hashed(token: str, modulus: int) -> str:
    """128-bit md5 modulo ``modulus`` from four 32-bit chunks."""
    digest = f"md5({token})"
    step = 2**32 % modulus
    out = f"({chunk(digest, 1)} % {modulus})"
    for start in (9, 17, 25):
        out = f"(({out} * {step} + {chunk(digest, start)}) % {modulus})"
    return out


def low31(token: str) -> str:
    return f"({chunk(f'md5({token})', 25)} % 2147483648)"


SIGN = "(CASE WHEN ('0x' || substr(md5(term || '#sign'), 25, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)"


def counts(name: str, source: str, key: str) -> str:
    """Sparse counts: colliding terms are one entry."""
    return f"""{name} AS (SELECT {key}, {low31('term')} AS idx, sum(tf)::BIGINT AS n
  FROM {source} GROUP BY ALL)"""


def slots(name: str, source: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, {hashed('term', 384)} AS idx,
  sum(tf * {SIGN})::BIGINT AS v FROM {source} GROUP BY ALL)"""


IDF_OF = "ln(1.0e0 + ({n} - {df} + 0.5e0) / ({df} + 0.5e0))"
IDF = f"""idf AS (SELECT idx, count(*) AS df,
  {IDF_OF.format(n='(SELECT count(*) FROM docs)', df='count(*)')} AS idf
  FROM dn GROUP BY idx)"""
TENANT_IDF = f"""sizes AS (SELECT tenant_id, count(*) AS n FROM docs GROUP BY tenant_id),
idf AS (SELECT tenant_id, idx, count(*) AS df,
  {IDF_OF.format(n='any_value(sizes.n)', df='count(*)')} AS idf
  FROM dn JOIN docs USING (id) JOIN sizes USING (tenant_id) GROUP BY tenant_id, idx)"""

DOC_TERMS = [terms("dt", "docs", "id"), counts("dn", "dt", "id")]
QUERY_TERMS = [terms("qt", "asked", "query_id"), counts("qn", "qt", "query_id")]

LOG_WEIGHTS = """dw AS (SELECT id, idx, 1.0e0 + ln(n) AS w FROM dn),
qw AS (SELECT query_id, idx, 1.0e0 + ln(n) AS w FROM qn)"""

BM25_DOCS = """len AS (SELECT docs.id, coalesce(sum(tf), 0) AS len FROM docs LEFT JOIN dt USING (id)
  GROUP BY docs.id),
dw AS (SELECT id, idx, n * 2.2e0 / (n + 1.2e0 * (0.25e0 + 0.75e0 * len
  / (SELECT avg(len) FROM len))) AS w FROM dn JOIN len USING (id))"""

DENSE = f"""{slots('dv', 'dt', 'id')}, {slots('qv', 'qt', 'query_id')},
dnorm AS (SELECT id, sum(v * v) AS s FROM dv GROUP BY id),
qnorm AS (SELECT query_id, sum(v * v) AS s FROM qv GROUP BY query_id),
dots AS (SELECT query_id, id, sum(qv.v * dv.v) AS s
  FROM asked JOIN qv USING (query_id) JOIN docs USING (tenant_id)
  JOIN dv ON dv.id = docs.id AND dv.idx = qv.idx GROUP BY query_id, docs.id AS id),
dense_all AS (SELECT tenant_id, a.query_id, d.id, round(coalesce(dots.s, 0)
  / sqrt((coalesce(nullif(qnorm.s, 0), 1) * coalesce(nullif(dnorm.s, 0), 1))::DOUBLE), 9) AS score
  FROM asked a JOIN docs d USING (tenant_id)
  LEFT JOIN dots ON dots.query_id = a.query_id AND dots.id = d.id
  LEFT JOIN qnorm ON qnorm.query_id = a.query_id LEFT JOIN dnorm ON dnorm.id = d.id)"""
DENSE = DENSE.replace("GROUP BY query_id, docs.id AS id", "GROUP BY query_id, docs.id").replace(
    "SELECT query_id, id, sum(qv.v", "SELECT query_id, docs.id, sum(qv.v"
)


def sparse_all(idf_on: str = "qw.idx = idf.idx", order: str = "ORDER BY qw.idx") -> str:
    """Scores of all sharing pairs; adding in index order makes the sums repeatable."""
    return f"""sparse_all AS (SELECT asked.tenant_id, asked.query_id, docs.id,
  round(sum(dw.w * (qw.w * idf.idf) {order}), 9) AS score
  FROM asked JOIN qw USING (query_id) JOIN idf ON {idf_on}
  JOIN docs ON docs.tenant_id = asked.tenant_id
  JOIN dw ON dw.id = docs.id AND dw.idx = qw.idx
  GROUP BY asked.tenant_id, asked.query_id, docs.id)"""


ANY_DOCUMENT = "SELECT asked.query_id, docs.id FROM asked JOIN docs USING (tenant_id)"
PER_QUERY = """SELECT asked.query_id, docs.id FROM asked JOIN docs USING (tenant_id)
  WHERE (category_filter IS NULL OR category = category_filter)
  AND (created_after IS NULL OR created_at >= created_after)
  AND (created_before IS NULL OR created_at <= created_before)"""
IN_RANGE = PER_QUERY.replace("(category_filter IS NULL OR category = category_filter)", "true")
ENGLISH = ANY_DOCUMENT + " WHERE category = 'en'"


def top(name: str, source: str, k: int, allowed: str | None = None) -> str:
    tie = "desc" if "dense" in source else "asc"
    join = f"JOIN ({allowed}) AS ok USING (query_id, id)" if allowed else ""
    return f"""{name} AS (SELECT * FROM (SELECT {source}.*, row_number() OVER (
  PARTITION BY tenant_id, query_id ORDER BY score DESC, id {tie})::INTEGER AS rank
  FROM {source} {join}) WHERE rank <= {k})"""


def fused(prefetch: int, k: int, allowed: str | None = None) -> list[str]:
    return [
        top("dense_pre", "dense_all", prefetch, allowed),
        top("sparse_pre", "sparse_all", prefetch, allowed),
        """hybrid_all AS (SELECT tenant_id, query_id, id, sum(1.0e0 / (60 + rank)) AS score FROM (
  SELECT * FROM dense_pre UNION ALL SELECT * FROM sparse_pre)
  GROUP BY tenant_id, query_id, id)""",
        top("hybrid", "hybrid_all", k),
    ]


BASE = [DOCS, *DOC_TERMS]
TEXT = [DOCS, TURNS, *DOC_TERMS, *QUERY_TERMS]
SPARSE = [*TEXT, IDF, LOG_WEIGHTS, sparse_all()]
HIT = "SELECT tenant_id, query_id, rank, id, printf('%.6f', score)::DOUBLE AS score FROM "
HYBRID = [*SPARSE, DENSE]

VECTORS = """points AS (SELECT vec_id AS id, label::VARCHAR AS tenant_id,
  embedding::DOUBLE[] AS dense FROM embeddings)"""
VECTOR_PAIRS = """dense_all AS (SELECT q.tenant_id, q.id AS query_id, d.id,
  round(list_inner_product(q.dense, d.dense) / (sqrt(list_inner_product(q.dense, q.dense))
  * sqrt(list_inner_product(d.dense, d.dense))), 9) AS score
  FROM points q JOIN points d USING (tenant_id))"""
LISTS, ROUNDS, NEAR_VECTORS, NEAR_TEXTS = 32, 4, 20, 8


NORM = "sqrt(list_inner_product({0}, {0}))"
COSINE = f"list_inner_product(unit, dense) / coalesce(nullif({NORM.format('dense')}, 0), 1)"
CLOSENESS = "list_inner_product(unit, dense) - (list_inner_product(unit, unit) + list_inner_product(dense, dense)) / 2"


def lloyd(name: str, units: str, key: str, lists: int, nearness: str) -> list[str]:
    """Rounds of Lloyd's algorithm over ``units`` (key, id, place, unit); ``name`` has key, list_id, dense."""
    c = [f"{name}_c{r}" for r in range(ROUNDS)] + [name]
    parts = [f"{c[0]} AS MATERIALIZED (SELECT {key}, place AS list_id, unit AS dense FROM {units} WHERE place < {lists})"]
    for r in range(1, ROUNDS + 1):
        n, m = f"{name}_n{r}", f"{name}_m{r}"
        parts.append(
            f"""{n} AS MATERIALIZED (SELECT {key}, id, place, unit, list_id, sim FROM (
  SELECT u.*, list_id, round({nearness}, 9) AS sim FROM {units} u JOIN {c[r - 1]} USING ({key}))
  QUALIFY row_number() OVER (PARTITION BY {key}, id ORDER BY sim DESC, list_id) = 1),
{m} AS MATERIALIZED (SELECT {key}, list_id, list(floor(v * 16777216 + 0.5e0) / 16777216 ORDER BY i) AS dense
  FROM (SELECT {key}, list_id, i, sum(v) / count(*) AS v FROM (SELECT {key}, list_id, unnest(unit) AS v,
    generate_subscripts(unit, 1) AS i FROM {n}) GROUP BY ALL) GROUP BY {key}, list_id),
{c[r]} AS MATERIALIZED (SELECT * FROM {m} UNION ALL SELECT {key}, list_id, unit FROM (
    SELECT {key}, list_id, row_number() OVER (PARTITION BY {key} ORDER BY list_id) AS k
    FROM {c[r - 1]} ANTI JOIN {m} USING ({key}, list_id))
  JOIN (SELECT {key}, unit, row_number() OVER (PARTITION BY {key} ORDER BY sim, place) AS k FROM {n})
  USING ({key}, k))"""
        )
    return parts


def trained() -> list[str]:
    """Lists of points(tenant_id, id, dense): ``cents``, and what a search can reach."""
    return [
        f"""units AS MATERIALIZED (SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id
  ORDER BY md5(id::VARCHAR)) - 1 AS place, list_transform(dense,
  lambda x: x / coalesce(nullif({NORM.format('dense')}, 0), 1)) AS unit FROM points)""",
        *lloyd("cents", "units", "tenant_id", LISTS, COSINE),
        f"""near AS MATERIALIZED (SELECT p.tenant_id, p.id, list_id, row_number() OVER (PARTITION BY p.id
  ORDER BY round(list_inner_product(p.dense, c.dense) / (coalesce(nullif({NORM.format('p.dense')}, 0), 1)
  * coalesce(nullif({NORM.format('c.dense')}, 0), 1)), 9) DESC, list_id) AS list_rank
  FROM points p JOIN cents c USING (tenant_id)),
assigned AS (SELECT tenant_id, id, list_id FROM near WHERE list_rank = 1),
reach AS (SELECT d.tenant_id, d.query_id, d.id, d.score, near.list_rank FROM dense_all d
  JOIN assigned a ON a.id = d.id
  JOIN near ON near.id = d.query_id AND near.list_id = a.list_id)""",
    ]


#: Product-quantisation codes of points: 16 parts of 4 numbers, 64 codes, 40 candidates.
PIECES = [
    f"""pieces AS MATERIALIZED (SELECT part, tenant_id, id, place, unit[4 * part + 1 : 4 * part + 4] AS unit
  FROM (SELECT tenant_id, id, row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS place, list_transform(dense,
    lambda x: x / coalesce(nullif({NORM.format('dense')}, 0), 1)) AS unit FROM points), range(16) AS r(part))""",
    *lloyd("book", "pieces", "part", 64, CLOSENESS),
    f"""coded AS MATERIALIZED (SELECT part, tenant_id, id, dense FROM pieces JOIN book USING (part)
  QUALIFY row_number() OVER (PARTITION BY part, id ORDER BY round({CLOSENESS}, 9) DESC, list_id) = 1),
code_sums AS (SELECT q.tenant_id, q.id AS query_id, d.id,
  round(sum(list_inner_product(q.unit, d.dense) ORDER BY part), 9) AS score
  FROM pieces q JOIN coded d USING (part, tenant_id) GROUP BY q.tenant_id, q.id, d.id)""",
]
IVF = ",\n".join(trained())
#: Embedded texts as lists of numbers.
TEXT_POINTS = """points AS (SELECT tenant_id, id, list(coalesce(v, 0) / sqrt(coalesce(nullif(s, 0), 1)::DOUBLE) ORDER BY i) AS dense
  FROM docs CROSS JOIN range(384) AS r(i) LEFT JOIN dnorm USING (id) LEFT JOIN dv ON dv.id = docs.id AND dv.idx = i
  GROUP BY tenant_id, docs.id)"""
TEXT_POINTS = TEXT_POINTS.replace("SELECT tenant_id, id, list", "SELECT tenant_id, docs.id, list")

LOG = "log AS (SELECT event_type AS mode, event_id AS query_id, value AS latency_ms, ts FROM events)"
FOLDED = """log AS (SELECT CASE event_type WHEN 'view' THEN 'dense' WHEN 'click' THEN 'sparse'
  ELSE 'hybrid' END AS mode, value AS latency_ms FROM events)"""
INGEST = "points AS (SELECT event_id AS id, 't' || (user_id % 4) AS tenant_id, ts FROM events)"
BATCHED = """numbered AS (SELECT tenant_id, id, ((row_number() OVER (PARTITION BY tenant_id
  ORDER BY id) - 1) // 256)::BIGINT AS batch_no FROM points)"""
BATCH_SIZES = "sizes AS (SELECT tenant_id, batch_no, count(*) AS n FROM numbered GROUP BY ALL)"
LATENCY = """lat AS (SELECT mode, quantile_cont(latency_ms, 0.5) AS p50_ms,
  quantile_cont(latency_ms, 0.95) AS p95_ms, quantile_cont(latency_ms, 0.99) AS p99_ms
  FROM log GROUP BY mode)"""
QPS = """speed AS (SELECT mode, count(*) AS n_queries,
  CASE WHEN sum(latency_ms) > 0 THEN count(*) / (sum(latency_ms) / 1000.0e0) ELSE 0.0e0 END AS qps
  FROM log GROUP BY mode)"""
# The bounds of the latency histogram, in seconds.
BOUNDS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)

SELF = [
    DOCS, DOC_QUERIES, *DOC_TERMS, *QUERY_TERMS, IDF, LOG_WEIGHTS, sparse_all(order=""), DENSE
]
ALL_MODES = [
    *SELF,
    *fused(50, 10),
    """hits AS (SELECT 'dense' AS mode, * FROM dense_pre WHERE rank <= 10
  UNION ALL SELECT 'sparse', * FROM sparse_pre WHERE rank <= 10
  UNION ALL SELECT 'hybrid', * FROM hybrid)""",
    """recalls AS (SELECT mode, a.tenant_id, a.query_id,
  count(*) FILTER (WHERE h.rank <= 5 AND d.category = a.category)
    / least(5, any_value(r.n))::DOUBLE AS recall_at_5,
  count(*) FILTER (WHERE h.rank <= 10 AND d.category = a.category)
    / least(10, any_value(r.n))::DOUBLE AS recall_at_10
  FROM asked a JOIN hits h USING (tenant_id, query_id) JOIN docs d ON d.id = h.id
  JOIN (SELECT tenant_id, category, count(*) AS n FROM docs GROUP BY ALL) r
    ON r.tenant_id = a.tenant_id AND r.category = a.category
  GROUP BY mode, a.tenant_id, a.query_id)""",
]
SUMMARY = [
    *ALL_MODES,
    TEXT_POINTS,
    IVF,
    f"""approx AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, id DESC) AS rank FROM reach WHERE list_rank <= {NEAR_TEXTS}) WHERE rank <= 10),
reached AS (SELECT e.query_id, count(approx.id) / count(*)::DOUBLE AS recall
  FROM (SELECT query_id, id FROM dense_pre WHERE rank <= 10) e
  LEFT JOIN approx USING (query_id, id) GROUP BY e.query_id)""",
    FOLDED,
    LATENCY,
    QPS,
    """summary AS (SELECT mode, round(avg(recall_at_5), 6) AS recall_at_5,
  round(avg(recall_at_10), 6) AS recall_at_10,
  CASE WHEN mode = 'dense' THEN (SELECT round(avg(recall), 6) FROM reached) END AS index_recall_at_10,
  any_value(p50_ms) AS p50_ms, any_value(p95_ms) AS p95_ms,
  any_value(p99_ms) AS p99_ms, round(any_value(qps), 6) AS qps, count(*) AS n_queries
  FROM recalls JOIN lat USING (mode) JOIN speed USING (mode) GROUP BY mode)""",
]


def fixed(col: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', {col}), 'n/a')"


STORED = [
    """docs AS (SELECT item_id AS id, 'src' || (item_id % 20) AS tenant_id, text,
  'benchmark' AS category, 1700000000 + item_id * 3600 AS created_at FROM benchmark
  UNION ALL SELECT doc_id, source, text, lang, 1700000000 + doc_id * 3600 FROM documents
  WHERE doc_id NOT IN (SELECT item_id FROM benchmark))""",
    TURNS,
    *DOC_TERMS,
    *QUERY_TERMS,
    IDF,
    LOG_WEIGHTS,
    sparse_all(),
    DENSE,
]

CHANGED = [
    """docs AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 'moved' ELSE source END AS tenant_id,
  CASE WHEN doc_id % 6 = 0 THEN 'second ' WHEN doc_id % 3 = 0 THEN 'first batch ' ELSE '' END || coalesce(text, '') AS text
  FROM documents)""",
    *DOC_TERMS,
]

COMMON_LIST = "['" + "', '".join(COMMON_WORDS.split()) + "']"
VOCAB = """catterm AS (SELECT category, term, sum(tf) AS tf FROM dt JOIN docs USING (id) GROUP BY ALL),
vocab AS (SELECT category, list(term ORDER BY r) AS words FROM (SELECT *, row_number() OVER (
  PARTITION BY category ORDER BY tf DESC, term) AS r FROM catterm) WHERE r <= 30 GROUP BY category),
everything AS (SELECT list({'category': category, 'words': words} ORDER BY category) AS topics
  FROM vocab)"""


def draw(row: str, slot: str) -> str:
    return low31(f"('13|' || {row} || '|' || {slot})")


def between(value: str, low: int, high: int) -> str:
    return f"({low} + {value} % {high - low + 1})"


def pick(words: str, value: str) -> str:
    return f"list_extract({words}, ({value} % len({words}) + 1)::BIGINT)"


GENERATED = [
    *BASE,
    VOCAB,
    f"""raw AS (SELECT id, tenant_id, docs.category, list_concat(list_concat(
  list_transform(range(1, {between(draw('id', "'n_topic'"), 8, 14)} + 1),
    lambda i: {pick('words', draw('id', "'topic' || i"))}),
  list_transform(range(1, {between(draw('id', "'n_common'"), 4, 8)} + 1),
    lambda i: {pick(COMMON_LIST, draw('id', "'common' || i"))})),
  flatten(list_transform(range(1, {between(draw('id', "'n_noise'"), 1, 3)} + 1),
    lambda g: list_transform(
      range(1, {between(draw('id', "'noise_size' || g"), 2, 4)} + 1),
      lambda j: {pick(
          "list_extract(topics, (" + draw('id', "'noise_topic' || g")
          + " % len(topics) + 1)::BIGINT).words",
          draw('id', "'noise' || g || '_' || j"))})))) AS w
  FROM docs JOIN vocab ON vocab.category = docs.category CROSS JOIN everything)""",
    f"""placed AS (SELECT id, word, i, {draw('id', "'order' || (i - 1)")} AS h FROM (
  SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM raw))""",
]

GENERATED_QUERIES = [
    *BASE,
    VOCAB,
    f"""drawn AS (SELECT query_id, tenant_id, list_extract(topics,
  ({draw('query_id', "'query_topic'")} % len(topics) + 1)::BIGINT) AS topic
  FROM (SELECT conv_id * 1000 + turn AS query_id, 'src' || (conv_id % 20) AS tenant_id
  FROM conversations) CROSS JOIN everything)""",
    f"""sampled AS (SELECT query_id, word, row_number() OVER (PARTITION BY query_id
  ORDER BY {draw('query_id', "'sample' || (i - 1)")}, i) AS r FROM (
  SELECT query_id, unnest(topic.words) AS word, generate_subscripts(topic.words, 1) AS i
  FROM drawn))""",
]

EVENT_ROW = "user_id AS id, ts, event_id, event_type, value"
LATEST = f"""SELECT id, ts, event_id, event_type, value FROM (SELECT {EVENT_ROW}, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""

HISTOGRAM = " UNION ALL ".join(
    [
        f"SELECT mode, '{b}' AS le, count(*) FILTER (WHERE latency_ms / 1000.0e0 <= {b}::DOUBLE) AS n,"
        " round(sum(latency_ms / 1000.0e0), 6) AS sum_seconds, count(latency_ms) AS count"
        " FROM log GROUP BY mode"
        for b in BOUNDS
    ]
    + [
        "SELECT mode, '+Inf', count(latency_ms), round(sum(latency_ms / 1000.0e0), 6),"
        " count(latency_ms) FROM log GROUP BY mode"
    ]
)
BUCKET = (
    "CASE "
    + " ".join(f"WHEN value / 1000.0e0 <= {b}::DOUBLE THEN '{b}'" for b in BOUNDS)
    + " ELSE '+Inf' END"
)

SQL = {
    "text_vocabulary": """SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::INTEGER AS place, word
  FROM (SELECT conv_id * 1000 + turn AS query_id, unnest(string_split(text, ' ')) AS word,
    generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations) WHERE word <> ''""",
    "named_embedders": with_(*BASE)
    + """SELECT id, embedder, dim, count(idx)::INTEGER AS n_terms
  FROM docs CROSS JOIN (VALUES ('Hash', 16), ('BM25', 16), ('MODEL', 2)) AS e(embedder, dim) LEFT JOIN dn USING (id)
  GROUP BY id, embedder, dim""",
    "tokenize_terms": with_(*BASE) + "SELECT id, term, tf FROM dt",
    "hash_sparse_postings": with_(*BASE) + "SELECT id, idx, round(1.0e0 + ln(n), 6) AS w FROM dn",
    "hash_dense_components": with_(DOCS, DOC_TERMS[0], slots("dv", "dt", "id"))
    + "SELECT id, idx, v AS value FROM dv",
    "hash_dense_vectors": with_(DOCS, DOC_TERMS[0], slots("dv", "dt", "id"))
    + """SELECT id, idx::INTEGER AS idx, round(v / sqrt((sum(v * v) OVER (PARTITION BY id))::DOUBLE), 6)
  AS value FROM dv QUALIFY v <> 0""",
    "idf_stats": with_(*BASE, IDF) + "SELECT idx, df, round(idf, 6) AS idf FROM idf",
    "idf_stats_by_tenant": with_(*BASE, TENANT_IDF)
    + "SELECT tenant_id, idx, df, round(idf, 6) AS idf FROM idf",
    "bm25_weights": with_(*BASE, BM25_DOCS) + "SELECT id, idx, round(w, 6) AS w FROM dw",
    "model_embed_hook": """SELECT doc_id AS id, length(text)::DOUBLE AS chars,
  length(replace(text, ' ', 'xx'))::DOUBLE - length(text) AS blanks,
  length(replace(text, chr(10), 'xx'))::DOUBLE - length(text) AS newlines FROM documents""",
    "dense_exact_topk": with_(VECTORS, VECTOR_PAIRS, top("dense", "dense_all", 10)) + HIT + "dense",
    "dense_exact_topk_text": with_(*TEXT, DENSE, top("dense", "dense_all", 10)) + HIT + "dense",
    "sparse_topk": with_(*SPARSE, top("hits", "sparse_all", 10)) + HIT + "hits",
    "sparse_index_topk": with_(*SPARSE, top("hits", "sparse_all", 10)) + HIT + "hits",
    "sparse_index_filtered": with_(*SPARSE, top("hits", "sparse_all", 10, PER_QUERY)) + HIT + "hits",
    "index_term_maxima": with_(*BASE)
    + """SELECT tenant_id, idx, count(*) AS df, round(max(1.0e0 + ln(n)), 6) AS largest
  FROM dn JOIN docs USING (id) GROUP BY tenant_id, idx""",
    "sparse_topk_tenant_idf": with_(
        *TEXT,
        TENANT_IDF,
        LOG_WEIGHTS,
        sparse_all("qw.idx = idf.idx AND idf.tenant_id = asked.tenant_id"),
        top("hits", "sparse_all", 10),
    )
    + HIT + "hits",
    "bm25_topk": with_(
        *TEXT,
        IDF,
        BM25_DOCS,
        "qw AS (SELECT query_id, idx, n::DOUBLE AS w FROM qn)",
        sparse_all(),
        top("hits", "sparse_all", 10),
    )
    + HIT + "hits",
    "hybrid_rrf_topk": with_(*HYBRID, *fused(50, 10)) + HIT + "hybrid",
    "hybrid_narrow_prefetch": with_(*HYBRID, *fused(15, 10)) + HIT + "hybrid",
    "hybrid_grid_plan": with_(*HYBRID, *fused(50, 10)) + HIT + "hybrid",
    "hits_with_payload": with_(*SPARSE, top("hits", "sparse_all", 3))
    + """SELECT hits.tenant_id, query_id, rank, id, printf('%.6f', score)::DOUBLE AS score, text, category
  FROM hits JOIN docs USING (id)""",
    "filtered_category": with_(*HYBRID, *fused(50, 20, ENGLISH)) + HIT + "hybrid",
    "filtered_time_range": with_(*TEXT, DENSE, top("dense", "dense_all", 50, IN_RANGE)) + HIT + "dense",
    "filtered_combined": with_(*HYBRID, *fused(50, 10, PER_QUERY)) + HIT + "hybrid",
    "single_tenant_filter": with_(DOCS)
    + """SELECT tenant_id, id, category, created_at FROM docs
  WHERE tenant_id = 'src3' AND category = 'en' AND created_at >= 1700000000""",
    "unknown_tenants": """SELECT conv_id * 1000 + turn AS query_id, 'src' || (conv_id % 25) AS tenant_id
  FROM conversations WHERE 'src' || (conv_id % 25) NOT IN (SELECT source FROM documents)""",
    "clamped_limit": with_(*SPARSE, top("hits", "sparse_all", 20))
    + """SELECT hits.tenant_id, query_id, rank, id, printf('%.6f', score)::DOUBLE AS score FROM hits
  JOIN asked USING (query_id) WHERE rank <= greatest(1, least(turn * 9 - 3, 20))""",
    "hit_display": with_(*HYBRID, *fused(50, 5))
    + """SELECT query_id, rank, printf('%.4f  [%s]  %s', score, category,
  substring(text, 1, 70)) AS line FROM hybrid JOIN docs USING (id)""",
    "hit_response": with_(*HYBRID, *fused(50, 5))
    + """SELECT query_id, rank, text AS content, printf('%.4f', score)::DOUBLE AS score, category
  FROM hybrid JOIN docs USING (id)""",
    "tenant_leak_check": with_(*SELF, *fused(50, 25))
    + "SELECT count(*) AS leaks FROM hybrid h JOIN docs d USING (id) WHERE h.tenant_id <> d.tenant_id",
    "time_range_check": with_(*TEXT, DENSE, top("dense", "dense_all", 50, IN_RANGE))
    + """SELECT count(*) AS violations FROM dense JOIN asked USING (query_id) JOIN docs USING (id)
  WHERE created_at < created_after OR created_at > created_before""",
    "nth_document_by_time": with_(DOCS)
    + """SELECT * FROM (SELECT tenant_id, id, created_at, row_number() OVER (PARTITION BY tenant_id
  ORDER BY created_at)::INTEGER AS n FROM docs) WHERE n IN (3, 7)""",
    "relevant_sets": with_(DOCS)
    + """SELECT tenant_id, category, id, count(*) OVER (PARTITION BY tenant_id, category)
  AS n_relevant FROM docs""",
    "recall_at_k": with_(*ALL_MODES)
    + """SELECT mode, tenant_id, query_id, round(recall_at_5, 6) AS recall_at_5,
  round(recall_at_10, 6) AS recall_at_10 FROM recalls""",
    "mode_recall_summary": with_(*ALL_MODES)
    + """SELECT mode, round(avg(recall_at_5), 6) AS recall_at_5,
  round(avg(recall_at_10), 6) AS recall_at_10, count(*) AS n_queries FROM recalls GROUP BY mode""",
    "recall_by_list": with_(
        *SPARSE,
        top("hits", "sparse_all", 10),
        BM25_DOCS.replace("len AS", "blen AS", 1)
        .replace("FROM len)", "FROM blen)")
        .replace("JOIN len USING", "JOIN blen USING")
        .replace("dw AS", "bdw AS"),
        "bqw AS (SELECT query_id, idx, n::DOUBLE AS w FROM qn)",
        sparse_all()
        .replace("sparse_all", "bm_sparse_all")
        .replace("qw", "bqw")
        .replace("dw", "bdw"),
        top("listed", "bm_sparse_all", 10),
        """judged AS (SELECT a.tenant_id, a.query_id, h.rank,
  l.id IS NOT NULL AS good, (SELECT count(*) FROM listed x WHERE x.query_id = a.query_id) AS n
  FROM asked a LEFT JOIN hits h USING (query_id)
  LEFT JOIN listed l ON l.query_id = a.query_id AND l.id = h.id)""",
    )
    + "SELECT 'sparse' AS mode, tenant_id, query_id, "
    + ", ".join(
        f"""round(coalesce(count(*) FILTER (WHERE good AND rank <= {k})
  / nullif(least({k}, any_value(n)), 0)::DOUBLE, 0), 6) AS recall_at_{k}"""
        for k in (1, 5, 10)
    )
    + " FROM judged GROUP BY tenant_id, query_id",
    "mode_summary": with_(*SUMMARY)
    + f"""SELECT * REPLACE (round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms,
  round(p99_ms, 6) AS p99_ms), {LISTS} AS n_lists, {NEAR_TEXTS} AS nprobe, 50 AS prefetch_limit, 60 AS rrf_k0,
  (SELECT count(*) FROM docs) AS n_docs FROM summary""",
    "ivf_assign": with_(VECTORS, VECTOR_PAIRS, IVF) + "SELECT tenant_id, id, list_id FROM assigned",
    "ivf_topk": with_(
        VECTORS, VECTOR_PAIRS, IVF,
        "dense_near AS (SELECT * EXCLUDE (list_rank) FROM reach WHERE list_rank <= 20)",
        top("hits", "dense_near", 10),
    )
    + HIT + "hits",
    "standing_topk": with_(
        VECTORS.replace("points", "asked"),
        """points AS (SELECT id, tenant_id, CASE WHEN id % 7 = 0 THEN list_reverse(dense) ELSE dense END AS dense FROM asked)""",
        VECTOR_PAIRS.replace("FROM points q", "FROM asked q"),
        top("dense", "dense_all", 10),
    )
    + HIT + "dense",
    "pq_topk": with_(
        VECTORS, VECTOR_PAIRS, *PIECES,
        top("proposed", "code_sums", 40).replace("id asc", "id desc"),
        "dense_near AS (SELECT d.* FROM dense_all d SEMI JOIN proposed USING (query_id, id))",
        top("hits", "dense_near", 10),
    )
    + HIT + "hits",
    "pq_codes": with_(VECTORS, *PIECES)
    + """SELECT id, part::INTEGER AS part, round(dense[1], 6) AS first_value FROM coded""",
    "ivf_adaptive_topk": with_(VECTORS, VECTOR_PAIRS, top("dense", "dense_all", 10)) + HIT + "dense",
    "hybrid_ivf_topk": with_(
        *SELF, TEXT_POINTS, IVF,
        f"near_dense AS (SELECT * EXCLUDE (list_rank) FROM reach WHERE list_rank <= {NEAR_TEXTS})",
        *fused(50, 10)
    ).replace("FROM dense_all )", "FROM near_dense )").replace("SELECT dense_all.*", "SELECT near_dense.*")
    + HIT + "hybrid",
    "ivf_all_lists": with_(VECTORS, VECTOR_PAIRS, top("dense", "dense_all", 10)) + HIT + "dense",
    "ivf_sweep_recall": with_(
        VECTORS, VECTOR_PAIRS, IVF,
        top("exact", "dense_all", 10),
        """swept AS (SELECT nprobe, query_id, id FROM (SELECT nprobe, query_id, id, row_number() OVER (
  PARTITION BY nprobe, query_id ORDER BY score DESC, id DESC) AS rank
  FROM reach JOIN (VALUES (1), (4), (8), (20), (32)) AS v(nprobe) ON list_rank <= nprobe)
  WHERE rank <= 10)""",
        """per AS (SELECT v.nprobe, p.id AS query_id,
  (SELECT count(*) FROM swept s JOIN exact e ON e.query_id = s.query_id AND e.id = s.id
    WHERE s.nprobe = v.nprobe AND s.query_id = p.id)
  / least(10, (SELECT count(*) FROM exact e WHERE e.query_id = p.id))::DOUBLE AS r
  FROM points p CROSS JOIN (VALUES (1), (4), (8), (20), (32)) AS v(nprobe))""",
    )
    + """SELECT nprobe, round(avg(r), 6) AS recall_at_10, count(*) AS n_queries
  FROM per GROUP BY nprobe""",
    "latency_percentiles": with_(LOG, LATENCY)
    + """SELECT mode, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms,
  round(p99_ms, 6) AS p99_ms FROM lat""",
    "latency_sketch_hours": with_(LOG)
    + """SELECT mode, floor(epoch(ts) / 3600)::BIGINT * 3600 AS hour, count(latency_ms) AS n FROM log GROUP BY ALL""",
    "latency_sketch_ranks": with_(LOG)
    + "SELECT mode, count(latency_ms) AS n, true AS p50_ms, true AS p95_ms, true AS p99_ms FROM log GROUP BY mode",
    "mode_qps": with_(LOG, QPS) + "SELECT mode, n_queries, round(qps, 6) AS qps FROM speed",
    "latency_histogram": with_(LOG) + HISTOGRAM,
    "gauge_last": with_(LOG)
    + "SELECT mode, arg_max(latency_ms, (ts, query_id)) AS value FROM log GROUP BY mode",
    "tenant_counter": with_(INGEST) + "SELECT tenant_id, count(*) AS n FROM points GROUP BY tenant_id",
    "ingest_batches": with_(INGEST, BATCHED) + "SELECT tenant_id, id, batch_no FROM numbered",
    "batch_counts": with_(INGEST, BATCHED, BATCH_SIZES) + "SELECT tenant_id, batch_no, n FROM sizes",
    "running_counter": with_(INGEST, BATCHED, BATCH_SIZES)
    + """SELECT tenant_id, batch_no, n, (sum(n) OVER (PARTITION BY tenant_id ORDER BY batch_no
  ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM sizes""",
    "ingest_throughput": with_(
        INGEST,
        """span AS (SELECT count(*) AS points,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0e0 AS seconds FROM points)""",
    )
    + """SELECT points, round(seconds, 6) AS seconds, round(CASE WHEN seconds > 0
  THEN points / seconds ELSE points END, 6) AS throughput FROM span""",
    "tenant_list": "SELECT DISTINCT source AS tenant_id FROM documents",
    "upsert_latest": LATEST,
    "zordered_conditions": with_(DOCS)
    + """SELECT id, tenant_id, category, created_at FROM docs
  WHERE category = 'de' AND created_at BETWEEN 1700360000 AND 1702520000""",
    "idf_after_upserts": with_(*CHANGED, TENANT_IDF) + "SELECT tenant_id, idx, df, round(idf, 6) AS idf FROM idf",
    "tokens_after_upserts": with_(*CHANGED)
    + """SELECT tenant_id, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM (
  SELECT tenant_id, docs.id, coalesce(sum(tf), 0) AS tokens FROM docs LEFT JOIN dt USING (id)
  GROUP BY tenant_id, docs.id) GROUP BY tenant_id""",
    "collection_rows": with_(*STORED)
    + """SELECT id, tenant_id, category, created_at, count(idx)::INTEGER AS n_terms
  FROM docs LEFT JOIN dn USING (id) GROUP BY ALL""",
    "collection_search": with_(*STORED, *fused(50, 10)) + HIT + "hybrid",
    "report_markdown": with_(*SUMMARY)
    + f"""SELECT mode, '| ' || mode || ' | ' || {fixed('recall_at_5', 3)} || ' | '
  || {fixed('recall_at_10', 3)} || ' | ' || {fixed('index_recall_at_10', 3)} || ' | '
  || {fixed('p50_ms', 2)} || ' | ' || {fixed('p95_ms', 2)} || ' | ' || {fixed('p99_ms', 2)}
  || ' | ' || {fixed('qps', 0)} || ' |' AS line FROM summary""",
    "report_json": with_(*SUMMARY)
    + """SELECT mode, '{"mode":"' || mode || '","recall_at_5":' || recall_at_5
  || ',"recall_at_10":' || recall_at_10 || ',"n_queries":' || n_queries
  || ',"index_recall_at_10":' || coalesce(index_recall_at_10::VARCHAR, 'null')
  || ',"p50_ms":' || round(p50_ms, 6) || ',"p95_ms":' || round(p95_ms, 6)
  || ',"p99_ms":' || round(p99_ms, 6) || ',"qps":' || qps
  || ',"n_lists":32,"nprobe":8,"prefetch_limit":50,"rrf_k0":60,"n_docs":'
  || (SELECT count(*) FROM docs) || '}' AS json FROM summary""",
    "report_sweep": with_(
        DOCS, DOC_QUERIES, *DOC_TERMS, *QUERY_TERMS, DENSE, TEXT_POINTS, IVF,
        top("dense", "dense_all", 10),
        """swept AS (SELECT * FROM (SELECT nprobe, query_id, id, row_number() OVER (
  PARTITION BY nprobe, query_id ORDER BY score DESC, id DESC) AS rank
  FROM reach JOIN (VALUES (1), (8), (32)) AS v(nprobe) ON list_rank <= nprobe) WHERE rank <= 10)""",
        """judged AS (SELECT nprobe, a.query_id,
  count(*) FILTER (WHERE s.rank <= 5 AND d.category = a.category) / least(5, any_value(r.n))::DOUBLE AS at_5,
  count(*) FILTER (WHERE d.category = a.category) / least(10, any_value(r.n))::DOUBLE AS at_10,
  count(e.id) / any_value(x.n)::DOUBLE AS found
  FROM asked a JOIN swept s USING (query_id) JOIN docs d ON d.id = s.id
  JOIN (SELECT tenant_id, category, count(*) AS n FROM docs GROUP BY ALL) r
    ON r.tenant_id = a.tenant_id AND r.category = a.category
  JOIN (SELECT query_id, count(*) AS n FROM dense GROUP BY query_id) x ON x.query_id = a.query_id
  LEFT JOIN dense e ON e.query_id = a.query_id AND e.id = s.id GROUP BY nprobe, a.query_id)""",
        """sweep AS (SELECT nprobe, round(avg(at_5), 6) AS recall_at_5, round(avg(at_10), 6) AS recall_at_10,
  round(avg(found), 6) AS index_recall_at_10, count(*) AS n FROM judged GROUP BY nprobe)""",
    )
    + f"""SELECT nprobe, 'n_docs=' || (SELECT count(*) FROM docs) || ' n_queries=' || n || ' n_lists={LISTS} nprobe=' || nprobe
  AS settings, '| ' || nprobe || ' | ' || {fixed('recall_at_5', 3)} || ' | ' || {fixed('recall_at_10', 3)} || ' | '
  || {fixed('index_recall_at_10', 3)} || ' |' AS line FROM sweep""",
    "generated_corpus": with_(*GENERATED)
    + """SELECT docs.id, docs.tenant_id, string_agg(word, ' ' ORDER BY h, i) AS text, docs.category,
  docs.created_at FROM placed JOIN docs ON docs.id = placed.id
  GROUP BY docs.id, docs.tenant_id, docs.category, docs.created_at""",
    "generated_queries": with_(*GENERATED_QUERIES)
    + f"""SELECT query_id, string_agg(word, ' ' ORDER BY r)
  || ' ' || any_value({pick(COMMON_LIST, draw('query_id', "'query_common1'"))}) AS text,
  tenant_id, topic.category AS category FROM sampled JOIN drawn USING (query_id)
  WHERE r <= {between(draw('query_id', "'n_words'"), 3, 4)}
  GROUP BY query_id, tenant_id, topic.category""",
    "stream_ingest_latest": LATEST,
    "stream_ingest_points": with_(*BASE)
    + """SELECT id, tenant_id, category, created_at, count(idx)::INTEGER AS n_terms,
  round(coalesce(sum(1.0e0 + ln(n)), 0), 6) AS weight, 384 AS dim
  FROM docs LEFT JOIN dn USING (id) GROUP BY ALL""",
    "stream_after_upserts": with_(DOCS)
    + """SELECT id, tenant_id, created_at + later AS created_at, md5(word || coalesce(text, '')) AS text_md5
  FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 2 THEN 0 WHEN id % 2 = 0 THEN 3 ELSE 2 END AS later,
    CASE later WHEN 1 THEN 'upserted ' WHEN 2 THEN 'streamed ' WHEN 3 THEN 'again ' ELSE '' END AS word
    FROM docs)""",
    "ingest_duplicate_ids": """SELECT doc_id AS id, source AS tenant_id,
  1700000001 + doc_id * 3600 AS created_at, md5('later ' || coalesce(text, '')) AS text_md5
  FROM documents""",
    "attached_vectors": """SELECT doc_id AS id, source AS tenant_id,
  coalesce(len(embedding), 0)::INTEGER AS dim
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "event_epochs": """SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, hour(ts)::INTEGER AS hour
  FROM events""",
    "checked_dims": "SELECT doc_id AS id, 384 AS dim FROM documents",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_latency_buckets": f"""SELECT event_type AS mode, {BUCKET} AS le, count(*) AS n
  FROM events GROUP BY ALL""",
}
