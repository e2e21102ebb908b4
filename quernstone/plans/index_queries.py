"""Queries on an index: waiting work, stored forms, inputs of an embedding model, centroids of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import fusion, indexing, search
from quernstone.plans.registry import COUNT, query
from quernstone.sources.tables import table

MODEL, DIMENSION, LIMIT = "m1", 64, 500
_STATES = ["discovered", "parsing", "parsed", "failed", "indexed"]


@query(f"SELECT doc_id, {_STATES}[doc_id % 5 + 1] AS status, lang, source FROM documents WHERE doc_id % 5 IN (0, 1, 3) AND doc_id % 2 = 0")
def documents_to_parse(spark: SparkSession, folder: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("csv")
    docs = table(spark, folder, "documents").select("doc_id", status.alias("status"), F.col("lang").alias("domain"), F.col("source").alias("file_name"), kind.alias("source_type"))
    return indexing.waiting_documents(docs, "pdf").select("doc_id", "status", F.col("domain").alias("lang"), F.col("file_name").alias("source"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks: every third has no vector, every fifth one of another model, every seventh a blank text."""
    n = F.col("doc_id")
    made = n % 3 != 0
    text = F.when(n % 7 == 0, "   ").otherwise(F.col("text"))
    state = {"embedding": F.when(made, F.lit(1.0)), "model": F.when(made, F.when(n % 5 == 0, "m0").otherwise(MODEL)), "dimension": F.when(made, F.lit(DIMENSION))}
    return table(spark, folder, "documents").select(
        F.col("lang").alias("domain"), F.lit("pdf").alias("source_type"), F.col("source").alias("file_name"), n.alias("chunk_id"), text.alias("retrieval_text"),
        *[c.alias(f"{kind}_{k}") for kind in ("dense", "sparse") for k, c in state.items()],
    )


_PENDING = "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN '   ' ELSE text END AS retrieval_text FROM documents WHERE (doc_id % 3 = 0 OR doc_id % 5 = 0) {} ORDER BY lang, source, doc_id LIMIT " + str(LIMIT)


@query(_PENDING.format(""))
def pending_dense(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.pending_chunks(_chunks(spark, folder), "dense", MODEL, DIMENSION, LIMIT).select("chunk_id", "retrieval_text")


@query(_PENDING.format("AND doc_id % 7 <> 0 AND trim(text) <> ''"))
def pending_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.pending_chunks(_chunks(spark, folder), "sparse", MODEL, DIMENSION, LIMIT).select("chunk_id", "retrieval_text")


@query("SELECT doc_id AS chunk_id, NULL::VARCHAR AS text_content, NULL::VARCHAR AS table_markdown, text AS table_html, '{\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"storage_mode\":\"compact\"}' AS metadata FROM documents")
def compact_storage(spark: SparkSession, folder: str) -> DataFrame:
    meta = F.concat(F.lit('{"lang":'), F.coalesce(F.concat(F.lit('"'), "lang", F.lit('"')), F.lit("null")), F.lit("}"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("text_content"), F.col("text").alias("table_markdown"), F.col("text").alias("table_html"), meta.alias("metadata"))
    return indexing.stored_form(docs, True)


@query("SELECT doc_id AS chunk_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE doc_id % 7 <> 0 AND regexp_matches(text, '\\S')")
def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.chunk_texts(_chunks(spark, folder))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id DESC) - 1) // 250 AS batch FROM documents")
def index_batches(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.in_batches(table(spark, folder, "documents").select("doc_id"), -F.col("doc_id"), 250)


_INPUTS = f"""i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN greatest(1, ceil(length(text) / 3::DOUBLE))::BIGINT ELSE coalesce(nullif({COUNT.format('text')}, 0), greatest(1, ceil(length(text) / 3::DOUBLE)))::BIGINT END AS t,
  doc_id % 4 AS n, 500 + doc_id % 7000 AS w, 400 + doc_id % 5000 AS h FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, n * w * h AS px, greatest(560, (30000 - t) * 560) AS room FROM i),
f AS (SELECT *, least(CASE WHEN px > room THEN sqrt(room / px::DOUBLE) ELSE 1.0 END, CASE WHEN n > 0 AND w * h > 16000000 THEN sqrt(16000000 / (w * h)::DOUBLE) ELSE 1.0 END) AS scale FROM s)"""


@query(f"""WITH {_INPUTS} SELECT doc_id, least(30000, t + least(greatest(0, 30000 - t), ceil(px / 560::DOUBLE)))::BIGINT AS tokens, round(scale, 6) AS scale,
  CASE WHEN n > 0 THEN CASE WHEN scale < 1 THEN greatest(1, floor(w * scale))::BIGINT ELSE w END END AS width FROM f""")
def embedding_inputs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    image = F.struct((F.col("doc_id") % 7000 + 500).alias("width"), (F.col("doc_id") % 5000 + 400).alias("height"))
    tokens = indexing.text_tokens(F.col("text"), F.when(F.col("doc_id") % 3 != 0, T.token_count(F.col("text"))))
    rows = docs.select("doc_id", tokens.alias("t"), F.array_repeat(image, (F.col("doc_id") % 4).cast("int")).alias("images"))
    scale = indexing.image_scale(F.col("t"), F.col("images"))
    return rows.select("doc_id", indexing.input_tokens(F.col("t"), F.col("images")).alias("tokens"), F.round(scale, 6).alias("scale"), F.get(indexing.scaled(F.col("images"), scale), F.lit(0))["width"].alias("width"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'consumer' ELSE 'professional' END AS audience, page_id % 2 = 0 AND (page_id % 200 < 80 OR page_id % 150 < 80) AS tiny FROM pages")
def page_audience(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("page_id")
    url = F.when(n % 3 == 0, F.concat(F.coalesce("url", F.lit("")), F.lit("&audience=consumer"))).otherwise(F.col("url"))
    reason = F.when(n % 2 == 0, "layout chart crop").otherwise("layout table or form crop")
    return table(spark, folder, "pages").select("page_id", indexing.audience(url).alias("audience"), indexing.tiny_chart(reason, n % 200, n % 150).alias("tiny"))


@query("""SELECT vec_id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0.1::FLOAT)::INT[] AS indices, list_transform(list_filter(embedding, lambda x: x > 0.1::FLOAT), lambda x: round(x::DOUBLE, 6)) AS values, 64 AS dimension FROM embeddings WHERE embedding IS NOT NULL""")
def sparse_export(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.transform("embedding", lambda x, i: F.struct(i.alias("i"), F.round(x.cast("double"), 6).alias("v"), (x > F.lit(0.1).cast("float")).alias("ok")))
    weights = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["ok"]), lambda e: F.struct(e["i"], e["v"])))
    return table(spark, folder, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", indexing.sparse_record(weights, DIMENSION).alias("r")).select("vec_id", "r.*")


_TYPED = "v AS (SELECT vec_id, embedding, label::VARCHAR AS domain, CASE WHEN vec_id % 2 = 0 THEN 'child_chunk' ELSE 'csv_chunk' END AS retrieval_type FROM embeddings WHERE vec_id % 9 <> 0 AND embedding IS NOT NULL)"
_CENTS = f"""{_TYPED}, x AS (SELECT domain, retrieval_type, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM v),
c AS (SELECT domain, retrieval_type, list(m ORDER BY dim) AS centroid FROM (SELECT domain, retrieval_type, dim, avg(x) AS m FROM x GROUP BY ALL) GROUP BY ALL)"""


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("vec_id") % 2 == 0, "child_chunk").otherwise("csv_chunk")
    model = F.when(F.col("vec_id") % 9 != 0, MODEL).otherwise("m0")
    return table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("string").alias("domain"), kind.alias("retrieval_type"), F.col("embedding").alias("dense_embedding"), model.alias("dense_model"), F.lit(DIMENSION).alias("dense_dimension"))


@query(f"""WITH {_CENTS}, n AS (SELECT domain, retrieval_type, count(*) AS n FROM v GROUP BY ALL)
SELECT domain || ':' || retrieval_type || ':m1:64' AS centroid_id, n, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM c JOIN n USING (domain, retrieval_type)
UNION ALL SELECT 'kept:m0', 1, [0.5::DOUBLE]""")
def centroids_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Old centroids of the model go, those of another model stay."""
    cols = "centroid_id string, domain string, retrieval_type string, n long, dense_model string, dense_dimension int, centroid array<double>"
    old = spark.createDataFrame([("gone:m1", "d", "t", 9, MODEL, DIMENSION, [0.1]), ("kept:m0", "d", "t", 1, "m0", DIMENSION, [0.5])], cols)
    made = search.rebuilt_centroids(old, _typed(spark, folder), MODEL, DIMENSION)
    return made.select("centroid_id", "n", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"""WITH {_CENTS}, s AS (SELECT q.vec_id AS query_id, c.domain, max(round(list_cosine_similarity(q.embedding::DOUBLE[], c.centroid), 6)) AS score FROM embeddings q, c WHERE q.vec_id % 50 = 0 AND q.vec_id % 150 <> 0 GROUP BY ALL),
r AS (SELECT query_id, list(domain ORDER BY score DESC, domain) AS names, list(score ORDER BY score DESC, domain) AS scores FROM s GROUP BY query_id)
SELECT vec_id AS query_id, CASE WHEN names IS NULL OR scores[1] < 0.25 THEN ['0', '1', '2'] WHEN scores[2] IS NULL OR round(scores[1] - scores[2], 9) >= 0.03 THEN names[1:1] ELSE names[1:2] END AS domains,
  CASE WHEN names IS NULL THEN 'fallback_all' WHEN scores[1] < 0.25 THEN 'low_all_domains' WHEN scores[2] IS NULL OR round(scores[1] - scores[2], 9) >= 0.03 THEN 'high_single_domain' ELSE 'ambiguous_two_domains' END AS confidence
FROM embeddings LEFT JOIN r ON query_id = vec_id WHERE vec_id % 50 = 0""")
def domain_routing_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """A domain's score is the best of its retrieval types; every third query has no scores and falls back to all domains."""
    queries = table(spark, folder, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    cents = search.model_centroids(_typed(spark, folder), MODEL, DIMENSION)
    scores = search.domain_scores(queries.where(F.col("query_id") % 150 != 0), cents)
    return fusion.route_domains(scores, queries=queries, every=["0", "1", "2"])


@query(f"""WITH c AS (SELECT vec_id // 3 AS doc_id, count(*) FILTER (WHERE label = 4) AS waits FROM embeddings GROUP BY ALL), d AS (SELECT doc_id, {_STATES}[doc_id % 5 + 1] AS status FROM documents)
SELECT d.doc_id, CASE WHEN status NOT IN ('parsed', 'chunked', 'indexed') THEN status WHEN waits IS NULL THEN 'parsed' WHEN waits > 0 THEN 'chunked' ELSE 'indexed' END AS status FROM d LEFT JOIN c USING (doc_id)""")
def document_states(spark: SparkSession, folder: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("doc_id") % 5 + 1).cast("int"))
    children = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("doc_id"), "label")
    return indexing.document_status(table(spark, folder, "documents").select("doc_id", status.alias("status")), children, "doc_id", F.col("label") == 4)
