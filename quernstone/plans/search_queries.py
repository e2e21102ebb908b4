"""Queries on retrieval: search, routing, fusion, expansion, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import fusion, postings, search, vector_index
from quernstone.plans.registry import COUNT, TERMS, query
from quernstone.plans.retrieve import answers
from quernstone.sources.tables import table
from quernstone.storage import new_folder

K, FUSED, DOC_TERMS, QUERY_TERMS = 50, 50, 768, 128
#: The query set: every row whose id is divisible by this.
EVERY = 50

_DENSE = f"""dense AS (
  SELECT query_id, id, score, rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
           (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id))::INT AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0 FILTER_) WHERE rank <= {K})"""
_SPARSE = f"""tf AS (
  SELECT doc_id, term, ln(1 + count(*)::DOUBLE) AS w FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term
), weights AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS r FROM tf), sparse AS (
  SELECT query_id, id, score, rank FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM (
      SELECT q.doc_id AS query_id, d.doc_id AS id, round(sum(q.w * d.w), 6) AS score
      FROM weights q JOIN weights d USING (term) WHERE q.doc_id % {EVERY} = 0 AND q.r <= {QUERY_TERMS} AND d.r <= {DOC_TERMS} GROUP BY ALL)) WHERE rank <= {K})"""
_FUSED = f"""fused AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id))::INT AS fused_rank FROM (
    SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, max(rank) FILTER (WHERE list = 'dense') AS dense_rank, max(rank) FILTER (WHERE list = 'sparse') AS sparse_rank
    FROM (SELECT *, 'dense' AS list FROM dense UNION ALL SELECT *, 'sparse' AS list FROM sparse) GROUP BY query_id, id) QUALIFY fused_rank <= {FUSED})"""
_KEPT = "kept AS (SELECT *, id // 5 AS parent_id, (row_number() OVER (PARTITION BY query_id, id // 5 ORDER BY rrf_score DESC, id))::INT AS nth FROM fused WHERE id IN (SELECT doc_id FROM documents) QUALIFY nth <= 3)"
_PARENTS = """parents AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, first_rank, parent_id))::INT AS parent_rank FROM (
    SELECT query_id, parent_id, max(rrf_score) AS best_score, min(fused_rank) AS first_rank, list(id ORDER BY nth) AS child_ids FROM kept GROUP BY query_id, parent_id))"""


def dense(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    queries = vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.dense_topk(queries, vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), K)


def weighted(spark: SparkSession, folder: str, most: int, queries: bool = False) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    docs = docs.where(F.col("id") % EVERY == 0) if queries else docs
    return search.sparse_vectors(docs, F.transform(F.regexp_extract_all("text", F.lit(T.TERM), 0), F.lower), most)


def sparse(spark: SparkSession, folder: str) -> DataFrame:
    return search.sparse_topk(weighted(spark, folder, QUERY_TERMS, True).withColumnRenamed("id", "query_id"), weighted(spark, folder, DOC_TERMS), K)


@query(f"WITH {_SPARSE} SELECT * FROM sparse")
def sparse_index_topk(spark: SparkSession, folder: str) -> DataFrame:
    """As ``sparse_topk``, from postings in blocks with bounds."""
    path = new_folder(spark, "postings")
    postings.write(weighted(spark, folder, DOC_TERMS), path)
    return postings.search(spark, path, weighted(spark, folder, QUERY_TERMS, True).withColumnRenamed("id", "query_id"), K)


def fused(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.rrf({"dense": dense(spark, folder), "sparse": sparse(spark, folder)}, FUSED)


def parents(spark: SparkSession, folder: str) -> DataFrame:
    parent_of = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 5).alias("parent_id"))
    return fusion.expand_parents(fused(spark, folder), parent_of)


@query(f"WITH {_DENSE.replace('FILTER_', '')} SELECT * FROM dense")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder)


def _indexed(spark: SparkSession, folder: str, exact: bool) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    path = new_folder(spark, "dense-index")
    vector_index.build(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path)
    queries = vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.search(spark, path, queries, K, exact=exact)


@query()
def dense_index_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Near neighbours from the nearest cells only, with the share of rows read. Recall is held against ``dense_topk``."""
    return _indexed(spark, folder, False)


@query(f"WITH {_DENSE.replace('FILTER_', '')} SELECT * FROM dense")
def dense_index_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _indexed(spark, folder, True).drop("read_share")


@query(f"WITH {_DENSE.replace('FILTER_', 'AND e.label IN (1, 3, 4)')} SELECT * FROM dense")
def dense_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    queries = vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = fusion.only(vectors, "label", [1, 3, 4])
    return search.dense_topk(queries, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), K)


_CENTROIDS = """flat AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
cents AS (SELECT label, list(round(m, 6) ORDER BY dim) AS centroid FROM (SELECT label, dim, avg(x) AS m FROM flat GROUP BY label, dim) GROUP BY label)"""


def _centroids(spark: SparkSession, folder: str) -> DataFrame:
    made = search.centroids(table(spark, folder, "embeddings").select("label", F.col("embedding").alias("vector")), "label")
    return made.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


@query(f"WITH {_CENTROIDS} SELECT label, centroid, (SELECT count(*) FROM embeddings e WHERE e.label = c.label) AS n FROM cents c")
def domain_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return _centroids(spark, folder)


@query(f"""WITH {_CENTROIDS}, s AS (
  SELECT q.vec_id AS query_id, c.label::VARCHAR AS domain, round(list_cosine_similarity(q.embedding::DOUBLE[], c.centroid), 6) AS score FROM embeddings q, cents c WHERE q.vec_id % {EVERY} = 0
), r AS (SELECT query_id, list(domain ORDER BY score DESC, domain) AS names, list(score ORDER BY score DESC) AS scores FROM s GROUP BY query_id)
SELECT query_id, CASE WHEN scores[1] < 0.25 THEN names WHEN scores[2] IS NULL OR round(scores[1] - scores[2], 9) >= 0.03 THEN names[1:1] ELSE names[1:2] END AS domains,
  CASE WHEN scores[1] < 0.25 THEN 'low_all_domains' WHEN scores[2] IS NULL OR round(scores[1] - scores[2], 9) >= 0.03 THEN 'high_single_domain' ELSE 'ambiguous_two_domains' END AS confidence FROM r""")
def domain_routing(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").where(F.col("vec_id") % EVERY == 0)
    cents = F.broadcast(_centroids(spark, folder).select(F.col("label").cast("string").alias("domain"), "centroid"))  # a row a domain
    scores = vectors.crossJoin(cents).select(F.col("vec_id").alias("query_id"), "domain", F.round(search.cosine(F.col("embedding"), F.col("centroid")), 6).alias("score"))
    return fusion.route_domains(scores)


RULES = [("alpha", ["a", "b"], [r"\bthe\b", r"\bof\b", r"\bthat\b"]), ("beta", ["b"], [r"\bwith\b", r"\bTHE\b"]), ("gamma", ["c"], [r"\bwas\b", r"\bare\b", r"\bas\b"])]
_RULES = ", ".join(f"('{n}', {d}, [{', '.join(f"'{p.lower()}'" for p in ps)}])" for n, d, ps in RULES)


@query(f"""WITH rules(file_name, rule_domains, patterns) AS (VALUES {_RULES}),
q AS (SELECT item_id AS query_id, lower(text) AS text, CASE item_id % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['b', 'c'] ELSE ['c'] END AS domains FROM benchmark),
s AS (SELECT query_id, file_name, len(list_filter(patterns, lambda p: regexp_matches(text, p))) AS score FROM q, rules WHERE list_has_any(domains, rule_domains)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_name) AS r FROM s WHERE score >= 1 QUALIFY r <= 2),
n AS (SELECT query_id, list(file_name ORDER BY r) AS names FROM k GROUP BY query_id)
SELECT query_id, coalesce(names, []::VARCHAR[]) AS file_names, CASE coalesce(len(names), 0) WHEN 0 THEN 'no_source_filter' WHEN 1 THEN 'high_single_source' ELSE 'multi_source' END AS confidence
FROM q LEFT JOIN n USING (query_id)""")
def source_routing_rules(spark: SparkSession, folder: str) -> DataFrame:
    lists = [F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c")), F.array(F.lit("c"))]
    domains = F.when(F.col("item_id") % 3 == 0, lists[0]).when(F.col("item_id") % 3 == 1, lists[1]).otherwise(lists[2])
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text", domains.alias("domains"))
    return fusion.route_sources(queries, spark.createDataFrame(RULES, "file_name string, domains array<string>, patterns array<string>"))


@query(f"WITH {_SPARSE.split(', sparse AS')[0]} SELECT doc_id AS id, list(term ORDER BY term) AS terms, round(sum(w), 6) AS mass FROM weights WHERE r <= {DOC_TERMS} GROUP BY doc_id")
def sparse_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = weighted(spark, folder, DOC_TERMS)
    return rows.select("id", F.array_sort(F.map_keys("weights")).alias("terms"), F.round(F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, x: s + x), 6).alias("mass"))


@query(f"WITH {_SPARSE.split(', sparse AS')[0]} SELECT doc_id AS id, list(term ORDER BY term) AS terms FROM weights WHERE r <= 16 GROUP BY doc_id")
def sparse_prune(spark: SparkSession, folder: str) -> DataFrame:
    return weighted(spark, folder, 16).select("id", F.array_sort(F.map_keys("weights")).alias("terms"))


@query(f"WITH {_SPARSE} SELECT * FROM sparse")
def sparse_topk(spark: SparkSession, folder: str) -> DataFrame:
    return sparse(spark, folder)


@query(f"WITH {_DENSE.replace('FILTER_', '')}, {_SPARSE}, {_FUSED} SELECT * FROM fused")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return fused(spark, folder).select("query_id", "id", "rrf_score", "dense_rank", "sparse_rank", "fused_rank")


@query(f"WITH {_DENSE.replace('FILTER_', '')}, {_SPARSE}, {_FUSED}, {_KEPT}, {_PARENTS} SELECT query_id, parent_id, child_ids FROM parents")
def parent_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return parents(spark, folder).select("query_id", "parent_id", "child_ids")


@query(f"WITH {_DENSE.replace('FILTER_', '')}, {_SPARSE}, {_FUSED}, {_KEPT}, {_PARENTS} SELECT query_id, parent_id, best_score, parent_rank FROM parents")
def parent_rank_best_child(spark: SparkSession, folder: str) -> DataFrame:
    return parents(spark, folder).select("query_id", "parent_id", "best_score", "parent_rank")


@query(f"""WITH q AS (SELECT item_id, list_distinct({TERMS.format('text')}) AS terms FROM benchmark), d AS (SELECT doc_id, list_distinct({TERMS.format('text')}) AS terms FROM documents),
t AS (SELECT item_id, unnest(terms) AS term FROM q), u AS (SELECT doc_id, unnest(terms) AS term FROM d), s AS (SELECT item_id, doc_id, count(*) AS n FROM t JOIN u USING (term) GROUP BY ALL),
a AS (SELECT item_id AS query_id, doc_id AS id, round(coalesce(n, 0)::DOUBLE / greatest(1, least(len(q.terms), len(d.terms))), 6) AS score FROM q CROSS JOIN d LEFT JOIN s USING (item_id, doc_id))
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM a QUALIFY rank <= 8""")
def rerank_overlap_topk(spark: SparkSession, folder: str) -> DataFrame:
    terms = T.lexical_terms(F.col("text"))
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    return search.overlap_topk(queries, table(spark, folder, "documents").select(F.col("doc_id").alias("id"), terms.alias("terms")), 8)


@query("""SELECT source, doc_id, used FROM (
  SELECT source, doc_id, row_number() OVER w AS r, (sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
WHERE r = 1 OR used <= 60000""")
def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    return fusion.prefix_within(docs, F.col("n"), fusion.CONTEXT, "source", order="doc_id").select("source", "doc_id", "used")


@query("""SELECT doc_id // 5 AS parent_id, arg_min(source, doc_id) AS file_name, list_sort(list_distinct(list(doc_id % 7))) AS pages, min(doc_id) AS row_start, max(doc_id) AS row_end,
  '[' || doc_id // 5 || '] ' || arg_min(source, doc_id) || ' | ' || min(lang) || ' | pages ' || array_to_string(list_sort(list_distinct(list(doc_id % 7))), ', ') || ' | rows ' || min(doc_id) || '-' || max(doc_id) AS label
FROM documents GROUP BY doc_id // 5""")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    child = F.struct("doc_id", F.col("source").alias("file_name"), F.array(F.col("doc_id") % 7).alias("pages"), F.array("doc_id").alias("rows"))
    docs = table(spark, folder, "documents").groupBy(F.floor(F.col("doc_id") / 5).alias("parent_id"))
    rows = docs.agg(fusion.citation(F.array_sort(F.collect_list(child))).alias("c"), F.min("lang").alias("section")).select("parent_id", "section", "c.*")
    label = T.source_label(F.col("parent_id"), F.col("file_name"), F.col("section"), F.col("pages"), F.col("rows"))
    return rows.select("parent_id", "file_name", "pages", F.array_min("rows").alias("row_start"), F.array_max("rows").alias("row_end"), label.alias("label"))


@query("""SELECT doc_id // 10 AS parent_id, list_transform(list_sort(list({'pos': pos, 'lang': lang}))[1:3], lambda x: x.lang) AS assets FROM (
  SELECT doc_id // 10 AS doc_id_, lang, min(doc_id) AS pos, min(doc_id) AS doc_id FROM documents GROUP BY doc_id // 10, lang) GROUP BY doc_id // 10""")
def asset_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.array("lang").alias("v")))), lambda s: s["v"])
    return table(spark, folder, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("parent_id")).agg(fusion.distinct_in_order(ordered, 3).alias("assets"))


@query(f"""SELECT source, doc_id, nth, used FROM (
  SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS nth, sum({COUNT.format('text')}) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents)
WHERE nth <= 64 AND (nth = 1 OR used <= 28000)""")
def safe_batches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", "doc_id", T.token_count(F.col("text")).alias("n"))
    return fusion.safe_batch(docs, F.col("n"), 64, 28_000, "source", order="doc_id").select("source", "doc_id", F.col("nth").cast("int").alias("nth"), "used")


@query(f"""WITH {_DENSE.replace('FILTER_', '')}, {_SPARSE}, {_FUSED}, {_KEPT}, {_PARENTS},
blocks AS (SELECT k.query_id, k.parent_id, sum(length(d.text))::BIGINT AS n FROM kept k JOIN documents d ON d.doc_id = k.id GROUP BY ALL),
run AS (SELECT p.query_id, p.parent_id, p.child_ids, p.best_score, p.parent_rank, sum(n) OVER (PARTITION BY p.query_id ORDER BY parent_rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM parents p JOIN blocks USING (query_id, parent_id))
SELECT *, '[' || parent_rank || '] parent ' || parent_id AS label FROM run WHERE parent_rank = 1 OR used <= 60000""")
def hybrid_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Dense and sparse search, fusion, parents with their best children, and the context that fits the budget, for a whole query set."""
    docs = table(spark, folder, "documents")
    parent_of = docs.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 5).alias("parent_id"), F.length("text").cast("long").alias("n"))
    blocks = fusion.expand_parents(fused(spark, folder), parent_of, totals=("n",))
    kept = fusion.within_budget(blocks, F.col("n"), fusion.CONTEXT, "query_id", order="parent_rank")
    label = F.concat(F.lit("["), "parent_rank", F.lit("] parent "), "parent_id")
    return kept.select("query_id", "parent_id", "child_ids", "best_score", "parent_rank", "used", label.alias("label"))


@query(f"""WITH {_DENSE.replace('FILTER_', '')}, {_SPARSE}, {_FUSED}, {_KEPT}, {_PARENTS},
texts AS (SELECT doc_id // 5 AS parent_id, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
pairs AS (SELECT p.query_id, p.parent_id, p.child_ids, p.best_score, list_distinct({TERMS.format('q.text')}) AS a, list_distinct({TERMS.format('t.text')}) AS b FROM parents p JOIN texts t USING (parent_id) JOIN documents q ON q.doc_id = p.query_id),
scored AS (SELECT query_id, parent_id, child_ids, best_score, CASE WHEN least(len(a), len(b)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) END AS relevance FROM pairs)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, parent_id))::INT AS rank FROM scored QUALIFY rank <= 8""")
def retrieved_parents(spark: SparkSession, folder: str) -> DataFrame:
    """``plans.retrieve`` for a query set: both searches, each on the table of its rows, fusion, parents with their best children, and the rerank of their texts."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 5).alias("parent_id"), "text")
    queries = docs.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "text")
    near = dense(spark, folder).join(queries.select("query_id"), "query_id", "left_semi")  # a query is a document
    heads = docs.groupBy("parent_id").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.col("id"))).alias("text"))
    return answers({"dense": near, "sparse": sparse(spark, folder)}, queries, docs, heads)
