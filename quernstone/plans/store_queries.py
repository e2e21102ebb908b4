"""Queries on stored state, surveys, structure, images and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.ids import stable_id
from quernstone.operators import elements, images, quality, store, survey
from quernstone.plans.registry import UUID5, query
from quernstone.sources import html
from quernstone.sources.tables import table

# ---- stored state


def _old_chunks(docs: DataFrame) -> DataFrame:
    """A stored state: every document but each eleventh, an older text for each seventh, a vector for most."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    vector = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("double"))
    return docs.where(F.col("doc_id") % 11 != 0).select("doc_id", F.sha2(text, 256).alias("hash"), F.col("lang").alias("status"), vector.alias("vector"), F.when(vector.isNotNull(), "m1").alias("model"))


_OLD = """old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'old ' || text ELSE text END) AS hash, lang AS status,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id::DOUBLE END AS vector, CASE WHEN doc_id % 5 <> 0 THEN 'm1' END AS model FROM documents WHERE doc_id % 11 <> 0)"""


@query(f"""WITH {_OLD}, new AS (SELECT doc_id, sha256(text) AS hash, 'new' AS status FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, coalesce(new.hash, old.hash) AS hash, coalesce(new.status, old.status) AS status,
  CASE WHEN new.doc_id IS NULL OR old.hash IS NOT DISTINCT FROM new.hash THEN vector END AS vector, CASE WHEN new.doc_id IS NULL OR old.hash IS NOT DISTINCT FROM new.hash THEN model END AS model
FROM old FULL JOIN new ON old.doc_id = new.doc_id""")
def upsert_invalidate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    new = docs.where(F.col("doc_id") % 3 != 0).select("doc_id", F.sha2("text", 256).alias("hash"), F.lit("new").alias("status"))
    return store.upsert_invalidating(_old_chunks(docs), new, ["doc_id"], "hash", ["vector", "model"])


@query("""WITH n AS (SELECT c_custkey AS k, c_name || '!' AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 10 = 0)
SELECT coalesce(k, c_custkey) AS c_custkey, coalesce(name, c_name) AS c_name, coalesce(CASE WHEN c_custkey IS NULL THEN bal END, c_acctbal) AS c_acctbal FROM customer FULL JOIN n ON c_custkey = k""")
def upsert_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A merge that keeps one column where the key exists, as status and creation time are kept."""
    old = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = old.where(F.col("c_custkey") % 2 == 0).select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    added = old.where(F.col("c_custkey") % 10 == 0).withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return store.upsert(old, changed.unionByName(added), ["c_custkey"], keep=("c_acctbal",))


@query("SELECT doc_id, lang, source FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL OR label IS DISTINCT FROM doc_id % 10")
def pending_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "documents").join(table(spark, folder, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left")
    other = ~F.col("label").eqNullSafe((F.col("doc_id") % 10).cast("int"))
    return chunks.where(F.col("embedding").isNull() | other).select("doc_id", "lang", "source")


@query("""SELECT count(*) FILTER (WHERE trim(text) <> '') AS total, count(*) FILTER (WHERE vec_id IS NOT NULL) AS completed, count(*) FILTER (WHERE trim(text) <> '' AND vec_id IS NULL) AS pending
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def index_progress(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "documents").join(table(spark, folder, "embeddings").select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left")
    return store.progress(chunks, F.col("vec_id").isNotNull(), F.btrim("text") != "")


@query("""SELECT DISTINCT lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c LEFT JOIN labels l USING (doc_id)
  WHERE c.source = d.source AND c.lang = d.lang AND coalesce(l.toxic, 0) = 1)""")
def documents_indexed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("key", F.concat_ws(":", "lang", "source"))
    chunks = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    return store.with_all(docs.select("key", "lang", "source").distinct(), chunks, "key", F.coalesce("toxic", F.lit(0)) == 1).select("lang", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def documents_chunked(spark: SparkSession, folder: str) -> DataFrame:
    return store.with_any(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id").select("doc_id", "source")


@query(f"SELECT c_custkey, {UUID5.format("'n:' || n_name || ':' || c_custkey")} AS chunk_id, n_name, c_name || ' (' || n_name || ')' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def profile_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", stable_id(F.lit("n"), F.col("n_name"), F.col("c_custkey")).alias("chunk_id"), "n_name", F.concat("c_name", F.lit(" ("), "n_name", F.lit(")")).alias("text"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k, event_type FROM events")
def parse_json_props(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")


@query("SELECT event_id, props[:-2] || ',\"parse_error\":\"failed: ' || event_type || '\"}' AS props FROM (SELECT event_id, event_type, replace(props, ' ', '') AS props FROM events)")
def json_set(spark: SparkSession, folder: str) -> DataFrame:
    props = store.json_set(F.col("props"), "parse_error", F.substring(F.concat(F.lit("failed: "), "event_type"), 1, 2000))
    return table(spark, folder, "events").select("event_id", props.alias("props"))


# ---- surveys: users are facilities, event types are measures

_MEASURES = {"view": "H_COMP_1_A", "signup": "H_DOCTOR_X", "purchase": "H_CLEAN_HSP", "error": "H_HSP_RATING", "click": "H_RECMND_DY"}


def _records(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value").cast("int").cast("string")
    measure = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in _MEASURES.items() for x in kv]), F.col("event_type")), F.lit("_"), F.col("event_id") % 4)
    return table(spark, folder, "events").select(
        F.concat(F.lit("F"), "user_id").alias("facility_id"), F.col("event_id").alias("source_row_number"), measure.alias("measure_id"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("How | "), "event_type")).alias("question"),
        F.when(F.col("event_id") % 3 == 0, value).otherwise("Not Applicable").alias("star_rating"), F.when(F.col("event_id") % 3 == 1, value).alias("answer_percent"),
        F.when(F.col("event_id") % 7 != 2, value).otherwise(" ").alias("linear_mean_value"),
        F.concat(F.lit("Hospital "), "user_id").alias("facility_name"), F.lit("1 Street").alias("address"), F.lit("Town").alias("city"), F.lit("ST").alias("state"), F.lit("00001").alias("zip_code"),
        value.alias("completed_surveys"), F.lit(None).cast("string").alias("response_rate_percent"), F.lit("7/1/2024").alias("survey_start_date"), F.lit("06/30/2025").alias("survey_end_date"),
    )


_RECORDS = """rec AS (
  SELECT *, 'F' || user_id AS facility_id, CASE event_type WHEN 'view' THEN 'H_COMP_1_A' WHEN 'signup' THEN 'H_DOCTOR_X' WHEN 'purchase' THEN 'H_CLEAN_HSP' WHEN 'error' THEN 'H_HSP_RATING' ELSE 'H_RECMND_DY' END || '_' || event_id % 4 AS measure_id,
    trunc(value)::INT::VARCHAR AS v, CASE WHEN event_id % 5 <> 0 THEN 'How | ' || event_type END AS question FROM events
), shown AS (
  SELECT *, coalesce(question, measure_id) AS q,
    CASE event_type WHEN 'view' THEN 'nurse_communication' WHEN 'signup' THEN 'doctor_communication' WHEN 'purchase' THEN 'hospital_environment' ELSE 'overall_rating_and_recommendation' END AS category,
    CASE WHEN event_id % 3 = 0 AND v IS NOT NULL THEN 'star rating' WHEN event_id % 3 = 1 AND v IS NOT NULL THEN 'answer percent' WHEN event_id % 7 <> 2 AND v IS NOT NULL THEN 'linear mean' ELSE 'result' END AS result_type,
    CASE WHEN event_id % 3 = 0 AND v IS NOT NULL THEN v WHEN event_id % 3 = 1 AND v IS NOT NULL THEN v || '%' WHEN event_id % 7 <> 2 AND v IS NOT NULL THEN v ELSE 'Not available' END AS result FROM rec)"""


@query(f"WITH {_RECORDS} SELECT event_id AS source_row_number, result_type, result FROM shown")
def result_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    result = survey.row_result(F.col("star_rating"), F.col("answer_percent"), F.col("linear_mean_value"))
    return _records(spark, folder).select("source_row_number", result.alias("r")).select("source_row_number", "r.*")


@query(f"WITH {_RECORDS} SELECT event_id AS source_row_number, measure_id, category FROM shown")
def measure_category(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("source_row_number", "measure_id", survey.measure_category(F.col("measure_id")).alias("category"))


_LINE = r"""'| ' || measure_id || ' | ' || replace(q, '|', '\|') || ' | ' || result_type || ' | ' || result || ' |'"""


@query(f"""WITH {_RECORDS} SELECT facility_id, category, {UUID5.format("'doc:' || facility_id || ':' || category")} AS category_doc_id,
  sha256('| Measure ID | Measure | Result type | Result |' || chr(10) || '|---|---|---|---:|' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY event_id)) AS table_digest,
  sha256(string_agg('- ' || q || ': ' || result, chr(10) ORDER BY event_id)) AS lines_digest, list(measure_id ORDER BY event_id) AS measure_ids, list(event_id ORDER BY event_id) AS source_row_numbers
FROM shown GROUP BY facility_id, category""")
def survey_category_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs = survey.category_docs(_records(spark, folder), "doc")
    return docs.select("facility_id", "category", "category_doc_id", F.sha2("table_markdown", 256).alias("table_digest"), F.sha2("lines", 256).alias("lines_digest"), "measure_ids", "source_row_numbers")


@query(f"""WITH {_RECORDS}, m AS (SELECT facility_id, category, measure_id, arg_max(result, event_id) AS result FROM shown GROUP BY ALL),
p AS (SELECT facility_id, list(category || '/' || measure_id || '=' || result ORDER BY category, measure_id) AS summary FROM m GROUP BY facility_id)
SELECT facility_id, {UUID5.format("'doc:' || facility_id || ':profile'")} AS profile_id, arg_min(coalesce(v, ''), event_id) AS completed_surveys, count(*)::INT AS measure_count,
  DATE '2024-07-01' AS survey_start_date, DATE '2025-06-30' AS survey_end_date, any_value(summary) AS summary FROM shown JOIN p USING (facility_id) GROUP BY facility_id""")
def survey_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = survey.profiles(_records(spark, folder), "doc")
    lines = lambda c: F.transform(F.map_entries(c["value"]), lambda m: F.concat(c["key"], F.lit("/"), m["key"], F.lit("="), m["value"]["result"]))
    summary = F.array_sort(F.flatten(F.transform(F.map_entries("category_summaries"), lines)))
    return rows.select("facility_id", "profile_id", F.coalesce("completed_surveys", F.lit("")).alias("completed_surveys"), "measure_count", "survey_start_date", "survey_end_date", summary.alias("summary"))


@query("""WITH e AS (SELECT user_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS starts FROM events)
SELECT user_id, event_type, count(*) FILTER (WHERE starts) AS runs FROM e GROUP BY user_id, event_type""")
def contiguity_check(spark: SparkSession, folder: str) -> DataFrame:
    return survey.contiguity(table(spark, folder, "events"), "event_type", "event_id", ["user_id"])


# ---- structure


@query()
def html_elements(spark: SparkSession, folder: str) -> DataFrame:
    return html.elements(table(spark, folder, "pages"))


@query("""SELECT page_id, len(regexp_extract_all(h, '<h1[ >]'))::BIGINT AS headings, len(regexp_extract_all(h, '<p[ >]'))::BIGINT AS paragraphs, len(regexp_extract_all(h, '<ul[ >]'))::BIGINT AS lists
FROM (SELECT page_id, regexp_replace(html, '(?s)<(script|style)[ >].*?</(script|style)>', '', 'g') AS h FROM pages)""")
def html_tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = html.elements(table(spark, folder, "pages"), keep_empty=True)
    counts = found.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(n) for t, n in (("h1", "headings"), ("p", "paragraphs"), ("ul", "lists"))])
    none = F.lit(0).cast("long")
    return table(spark, folder, "pages").select("page_id").join(counts, "page_id", "left").select("page_id", *[F.coalesce(c, none).alias(c) for c in ("headings", "paragraphs", "lists")])


_LEVELS = "CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 END"


@query(f"""WITH l AS (SELECT conv_id, turn, {_LEVELS} AS level, text AS title FROM conversations), s AS (
  SELECT *, last_value(CASE WHEN level <= 1 THEN {{'l': level, 't': title}} END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN level <= 2 THEN {{'l': level, 't': title}} END IGNORE NULLS) OVER w AS b
  FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, list_filter([CASE WHEN a.l = 1 THEN a.t END, CASE WHEN b.l = 2 THEN b.t END], lambda x: x IS NOT NULL) AS section_path FROM s""")
def html_heading_path(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)
    return elements.section_paths(turns, ["conv_id"], "turn", level, F.col("text")).select("conv_id", "turn", "section_path")


@query("""SELECT conv_id, bool_or(role = 'system') AS has_table, bool_or(text LIKE '%|%') AS has_parse_concerns, sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END)::BIGINT AS text_chars,
  sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END) < 250 AS low_text FROM conversations GROUP BY conv_id""")
def page_signals(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "table").when(F.col("role") == "user", "header").otherwise("text")
    return elements.page_signals(table(spark, folder, "conversations"), ["conv_id"], F.col("text"), kind, F.col("text").contains("|"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN event_type <> 'error' THEN round(value, 0) END, 'inf'::DOUBLE), event_type = 'view', event_id)::INT AS position FROM events""")
def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    y = F.when(F.col("event_type") != "error", F.round("value", 0))
    return elements.reading_order(table(spark, folder, "events"), ["user_id"], y, F.col("event_type") == "view", "event_id").select("user_id", "event_id", "position")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role <> 'user' THEN nullif(trim(text), '') END AS x FROM conversations)
SELECT conv_id, turn, last_value(x IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS text_before,
  first_value(x IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS text_after FROM t""")
def neighbor_context(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return elements.neighbours(turns, ["conv_id"], "turn", F.when(F.col("role") != "user", F.col("text"))).select("conv_id", "turn", "text_before", "text_after")


# ---- images: boxes made of line items' whole numbers


def _images(spark: SparkSession, folder: str) -> DataFrame:
    q, k = F.col("l_quantity"), F.col("l_partkey")
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"), (F.col("l_orderkey") % 500).alias("page"), (k % 700).alias("hash"),
        F.when(k % 2 == 0, "embedded").otherwise("layout").alias("category"), F.concat(F.lit("img_"), F.when(k % 3 == 0, "table").otherwise("x"), F.lit("_p1")).alias("name"),
        (k % 10 * 10.0).alias("x"), (F.col("l_suppkey") % 10 * 10.0).alias("y"), (q * 2 + 100).alias("w"), (q + 100).alias("h"), ((q * 2 + 100) * (q + 100)).alias("area"),
    )


_IMAGES = """img AS (SELECT l_orderkey * 10 + l_linenumber AS image_id, l_orderkey % 500 AS page, l_partkey % 700 AS hash, CASE WHEN l_partkey % 2 = 0 THEN 'embedded' ELSE 'layout' END AS category,
  l_partkey % 3 = 0 AS informative, l_partkey % 10 * 10.0::DOUBLE AS x, l_suppkey % 10 * 10.0::DOUBLE AS y, l_quantity * 2 + 100 AS w, l_quantity + 100 AS h, (l_quantity * 2 + 100) * (l_quantity + 100) AS area FROM lineitem)"""


@query(f"WITH {_IMAGES} SELECT hash, count(DISTINCT page) AS n_pages FROM img GROUP BY hash HAVING count(DISTINCT page) >= 3")
def image_repeat_reject(spark: SparkSession, folder: str) -> DataFrame:
    return images.repeated(_images(spark, folder))


@query(f"WITH {_IMAGES} SELECT hash, image_id, category, area FROM img QUALIFY row_number() OVER (PARTITION BY hash ORDER BY category = 'embedded' DESC, informative DESC, area DESC, image_id) = 1")
def image_duplicate_keep(spark: SparkSession, folder: str) -> DataFrame:
    return images.best_duplicate(_images(spark, folder)).select("hash", "image_id", "category", "area")


@query(f"WITH {_IMAGES} SELECT page, image_id, area FROM img WHERE category = 'layout' QUALIFY row_number() OVER (PARTITION BY page ORDER BY area DESC, image_id) <= 4")
def image_page_cap(spark: SparkSession, folder: str) -> DataFrame:
    return images.page_cap(_images(spark, folder).where("category = 'layout'")).select("page", "image_id", "area")


@query(f"""WITH {_IMAGES} SELECT a.image_id, a.page FROM img a WHERE a.category = 'layout' AND EXISTS (SELECT 1 FROM img b WHERE b.category = 'embedded' AND b.page = a.page AND a.w * a.h / (b.w * b.h) BETWEEN 0.7 AND 1.4
  AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) >= 0.9)""")
def bbox_overlap_reject(spark: SparkSession, folder: str) -> DataFrame:
    rows = _images(spark, folder)
    return images.covered(rows.where("category = 'layout'"), rows.where("category = 'embedded'"))


def _score_inputs() -> tuple[Column, ...]:
    gap, distance = F.when(F.col("l_partkey") % 5 != 0, (F.col("l_suppkey") % 6).cast("double")), F.when(F.col("l_partkey") % 3 != 0, F.col("l_extendedprice") / 50)
    return gap, F.coalesce(gap == 0, F.lit(False)), distance, F.col("l_linenumber").cast("double"), F.col("l_discount"), F.col("l_returnflag") == "R"


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN g = 0 THEN 0 WHEN g IS NULL THEN 80 ELSE 160 + 20 * g END + CASE WHEN d IS NULL THEN 20 ELSE least(d / 40, 50) END + least(3 * l_linenumber, 60)
  - least(50 * l_discount, 50) - CASE WHEN l_returnflag = 'R' THEN 12 ELSE 0 END, 6) AS score
FROM (SELECT *, CASE WHEN l_partkey % 5 <> 0 THEN (l_suppkey % 6)::DOUBLE END AS g, CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice / 50 END AS d FROM lineitem)""")
def image_child_score(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(images.child_misfit(*_score_inputs()), 6).alias("score"))


# ---- evaluation: labels are scores


def _traces(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    quality_ = F.when(F.col("doc_id") % 17 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 19 == 0, F.lit(float("inf"))).otherwise(F.col("quality").cast("double"))
    return rows.select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("lang")).otherwise(F.when(F.col("doc_id") % 2 == 0, "")).alias("domain"), quality_.alias("quality"), F.col("toxic").cast("double").alias("toxic"))


_TRACES = """tr AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN lang WHEN doc_id % 2 = 0 THEN '' END AS domain,
  CASE WHEN doc_id % 17 <> 0 AND doc_id % 19 <> 0 THEN quality::DOUBLE END AS quality, toxic::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id))"""
_AVERAGES = "count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic"


def _averages(rows: DataFrame, by: Column | None = None) -> DataFrame:
    found = quality.metric_averages(rows, {"quality": F.col("quality"), "toxic": F.col("toxic")}, by)
    return found.withColumns({c: F.round(c, 6) for c in ("quality", "toxic")})


@query(f"WITH {_TRACES} SELECT {_AVERAGES} FROM tr")
def metric_averages(spark: SparkSession, folder: str) -> DataFrame:
    return _averages(_traces(spark, folder))


@query(f"WITH {_TRACES} SELECT coalesce(nullif(domain, ''), 'unknown') AS key, {_AVERAGES} FROM tr GROUP BY 1")
def grouped_metric_averages(spark: SparkSession, folder: str) -> DataFrame:
    return _averages(_traces(spark, folder), F.col("domain"))


@query(f"WITH {_TRACES} SELECT domain IS DISTINCT FROM 'fr' AS in_scope, {_AVERAGES} FROM tr GROUP BY 1")
def in_out_scope(spark: SparkSession, folder: str) -> DataFrame:
    rows = _averages(_traces(spark, folder).withColumn("scope", quality.in_scope(F.col("domain"), "fr").cast("string")), F.col("scope"))
    return rows.select((F.col("key") == "true").alias("in_scope"), "n", "quality", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 4 <> 0)")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """A trace is done if it has all metrics, of which one may be null."""
    labels = table(spark, folder, "labels")
    all_, some = F.create_map(F.lit("quality"), "quality", F.lit("toxic"), F.lit(None).cast("int")), F.create_map(F.lit("quality"), F.col("quality"))
    traces = labels.withColumn("scores", F.when(F.col("doc_id") % 4 != 0, all_).otherwise(some))
    done = traces.where(quality.completed(F.col("scores"), ("quality", "toxic")))
    return table(spark, folder, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::BIGINT AS worker FROM documents")
def round_robin_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return quality.round_robin(table(spark, folder, "documents").select("doc_id"), "doc_id", 7).select("doc_id", F.col("worker").cast("long").alias("worker"))
