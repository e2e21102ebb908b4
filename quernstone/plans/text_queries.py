"""Queries on identity, text, packing and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernstone.functions import ids
from quernstone.functions import text as T
from quernstone.operators import chunking, elements, normalize, quality, tables
from quernstone.operators import document_chunks as documents
from quernstone.plans.registry import CLEAN, COUNT, TERMS, TOKENS, UUID5, query
from quernstone.sources.tables import table
from quernstone.storage import small_batches


@query(f"SELECT doc_id, {UUID5.format('source')} AS source_id, {UUID5.format("lang || ':text:' || lower(source) || ':' || doc_id")} AS document_id FROM documents")
def doc_uuid5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", ids.uuid5(F.col("source")).alias("source_id"), ids.stable_id(F.col("lang"), F.lit("text"), F.lower("source"), F.col("doc_id")).alias("document_id"))


@query("SELECT doc_id, sha256(lower(text) || chr(10) || 'Images:' || chr(10) || 'a.png' || chr(10) || source || '.png') AS fingerprint FROM documents")
def content_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    images = F.array(F.concat("source", F.lit(".png")), F.lit("a.png"))
    return docs.select("doc_id", ids.chunk_fingerprint(F.col("text"), images).alias("fingerprint"))


@query(f"SELECT doc_id, sha256(lower({CLEAN.format('text')})) AS content_hash FROM documents")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", ids.content_hash(T.clean_text(F.col("text"))).alias("content_hash"))


@query("SELECT doc_id, sha256('v1' || text || source || sha256(source) || lang || sha256(lang)) AS input_hash FROM documents")
def embedding_input_hash(spark: SparkSession, folder: str) -> DataFrame:
    image = lambda c: F.struct(F.col(c).alias("path"), F.sha2(F.col(c), 256).alias("sha256"))
    return table(spark, folder, "documents").select("doc_id", ids.embedding_input_hash(F.col("text"), F.array(image("source"), image("lang")), "v1").alias("input_hash"))


@query(f"SELECT doc_id, length({CLEAN.format('text')})::INT AS n_chars, md5({CLEAN.format('text')}) AS digest FROM documents")
def clean_text_stats(spark: SparkSession, folder: str) -> DataFrame:
    clean = T.clean_text(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.length(clean).alias("n_chars"), F.md5(clean).alias("digest"))


@query(f"SELECT doc_id, len({TOKENS.format('text')})::INT AS n_tokens, {COUNT.format('text')} AS token_count, array_to_string({TOKENS.format('text')}, '') = text AS whole FROM documents")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs, found = table(spark, folder, "documents"), T.tokens(F.col("text"))
    return docs.select("doc_id", F.size(found).alias("n_tokens"), T.token_count(F.col("text")).alias("token_count"), (T.decode_tokens(found) == F.col("text")).alias("whole"))


@query(f"SELECT doc_id, list_sort(list_distinct({TERMS.format('text')})) AS terms FROM documents")
def lexical_terms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.array_sort(T.lexical_terms(F.col("text"))).alias("terms"))


@query(f"""
WITH t AS (SELECT conv_id, turn, list_distinct({TERMS.format('text')}) AS terms FROM conversations),
p AS (SELECT conv_id, turn, terms, lag(terms) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT conv_id, turn, round(CASE WHEN least(len(terms), len(before)) = 0 THEN 0 ELSE len(list_intersect(terms, before))::DOUBLE / least(len(terms), len(before)) END, 6) AS overlap
FROM p WHERE before IS NOT NULL""")
def lexical_overlap(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", T.lexical_terms(F.col("text")).alias("terms"))
    turns = turns.withColumn("before", F.lag("terms").over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("before").isNotNull())
    return turns.select("conv_id", "turn", F.round(T.term_overlap(F.col("terms"), F.col("before")), 6).alias("overlap"))


_SENTENCES = f"string_split(regexp_replace({CLEAN.format('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT doc_id, len({_SENTENCES})::INT AS n_sentences, sha256(array_to_string({_SENTENCES}, chr(10))) AS digest FROM documents")
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    found = T.sentences(T.clean_text(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", F.size(found).alias("n_sentences"), F.sha2(F.array_join(found, "\n"), 256).alias("digest"))


_PIECES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {CLEAN.format('text')} AS text FROM documents),
sents AS (
  SELECT doc_id, unnest({_SENTENCES}) AS s, generate_subscripts({_SENTENCES}, 1) AS k, {COUNT.format('text')} <= LIMIT AS whole, text FROM docs WHERE text <> ''
), units AS (
  SELECT doc_id, k, 0 AS w, s AS u, {COUNT.format('s')} AS n, false AS long FROM sents WHERE NOT whole AND {COUNT.format('s')} <= LIMIT
  UNION ALL
  SELECT doc_id, k, w, u, {COUNT.format('u')} AS n, true FROM (
    SELECT doc_id, k, unnest(string_split(s, ' ')) AS u, generate_subscripts(string_split(s, ' '), 1) AS w FROM sents WHERE NOT whole AND {COUNT.format('s')} > LIMIT)
), items AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, w) AS i FROM units),
fold AS (
  SELECT doc_id, i, u, n, k, long, 0 AS piece, n AS cur FROM items WHERE i = 1
  UNION ALL
  SELECT t.doc_id, t.i, t.u, t.n, t.k, t.long,
         CASE WHEN f.cur + t.n > LIMIT OR (t.k <> f.k AND (t.long OR f.long)) THEN f.piece + 1 ELSE f.piece END,
         CASE WHEN f.cur + t.n > LIMIT OR (t.k <> f.k AND (t.long OR f.long)) THEN t.n ELSE f.cur + t.n END
  FROM fold f JOIN items t ON t.doc_id = f.doc_id AND t.i = f.i + 1
), pieces AS (
  SELECT doc_id, piece, string_agg(u, ' ' ORDER BY i) AS text FROM fold GROUP BY doc_id, piece
  UNION ALL SELECT doc_id, 0, text FROM docs WHERE text <> '' AND {COUNT.format('text')} <= LIMIT
)
SELECT doc_id, piece::INT AS piece, {COUNT.format('text')} AS n_tokens, sha256(text) AS digest FROM pieces"""


def _pieces(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(T.split_pieces(F.col("text"), limit)).alias("piece", "text"))
    return docs.select("doc_id", "piece", T.token_count(F.col("text")).alias("n_tokens"), F.sha2("text", 256).alias("digest"))


@query(_PIECES.replace("LIMIT", str(T.PIECE_MAX)))
def greedy_text_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, T.PIECE_MAX)


@query(_PIECES.replace("LIMIT", "40"))
def word_fallback_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """A limit so small that many sentences are packed word by word."""
    return _pieces(spark, folder, 40)


_PACK = f"""
WITH RECURSIVE items AS (
  SELECT conv_id, turn, {COUNT.format('text')} AS n, role = 'system' AS is_table, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations
), fold AS (
  SELECT conv_id, turn, n, is_table, i, 0 AS part, n AS cur, (NOT is_table AND n < TARGET) AS open FROM items WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.n, t.is_table, t.i, CASE WHEN JOINS THEN f.part ELSE f.part + 1 END, CASE WHEN JOINS THEN f.cur + t.n ELSE t.n END,
         NOT t.is_table AND (CASE WHEN JOINS THEN f.cur + t.n ELSE t.n END) < TARGET
  FROM fold f JOIN items t ON t.conv_id = f.conv_id AND t.i = f.i + 1
)
"""


@query((_PACK + "SELECT conv_id, turn, n, part::INT AS part FROM fold").replace("JOINS", "f.cur + t.n <= 300").replace("TARGET", "1"))
def parent_packing(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.pack(table(spark, folder, "conversations"), "conv_id", "turn", T.token_count(F.col("text")), 300)


@query((_PACK + "SELECT conv_id, turn, n, is_table, part::INT AS part FROM fold").replace("JOINS", "(f.open AND NOT t.is_table AND f.cur + t.n <= 200)").replace("TARGET", "150"))
def child_packing(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.pack_children(table(spark, folder, "conversations"), "conv_id", "turn", T.token_count(F.col("text")), F.col("role") == "system", 200, 150)


def _fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of each field of a schema."""
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl).fields]


_PARENT = UUID5.format("conv_id || ':part ' || section || ':' || parent || ':'")
_CHUNKS = f"""
WITH RECURSIVE items AS (
  SELECT conv_id, turn, turn // 4 AS section, role = 'system' AS is_table, text, {COUNT.format('text')} AS n, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) AS i FROM conversations
), fold AS (
  SELECT conv_id, section, turn, is_table, text, i, 1 AS parent, n AS held, 1 AS child, CASE WHEN is_table THEN 0 ELSE n END AS filled, NOT is_table AND n < 150 AS open FROM items WHERE i = 1
  UNION ALL
  SELECT conv_id, section, turn, is_table, text, i, parent, held, CASE WHEN joins THEN base ELSE base + 1 END, CASE WHEN joins THEN was + n WHEN is_table THEN 0 ELSE n END, NOT is_table AND (CASE WHEN joins THEN was + n ELSE n END) < 150
  FROM (
    SELECT t.*, f.parent + (f.held + t.n > 300)::INT AS parent, CASE WHEN f.held + t.n > 300 THEN t.n ELSE f.held + t.n END AS held, CASE WHEN f.held + t.n > 300 THEN 0 ELSE f.child END AS base, f.filled AS was,
           NOT t.is_table AND f.open AND f.held + t.n <= 300 AND f.filled + t.n <= 200 AS joins
    FROM fold f JOIN items t ON t.conv_id = f.conv_id AND t.section = f.section AND t.i = f.i + 1)
), parents AS (
  SELECT conv_id, section, parent, {COUNT.format('text')} AS parent_tokens, {_PARENT} AS parent_id FROM (
    SELECT conv_id, section, parent, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') AS text FROM fold GROUP BY ALL)
), kids AS (
  SELECT conv_id, section, parent, child, {CLEAN.format("string_agg(CASE WHEN is_table THEN '' ELSE coalesce(text, '') END, chr(10) || chr(10) ORDER BY turn)")} AS body, max(CASE WHEN is_table THEN text END) AS grid,
         list_sort(list_distinct(list((turn % 3)::INT))) AS pages, list(conv_id || ':' || turn ORDER BY turn) AS element_ids FROM fold GROUP BY ALL
), made AS (
  SELECT *, concat_ws(chr(10), 'Domain: talk', 'Source: table', 'Section: part ' || section, CASE WHEN body <> '' THEN chr(10) || body END, CASE WHEN coalesce(grid, '') <> '' THEN chr(10) || grid END) AS whole FROM kids JOIN parents USING (conv_id, section, parent)
), merged AS (
  SELECT conv_id, sha256(lower(whole) || chr(10) || 'Images:') AS print, arg_min({{'whole': whole, 'body': body, 'grid': grid, 'parent_id': parent_id, 'section': section, 'parent': parent, 'child': child, 'parent_tokens': parent_tokens}}, section * 1000000 + parent * 1000 + child) AS own,
         list_sort(list_distinct(flatten(list(pages)))) AS page_numbers, list_sort(list_distinct(flatten(list(element_ids)))) AS element_ids, count(*) AS duplicate_occurrences,
         list(parent_id ORDER BY section, parent, child) AS all_parents
  FROM made GROUP BY conv_id, print
)
SELECT conv_id::VARCHAR AS document_id, {UUID5.format("own.parent_id || ':' || own.child")} AS chunk_id, own.parent_id AS parent_id, 'part ' || own.section AS section_title, own.parent::INT AS part_number, own.child::INT AS child_index, page_numbers, element_ids,
       list_filter([CASE WHEN own.body <> '' THEN 'text' END, CASE WHEN coalesce(own.grid, '') <> '' THEN 'table' END], lambda m: m IS NOT NULL) AS modalities, duplicate_occurrences, len(list_filter(list_distinct(all_parents), lambda p: p <> own.parent_id))::INT AS alternates,
       {COUNT.format('own.whole')} AS token_count, print AS fingerprint, own.parent_tokens AS parent_tokens, count(*) OVER (PARTITION BY own.parent_id) AS child_count
FROM merged"""


_LIMITS = documents.Limits(300, 200, 150)


def _talk(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of conversations: turns are elements, system turns are tables, four turns are a section."""
    names = ["element_id", "document_id", "sequence", "section_path", "element_type", "text", "table_markdown", "page_number"]
    turn, is_table = F.col("turn"), F.col("role") == "system"
    values = [
        F.concat_ws(":", "conv_id", "turn"), F.col("conv_id").cast("string"), turn.cast("double"), F.array(F.concat(F.lit("part "), F.floor(turn / 4))), F.when(is_table, "table").otherwise("text"), F.when(~is_table, F.col("text")), F.when(is_table, F.col("text")), (turn % 3).cast("int"),
    ]
    fixed = {"domain": F.lit("talk"), "source_type": F.lit("table"), "source_name": F.lit("table")}
    made = dict(zip(names, values, strict=True)) | fixed
    return table(spark, folder, "conversations").select(*[(made[n] if n in made else F.lit(None)).cast(kind).alias(n) for n, kind in _fields(documents.ELEMENT)])


@query(_CHUNKS)
def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Parents and children of conversations."""
    parents, children = documents.build(_talk(spark, folder), _LIMITS, split=False)
    rows = children.join(parents.select("parent_id", F.col("token_count").alias("parent_tokens"), "child_count"), "parent_id")
    return rows.select(
        "document_id", "chunk_id", "parent_id", "section_title", "part_number", "child_index", "page_numbers", "element_ids", "modalities", "duplicate_occurrences", F.size("alternate_parent_ids").alias("alternates"),
        "token_count", "fingerprint", "parent_tokens", "child_count",
    )


_REPORT = _CHUNKS[: _CHUNKS.rindex("SELECT conv_id::VARCHAR AS document_id")].rstrip() + f""", kept AS (
  SELECT conv_id, own.parent_id AS parent_id, coalesce(own.grid, '') <> '' AS has_table, {COUNT.format('own.whole')} AS n FROM merged
), own AS (
  SELECT conv_id, count(*) AS children, count(*) FILTER (WHERE has_table) AS table_chunks, count(*) FILTER (WHERE n > 100 AND NOT has_table) AS oversized_non_table, count(*) FILTER (WHERE n > 100 AND has_table) AS oversized_table,
         min(n) AS child_least, round(avg(n), 6) AS child_mean, list_sort(list(n))[round_even((count(*) - 1) * 0.95::DOUBLE, 0)::INT + 1] AS child_p95, max(n) AS child_most FROM kept GROUP BY conv_id
), whole AS (
  SELECT conv_id, count(*) AS parents, count(*) FILTER (WHERE parent_id NOT IN (SELECT parent_id FROM kept)) AS parents_without_children, max(parent_tokens) AS parent_most FROM parents GROUP BY conv_id
)
SELECT conv_id::VARCHAR AS document_id, parents, parents_without_children, parent_most, children, table_chunks, oversized_non_table, oversized_table, child_least, child_mean, child_p95, child_most FROM whole JOIN own USING (conv_id)"""


@query(_REPORT)
def chunk_report(spark: SparkSession, folder: str) -> DataFrame:
    """The quality report on the chunks of conversations."""
    rows = _talk(spark, folder)
    children = documents.build(rows, _LIMITS, split=False).children
    everyone = documents.parents_of(documents.placed(rows.withColumn("split", F.lit(None).cast("struct<original_element_id:string,part:int,count:int,strategy:string,row_start:int,row_end:int>")), _LIMITS)).checkpoint()  # read three times
    made = quality.chunk_report(everyone, children, child_most=100)
    return made.select(
        "document_id", "parents", "parents_without_children", "parent_most", "children", "table_chunks", "oversized_non_table", "oversized_table", "child_least", F.round("child_mean", 6).alias("child_mean"), "child_p95", "child_most",
    )


_TURN_KIND = "CASE WHEN role = 'system' OR turn % 6 = 0 THEN 'heading' WHEN turn % 5 = 0 THEN 'table' WHEN turn % 7 = 3 THEN 'footer' ELSE 'text' END"


@query(f"""WITH items AS (
  SELECT conv_id, turn, turn // 3 AS page, {_TURN_KIND} AS kind, {CLEAN.format('text')} AS text, text AS md, turn % 3 + 1 AS level, (turn * 7 % 5)::DOUBLE AS y FROM conversations
), kept AS (
  SELECT *, row_number() OVER w AS sequence, last_value(CASE WHEN kind = 'heading' AND level <= 1 THEN {{'l': level, 't': text}} END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN kind = 'heading' AND level <= 2 THEN {{'l': level, 't': text}} END IGNORE NULLS) OVER w AS b,
         last_value(CASE WHEN kind = 'heading' AND level <= 3 THEN {{'l': level, 't': text}} END IGNORE NULLS) OVER w AS c
  FROM items WHERE kind <> 'footer' AND text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY page, y, turn ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id::VARCHAR AS document_id, {UUID5.format("conv_id || ':' || page || ':' || sequence || ':' || kind")} AS element_id, page::INT AS page_number, sequence::DOUBLE AS sequence, kind AS element_type, text, CASE WHEN kind = 'table' THEN md END AS table_markdown,
       list_filter([CASE WHEN a.l = 1 THEN a.t END, CASE WHEN b.l = 2 THEN b.t END, CASE WHEN c.l = 3 THEN c.t END], lambda x: x IS NOT NULL) AS section_path,
       (SELECT count(*) FROM items i WHERE i.conv_id = kept.conv_id AND i.kind = 'footer') AS footers, count(*) OVER (PARTITION BY conv_id, kind) AS of_its_kind
FROM kept""")
def page_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of parsed pages: conversations as the JSON of a parser, three turns a page."""
    kind = F.when((F.col("role") == "system") | (F.col("turn") % 6 == 0), "heading").when(F.col("turn") % 5 == 0, "table").when(F.col("turn") % 7 == 3, "footer").otherwise("text")
    item = F.struct(kind.alias("type"), F.col("text").alias("md"), (F.col("turn") % 3 + 1).alias("level"), F.struct((F.col("turn") * 7 % 5).cast("double").alias("y")).alias("bbox"))
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda s: s["v"])
    turns = table(spark, folder, "conversations").withColumn("page_number", F.floor(F.col("turn") / 3).cast("int"))
    pages = turns.groupBy("conv_id", "page_number").agg(in_order("turn", item).alias("items"))
    parsed = pages.groupBy("conv_id").agg(F.to_json(F.struct(in_order("page_number", F.struct("page_number", "items")).alias("pages"))).alias("parsed"))
    made = normalize.from_pages(parsed.select(F.col("conv_id").cast("string").alias("document_id"), F.lit("talk").alias("domain"), F.lit("table").alias("source_name"), "parsed"))
    rows = made.elements.join(made.counts, "document_id")
    return rows.select(
        "document_id", "element_id", "page_number", "sequence", "element_type", "text", "table_markdown", "section_path", F.coalesce(F.try_element_at("ignored_counts", F.lit("footer")), F.lit(0)).alias("footers"),
        F.try_element_at("element_counts", F.col("element_type")).alias("of_its_kind"),
    )


@query("""
SELECT doc_id, sha256(concat_ws(chr(10), 'Domain: ' || lang, 'Source: ' || source, CASE WHEN doc_id % 3 <> 0 THEN 'Section: part ' || doc_id % 3 END, chr(10) || text,
       CASE WHEN doc_id % 2 = 0 THEN chr(10) || '| a |' END)) AS digest FROM documents""")
def retrieval_text_build(spark: SparkSession, folder: str) -> DataFrame:
    docs, part = table(spark, folder, "documents"), F.col("doc_id") % 3
    section = F.when(part != 0, F.concat(F.lit("part "), part.cast("string")))
    text = T.retrieval_text(F.col("lang"), F.col("source"), section, F.col("text"), F.lit("| a |"), F.col("doc_id") % 2 != 0)
    return docs.select("doc_id", F.sha2(text, 256).alias("digest"))


@query("""
SELECT o_custkey, sha256('| Order | Status | Priority |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
  string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || replace(o_orderpriority || '|x', '|', '\\|') || ' |', chr(10) ORDER BY o_orderkey)) AS digest
FROM orders GROUP BY o_custkey""")
def markdown_table_build(spark: SparkSession, folder: str) -> DataFrame:
    cells = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.concat("o_orderpriority", F.lit("|x")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("c")))), lambda s: s["c"])
    tables = table(spark, folder, "orders").groupBy("o_custkey").agg(rows.alias("rows"))
    return tables.select("o_custkey", F.sha2(T.markdown_table(F.array(*map(F.lit, ("Order", "Status", "Priority"))), F.col("rows")), 256).alias("digest"))


@query("""
WITH c AS (SELECT source, sha256(lower(text) || chr(10) || 'Images:') AS fingerprint, doc_id, doc_id // 5 AS parent, doc_id % 7 AS page FROM documents)
SELECT source AS document_id, fingerprint, min(doc_id) AS chunk_id, arg_min(parent, doc_id) AS parent_id, count(*) AS occurrences, list_sort(list_distinct(list(page))) AS pages,
  list_sort(list_distinct(list_filter(list(parent), lambda p: p <> arg_min(parent, doc_id)))) AS alternate_parents
FROM c GROUP BY source, fingerprint""".replace("list_filter(list(parent), lambda p: p <> arg_min(parent, doc_id))", "list(parent)").replace("AS alternate_parents", "AS parents"))
def dedupe_merge_provenance(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array().cast("array<string>")
    children = table(spark, folder, "documents").select(
        F.col("source").alias("document_id"), ids.chunk_fingerprint(F.col("text"), none).alias("fingerprint"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("chunk_id"),
        F.floor(F.col("doc_id") / 5).alias("parent_id"), F.array(F.col("doc_id") % 7).alias("pages"), none.alias("images"),
    )
    merged = chunking.merge_duplicates(children)
    parents = F.array_sort(F.array_union("alternate_parents", F.array("parent_id")))
    return merged.select("document_id", "fingerprint", "chunk_id", "parent_id", "occurrences", "pages", parents.alias("parents"))


@query(f"SELECT min(doc_id) AS doc_id, lang, arg_min(source, doc_id) AS source, {CLEAN.format('text')} AS clean FROM documents GROUP BY lang, clean")
def first_occurrence_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", T.clean_text(F.col("text")).alias("clean"))
    return elements.first_occurrences(docs, ["lang", "clean"], ["doc_id"]).select("doc_id", "lang", "source", "clean")


_STATS = """count(*) AS n, min(t)::INT AS least, round(avg(t), 6) AS mean,
  list_sort(list(t))[round_even((count(*) - 1) * 0.95::DOUBLE, 0)::INT + 1]::INT AS p95, max(t)::INT AS most"""


@query(f"SELECT lang, {_STATS} FROM (SELECT lang, {COUNT.format('text')} AS t FROM documents) GROUP BY lang")
def token_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("lang", T.token_count(F.col("text")).alias("t"))
    return quality.token_stats(docs, ["lang"], "t").withColumn("mean", F.round("mean", 6))


_REPORT = f"""
WITH c AS (SELECT source, text, {COUNT.format('text')} AS t, CASE WHEN text LIKE '%|%' THEN 'table' ELSE 'text' END AS kind FROM documents),
dup AS (SELECT source, sum(n - 1)::BIGINT AS duplicates FROM (SELECT source, lower(text), count(*) AS n FROM c GROUP BY ALL) GROUP BY source)
SELECT SOURCE source, {_STATS}, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) FILTER (WHERE kind = 'table') AS tables,
  count(*) FILTER (WHERE kind = 'table' AND t > 700) AS oversize_tables, count(*) FILTER (WHERE kind <> 'table' AND t > 700) AS oversize_texts, DUPLICATES AS duplicates
FROM c JOIN dup USING (source) GROUP BY GROUPS"""


def _report(docs: DataFrame, by: list[str]) -> DataFrame:
    c = docs.select("source", "text", T.token_count(F.col("text")).alias("t"), F.when(F.col("text").contains("|"), "table").otherwise("text").alias("kind"))
    big, is_table = F.col("t") > T.CHILD_MAX, F.col("kind") == "table"
    counts = c.groupBy(*by).agg(
        F.count_if(F.trim("text") == "").alias("empty"), F.count_if(is_table).alias("tables"), F.count_if(is_table & big).alias("oversize_tables"), F.count_if(~is_table & big).alias("oversize_texts")
    )
    same = c.groupBy("source", F.sha2(F.lower("text"), 256)).agg((F.count("*") - 1).alias("more")).groupBy(*by).agg(F.sum("more").alias("duplicates"))
    stats = quality.token_stats(c, by, "t").withColumn("mean", F.round("mean", 6))
    return stats.join(counts, by).join(same, by) if by else stats.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(same))  # one row each


@query(_REPORT.replace("SOURCE source", "source").replace("DUPLICATES", "any_value(duplicates)").replace("GROUPS", "source"))
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(table(spark, folder, "documents"), ["source"])


@query(_REPORT.replace("SOURCE source,", "").replace("DUPLICATES", "(SELECT sum(duplicates)::BIGINT FROM dup)").replace(" GROUP BY GROUPS", ""))
def corpus_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _report(table(spark, folder, "documents"), [])


_SIDE = "share + (less <= {0} AND {0} < extra)::INT - (greatest(0, less - extra) + 2 - {0}) // 3"


@query(f"""
WITH docs AS (SELECT doc_id, {CLEAN.format('text')} AS w FROM documents), tok AS (SELECT doc_id, w, {TOKENS.format('w')} AS t FROM docs),
room AS (SELECT greatest(3, floor(150 / 1.1::DOUBLE)::INT - len({TOKENS.format("' ... [middle excerpt] ...  ... [ending excerpt] ... '")})) AS room),
sides AS (
  SELECT less, {_SIDE.format(0)} AS head, {_SIDE.format(1)} AS middle, {_SIDE.format(2)} AS tail FROM (SELECT room, room // 3 AS share, room % 3 AS extra, unnest(range(room - 3)) AS less FROM room)
), tries AS (
  SELECT doc_id, less, t[1 : head] AS a, t[greatest(head, (len(t) - middle) // 2) + 1 : greatest(head, (len(t) - middle) // 2) + middle] AS b,
         t[greatest(greatest(head, (len(t) - middle) // 2) + middle, len(t) - tail) + 1 :] AS c
  FROM tok, sides WHERE ceil(len(t) * 1.1::DOUBLE) > 150
), made AS (
  SELECT doc_id, less, {CLEAN.format("array_to_string(a, '') || ' ... [middle excerpt] ... ' || array_to_string(b, '') || ' ... [ending excerpt] ... ' || array_to_string(c, '')")} AS excerpt FROM tries
), best AS (SELECT doc_id, arg_min(excerpt, less) AS excerpt FROM made WHERE {COUNT.format('excerpt')} <= 150 GROUP BY doc_id)
SELECT doc_id, excerpt, {COUNT.format('excerpt')} AS n_tokens FROM (
  SELECT doc_id, w AS excerpt FROM tok WHERE ceil(len(t) * 1.1::DOUBLE) <= 150 UNION ALL SELECT doc_id, excerpt FROM best)""")
def clip_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    """Excerpts within a limit: head, middle and tail."""
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", tables.clip_text(F.col("text"), 150).alias("excerpt"))
    return docs.select("doc_id", "excerpt", T.token_count(F.col("excerpt")).alias("n_tokens"))


_ROW = "'| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' | ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' | part of the order number ' || o_orderkey || ' |'"
_CELLS = "'<tr><td>' || o_orderkey || '</td><td>' || o_orderstatus || '</td><td>' || o_orderpriority || '</td><td>' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '</td><td>part of the order number ' || o_orderkey || '</td></tr>'"
_HEAD = "'| Order | Status | Priority | Date | Note |' || chr(10) || '| --- | --- | --- | --- | --- |'"


@query(f"""
WITH RECURSIVE lines AS (
  SELECT o_custkey, {_ROW} AS line, {_CELLS} AS cells, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, len({TOKENS.format('chr(10) || ' + _ROW)}) AS n FROM orders
), base AS (SELECT len({TOKENS.format(_HEAD)}) AS head), fold AS (
  SELECT o_custkey, i, line, cells, 1 AS part, head + n AS held FROM lines, base WHERE i = 1
  UNION ALL
  SELECT t.o_custkey, t.i, t.line, t.cells, CASE WHEN ceil((f.held + t.n) * 1.1::DOUBLE) <= 520 THEN f.part ELSE f.part + 1 END, CASE WHEN ceil((f.held + t.n) * 1.1::DOUBLE) <= 520 THEN f.held + t.n ELSE head + t.n END
  FROM fold f JOIN lines t ON t.o_custkey = f.o_custkey AND t.i = f.i + 1, base
), made AS (
  SELECT o_custkey, part, {_HEAD} || string_agg(chr(10) || line, '' ORDER BY i) AS markdown, min(i)::INT AS row_start, max(i)::INT AS row_end,
         '<table><thead><tr><th>Order</th><th>Status</th><th>Priority</th><th>Date</th><th>Note</th></tr></thead><tbody>' || string_agg(cells, '' ORDER BY i) || '</tbody></table>' AS html FROM fold GROUP BY o_custkey, part
)
SELECT element_id, sequence, part, parts, markdown, CASE WHEN parts > 1 THEN html END AS html, CASE WHEN parts > 1 THEN row_start END AS row_start, CASE WHEN parts > 1 THEN row_end END AS row_end, CASE WHEN parts > 1 THEN 'markdown_rows' END AS strategy FROM (
  SELECT o_custkey AS element_id, o_custkey + CASE WHEN count(*) OVER w > 1 THEN part::DOUBLE / (count(*) OVER w + 1) ELSE 0 END AS sequence, part::INT AS part, (count(*) OVER w)::INT AS parts, markdown, html, row_start, row_end
  FROM made WINDOW w AS (PARTITION BY o_custkey))""")
def table_split(spark: SparkSession, folder: str) -> DataFrame:
    """A table of each customer's orders, in parts of whole rows."""
    note = F.concat(F.lit("part of the order number "), F.col("o_orderkey").cast("string"))
    cells = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), note)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("c")))), lambda s: s["c"])
    made = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("element_id")).agg(rows.alias("rows"))
    headers = F.array(*map(F.lit, ("Order", "Status", "Priority", "Date", "Note")))
    return tables.split_tables(made.select("element_id", F.col("element_id").cast("double").alias("sequence"), T.markdown_table(headers, F.col("rows")).alias("table_markdown"), F.lit(None).cast("string").alias("table_html")))
