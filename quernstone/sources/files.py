"""Files as tables: discovery, manifests, JSON lines, surveys, vectors, questions; writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.ids import document_id
from quernstone.operators.survey import COLUMNS
from quernstone.storage import numbered

#: Kinds of local files; strings that a reader of numbers takes for missing.
SUFFIXES = {".pdf": "pdf", ".csv": "csv"}
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

DISCOVERED = ["document_id", "domain", "source_type", "file_name", "source_location", "file_size", "config"]


def discover_local(spark: SparkSession, root: str, domain: str) -> DataFrame:
    """PDF and CSV files right inside root/domain, by suffix in any letter case."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{domain}/*").select("path", "length")
    files = files.where(F.element_at(F.split("path", "/"), -2) == domain)  # a pattern also opens the folders that it meets
    name = F.regexp_extract("path", r"[^/]*$", 0)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)))
    found = files.withColumns({"file_name": name, "source_type": kind}).where(F.col("source_type").isNotNull())
    place = F.concat(F.lit(f"{domain}/"), "file_name")
    return found.withColumns({"domain": F.lit(domain), "source_location": place, "file_size": F.col("length"), "config": F.lit(None).cast("string")}).withColumn(
        "document_id", document_id(F.col("domain"), F.col("source_type"), place)
    ).select(*DISCOVERED)


def discover_manifests(spark: SparkSession, root: str, domain: str) -> DataFrame:
    """Web sources in root/domain/*.json, each an entry or a list of them; the crawl's settings are its own or the entry. No address, no source."""
    texts = spark.read.option("wholetext", "true").text(f"{root.rstrip('/')}/{domain}/*.json").select(F.trim("value").alias("t"), F.col("_metadata.file_name").alias("file"))
    entries = F.from_json(F.when(F.startswith("t", F.lit("[")), F.col("t")).otherwise(F.concat(F.lit("["), "t", F.lit("]"))), "array<string>")
    each = texts.select(F.regexp_replace("file", r"\.json$", "").alias("stem"), F.explode(entries).alias("e"))
    config = F.coalesce(F.get_json_object("e", "$.firecrawl_config"), F.col("e"))
    rows = each.select(F.coalesce(F.get_json_object("e", "$.name"), "stem").alias("file_name"), config.alias("config"), F.get_json_object(config, "$.url").alias("source_location"))
    rows = rows.where(F.coalesce("source_location", F.lit("")) != "")
    return rows.withColumns({"domain": F.lit(domain), "source_type": F.lit("html"), "file_size": F.lit(None).cast("long")}).withColumn(
        "document_id", document_id(F.col("domain"), F.col("source_type"), F.col("source_location"))
    ).select(*DISCOVERED)


def discover(spark: SparkSession, root: str, domains: list[str], manifests: list[str] | None = None) -> DataFrame:
    """Sources of all domains, ordered by domain, kind and name. ``manifests``: the domains that have manifest files."""
    parts = [discover_local(spark, root, d) for d in sorted(domains)] + [discover_manifests(spark, root, d) for d in sorted(manifests or [])]
    return reduce(DataFrame.unionByName, parts).orderBy("domain", "source_type", "file_name")


def outputs_complete(spark: SparkSession, pattern: str, needed: int) -> DataFrame:
    """(folder): folders below the pattern in which at least ``needed`` files are there and not empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "length")
    return files.groupBy("folder").agg(F.count_if(F.col("length") > 0).alias("n")).where(F.col("n") >= needed).select("folder")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are no rows. Paths may hold patterns."""
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_structured(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files of one JSON value each: pages with their items."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def structured_summary(pages: DataFrame) -> DataFrame:
    """Number of pages, tables and images, and the sorted kinds of items, of rows (page, items ARRAY<STRUCT<type, ...>>)."""
    items = pages.select(F.explode_outer("items").alias("i"))
    counts = items.agg(F.count_if(F.col("i.type") == "table").alias("tables"), F.count_if(F.col("i.type") == "image").alias("images"), F.array_sort(F.collect_set("i.type")).alias("types"))
    return pages.agg(F.count("*").alias("pages")).crossJoin(F.broadcast(counts))  # one row each


def read_survey(spark: SparkSession, path: str, na: bool = True) -> DataFrame:
    """A survey CSV as text columns under the table's names; with ``na``, words for missing numbers are null."""
    raw = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("inferSchema", "false").csv(path)
    rows = raw.withColumnsRenamed({c: COLUMNS[c.lstrip("﻿")] for c in raw.columns if c.lstrip("﻿") in COLUMNS})
    missing = lambda c: F.when(~F.col(c).isin(*NA_VALUES), F.col(c))
    return rows.select(*[missing(c).alias(c) if na else F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def read_sparse_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Sparse vectors from JSON lines. A missing key or unequal lengths fail; of a chunk's records the first line stays."""
    schema = "chunk_id string, indices array<int>, values array<float>, dimension int, model string"
    rows = spark.read.schema(schema).json(path).withColumn("line", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    whole = F.col("chunk_id").isNotNull() & F.col("indices").isNotNull() & F.col("values").isNotNull() & F.col("dimension").isNotNull() & F.col("model").isNotNull()
    good = F.coalesce(whole & (F.size("indices") == F.size("values")), F.lit(False))
    checked = rows.withColumn("chunk_id", F.when(good, F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("broken sparse record: "), F.coalesce("chunk_id", F.lit("no chunk_id"))))))
    first = checked.groupBy("chunk_id").agg(F.min_by(F.struct("indices", "values", "dimension", "model"), "line").alias("v"))
    return first.select("chunk_id", "v.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions. An empty list, or a row without question or reference answer, is an error."""
    rows = spark.read.option("multiLine", "true").schema("id string, question string, reference_answer string, domain string, difficulty string, reference_contexts array<string>").json(path)
    bad = F.trim(F.coalesce("question", F.lit(""))).isin("") | F.trim(F.coalesce("reference_answer", F.lit(""))).isin("")
    n, broken = rows.agg(F.count("*"), F.count_if(bad)).first()
    if not n or broken:
        raise ValueError("questions need question and reference_answer, and there must be some")
    return rows


def combined_markdown(pages: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Pages of each document in order, with rules between them."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return pages.groupBy(by).agg(F.array_join(F.transform(ordered, lambda s: s[text]), "\n\n---\n\n").alias("markdown"))


def export_vectors(chunks: DataFrame, path: str, vector: str, dimension: int, order: list[str]) -> DataFrame:
    """Writes vectors in order with their row numbers, after checking that none is missing or of another size. Returns the manifest."""
    broken = chunks.where(F.col(vector).isNull() | (F.size(vector) != dimension)).limit(1).count()
    if broken:
        raise ValueError("vectors are missing or have another dimension")
    rows = numbered(chunks, F.struct(*order), "row_index")
    rows.select("row_index", "chunk_id", vector).repartitionByRange(F.col("row_index")).sortWithinPartitions("row_index").write.mode("overwrite").parquet(path)
    return rows.drop(vector)


def ids_match(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Both sides hold the same keys."""
    return not a.join(b, key, "left_anti").limit(1).count() and not b.join(a, key, "left_anti").limit(1).count()


def kept_images(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The records of image manifests (JSON lines) whose decision is to keep; the filter is applied while lines are read."""
    return read_jsonl(spark, path, schema).where(F.col("decision") == "keep")
