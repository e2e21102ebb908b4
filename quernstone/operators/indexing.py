"""Work of an index: what waits to be parsed or embedded, inputs of an embedding model, stored forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.store import json_set, needs_embedding
from quernstone.storage import numbered

#: States of documents that wait to be parsed.
WAITING = ("discovered", "parsing", "failed")
#: The order in which pending chunks are taken.
CHUNK_ORDER = ("domain", "source_type", "file_name", "chunk_id")
#: Tokens of an input without its reserve, pixels of a token, pixels of an image, characters of a token where none were counted.
INPUT_TOKENS, TOKEN_PIXELS, IMAGE_PIXELS, TOKEN_CHARACTERS = 30_000, 560, 16_000_000, 3


def waiting_documents(documents: DataFrame, source_type: str | None = None) -> DataFrame:
    """Documents to parse, of one source type if it is given, by domain and file name."""
    rows = documents.where(F.col("status").isin(*WAITING))
    return (rows.where(F.col("source_type") == source_type) if source_type else rows).orderBy(F.asc_nulls_last("domain"), F.asc_nulls_last("file_name"))


def pending_chunks(chunks: DataFrame, kind: str, model: str, dimension: int, limit: int | None = None) -> DataFrame:
    """Chunks without a vector of this kind (dense, sparse), model and dimension, in order; the first ``limit`` of them.

    Reads the columns {kind}_embedding, {kind}_model and {kind}_dimension. Chunks whose text is null or only spaces have no sparse vector to wait for.
    """
    rows = chunks.where(needs_embedding(F.col(f"{kind}_embedding"), F.col(f"{kind}_model"), F.col(f"{kind}_dimension"), model, dimension))
    rows = rows.where(F.btrim("retrieval_text") != "") if kind == "sparse" else rows
    rows = rows.orderBy(*[F.asc_nulls_last(c) for c in CHUNK_ORDER])
    return rows if limit is None else rows.limit(limit)


def stored_form(chunks: DataFrame, compact: bool) -> DataFrame:
    """Chunks as they are stored; the compact form has no text_content and no table_markdown. metadata (JSON) says which form it is."""
    out = chunks.withColumn("metadata", json_set(F.col("metadata"), "storage_mode", F.lit("compact" if compact else "full")))
    return out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in ("text_content", "table_markdown")}) if compact else out


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): stripped texts, without blank ones."""
    text = F.regexp_replace(F.coalesce("retrieval_text", F.lit("")), r"^\s+|\s+$", "")
    return chunks.select("chunk_id", text.alias("text")).where("text != ''")


def in_batches(rows: DataFrame, order: Column, size: int, name: str = "batch") -> DataFrame:
    """Rows with the number of their batch of ``size``, from 0, in the given order."""
    return numbered(rows, order, name).withColumn(name, F.floor(F.col(name) / size))


def text_tokens(text: Column, counted: Column) -> Column:
    """The counted tokens; an estimate of at least 1 by characters where the count is null or 0."""
    return F.coalesce(F.nullif(counted, F.lit(0)), F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / TOKEN_CHARACTERS))).cast("long")


def pixels(images: Column) -> Column:
    """All pixels of ARRAY<STRUCT<width, height>>."""
    return F.aggregate(F.coalesce(images, F.array().cast("array<struct<width:bigint,height:bigint>>")), F.lit(0).cast("long"), lambda s, i: s + i["width"] * i["height"])


def input_tokens(tokens: Column, images: Column) -> Column:
    """Tokens of a text with its images, up to what an input holds."""
    room = F.greatest(F.lit(0), INPUT_TOKENS - tokens)
    return F.least(F.lit(INPUT_TOKENS), tokens + F.least(room, F.ceil(pixels(images) / TOKEN_PIXELS))).cast("long")


def image_scale(tokens: Column, images: Column) -> Column:
    """The factor, at most 1, by which the sides of all images shrink, so that they fit beside the text and none is too large."""
    room = F.greatest(F.lit(TOKEN_PIXELS).cast("long"), (INPUT_TOKENS - tokens) * TOKEN_PIXELS)
    largest = F.coalesce(F.array_max(F.transform(images, lambda i: i["width"] * i["height"])), F.lit(0))
    root = lambda most, have: F.when(have > most, F.sqrt(most / have)).otherwise(1.0)
    return F.least(root(room, pixels(images)), root(F.lit(IMAGE_PIXELS), largest))


def scaled(images: Column, scale: Column) -> Column:
    """The images' sizes after scaling, rounded down, at least 1."""
    side = lambda x: F.when(scale < 1, F.greatest(F.lit(1), F.floor(x * scale))).otherwise(x).cast("long")
    return F.transform(images, lambda i: F.struct(side(i["width"]).alias("width"), side(i["height"]).alias("height")))


def audience(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")).contains("audience=consumer"), "consumer").otherwise("professional")


def tiny_chart(reason: Column, width: Column, height: Column) -> Column:
    """A layout chart crop with a side under 80 points. Without a box it is none."""
    return F.coalesce((reason == "layout chart crop") & ((width < 80) | (height < 80)), F.lit(False))


def sparse_record(weights: Column, dimension: int) -> Column:
    """STRUCT<indices, values, dimension> of MAP<INT, DOUBLE>, by index."""
    entries = F.array_sort(F.map_entries(weights))
    return F.struct(F.transform(entries, lambda e: e["key"]).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("values"), F.lit(dimension).alias("dimension"))


def document_status(documents: DataFrame, children: DataFrame, key: str, pending: Column) -> DataFrame:
    """documents with the status that their children give them.

    A document that is parsed or further is parsed without children, chunked with any, and indexed once none of them is pending (a null is not pending).
    Others keep their status. children: key, and what ``pending`` reads; they are counted before they meet the documents.
    """
    counted = children.groupBy(F.col(key).alias("quern_key")).agg(F.count_if(pending).alias("quern_pending"))
    joined = documents.join(counted, F.col(key) == F.col("quern_key"), "left")
    waits = F.col("quern_pending")
    reached = F.when(waits.isNull(), "parsed").when(waits > 0, "chunked").otherwise("indexed")
    status = F.when(F.col("status").isin("parsed", "chunked", "indexed"), reached).otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("quern_key", "quern_pending")


def current_ids(chunks: DataFrame) -> DataFrame:
    """The distinct ids of chunks."""
    return chunks.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct()
