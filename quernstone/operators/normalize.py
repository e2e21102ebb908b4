"""Parsed sources of unknown structure to elements: pages of a document parser, sections of web pages, category documents of a survey.

A parser's output is kept as VARIANT, whatever it holds; pages, sections and items come out of it by ``variant_explode``, one row each,
and only the paths that are needed are read from a row. What is left out is counted by its reason. Texts and JSON that can't be read have no elements.

Elements have the columns of ``document_chunks.ELEMENT``, so ``document_chunks.build`` takes them as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernstone.functions import text as T
from quernstone.functions.ids import content_hash, document_id, stable_id
from quernstone.operators.document_chunks import ELEMENT
from quernstone.operators.elements import section_paths

#: Fixed value: characters of the text on either side of an image.
NEARBY = 1200
#: Kinds of items that bear no text of a page, of those that are dropped, and kinds of elements of web pages.
FURNITURE, DROPPED, WEB_KINDS = ("header", "footer", "heading"), ("header", "footer"), ("heading", "text", "table", "image")

IMAGE = "document_id string, page_number int, filename string, image_path string, bbox struct<x: double, y: double, w: double, h: double>, reason string, position int"


class Normalized(NamedTuple):
    """Elements, and for each document how many there are of each kind and how many were left out for each reason."""

    elements: DataFrame
    counts: DataFrame


def _fields() -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ELEMENT).fields]


def _as_elements(rows: DataFrame, **columns: Column) -> DataFrame:
    """The columns of ELEMENT in order; null where rows have none."""
    made = [(columns[name] if name in columns else F.lit(None)).cast(kind).alias(name) for name, kind in _fields()]
    return rows.select(*made)


def _at(path: str, kind: str = "string", of: str = "value") -> Column:
    return F.try_variant_get(of, f"$.{path}", kind)


def _exploded(rows: DataFrame, variant: Column, pos: str, *keep: str) -> DataFrame:
    """A row for each item of a list: ``value``, its place ``pos``, and the columns to keep. Nothing for what is no list."""
    spark: SparkSession = rows.sparkSession
    held = rows.select(*keep, variant.alias("quern_list"))
    out = held.lateralJoin(spark.tvf.variant_explode(F.col("quern_list").outer()).select(F.col("pos").alias(pos), F.col("key").alias("quern_key"), "value"))
    return out.where(F.col("quern_key").isNull()).select(*keep, pos, "value")


def _counted(documents: DataFrame, elements: DataFrame, ignored: DataFrame) -> DataFrame:
    """(document_id, element_counts, ignored_counts) MAP<STRING, BIGINT> of every document."""

    def histogram(rows: DataFrame, kind: str, name: str) -> DataFrame:
        counts = rows.groupBy("document_id", kind).agg(F.count("*").alias("n"))
        return counts.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias(name))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    joined = documents.select("document_id").distinct().join(histogram(elements, "element_type", "element_counts"), "document_id", "left").join(histogram(ignored, "reason", "ignored_counts"), "document_id", "left")
    return joined.select("document_id", *[F.coalesce(c, none).alias(c) for c in ("element_counts", "ignored_counts")])


def _some(*values: Column) -> Column:
    """The first that is not empty, cleaned; empty if none is."""
    return T.clean_text(F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit("")))


def from_pages(documents: DataFrame, images: DataFrame | None = None) -> Normalized:
    """Elements of parsed pages in reading order: top to bottom, unplaced items last, texts before images of one height, then as they come.

    documents: document_id, domain, source_name, parsed (JSON text: pages, each with page_number and items of type, md, value, level, html, bbox); images: rows of IMAGE, kept ones
    only. Headers and footers are left out and counted; items without text are left out. An image knows the nearest text on either side on its page, and the
    table if one of these is one. Headings open sections: one closes those of its level and below (six levels).
    """
    info = documents.select("document_id", "domain", "source_name")
    parsed = documents.select("document_id", F.try_parse_json("parsed").alias("quern_parsed"))
    pages = _exploded(parsed, _at("pages", "variant", "quern_parsed"), "page_pos", "document_id")
    pages = pages.withColumn("page_number", _at("page_number", "int"))
    items = _exploded(pages, _at("items", "variant"), "pos", "document_id", "page_pos", "page_number")
    kind, md, value = F.coalesce(_at("type"), F.lit("")), _at("md"), _at("value")
    box = lambda c: F.coalesce(_at(f"bbox.{c}", "double"), _at(f"bbox[0].{c}", "double"))
    boxes = F.struct(*[box(c).alias(c) for c in "xywh"])
    items = items.select(
        "document_id", "page_pos", "page_number", kind.alias("kind"), F.lit(0).alias("is_image"), "pos", F.coalesce(box("y"), F.lit(float("inf"))).alias("y"), F.when(kind == "table", _some(value, md)).otherwise(_some(md, value)).alias("text"),
        _some(md, value).alias("near"), md.alias("md"), _at("html").alias("html"), F.coalesce(_at("level", "int"), F.lit(1)).alias("level"), boxes.alias("bbox"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("reason"),
    )
    rows = items
    if images is not None:
        first = pages.groupBy("document_id", "page_number").agg(F.min("page_pos").alias("page_pos"))
        kept = images.join(first, ["document_id", "page_number"])
        empty = lambda k: F.lit(None).cast(k)
        rows = items.unionByName(kept.select(
            "document_id", "page_pos", "page_number", F.lit("image").alias("kind"), F.lit(1).alias("is_image"), F.col("position").alias("pos"), F.coalesce("bbox.y", F.lit(float("inf"))).alias("y"), F.lit("").alias("text"),
            F.lit("").alias("near"), empty("string").alias("md"), empty("string").alias("html"), F.lit(1).alias("level"), "bbox", "filename", "image_path", "reason",
        ))
    place = F.struct("page_pos", "y", "is_image", "pos", "filename")
    rows = rows.withColumn("place", place)
    on_page = Window.partitionBy("document_id", "page_pos").orderBy("place")
    bears = (F.col("is_image") == 0) & ~F.col("kind").isin(*FURNITURE) & (F.col("near") != "")
    beside = F.when(bears, F.struct("near", F.when(F.col("kind") == "table", F.col("md")).alias("table")))
    rows = rows.withColumns({
        "before": F.last(beside, ignorenulls=True).over(on_page.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first(beside, ignorenulls=True).over(on_page.rowsBetween(1, Window.unboundedFollowing)),
    })
    dropped = F.col("kind").isin(*DROPPED) & (F.col("is_image") == 0)
    kept = rows.where(~dropped & ((F.col("is_image") == 1) | (F.col("text") != "")))
    heading = (F.col("kind") == "heading") & (F.col("is_image") == 0)
    kept = section_paths(kept, ["document_id"], "place", F.when(heading, F.col("level")), F.when(heading, F.col("text")))
    kept = kept.withColumn("sequence", F.row_number().over(Window.partitionBy("document_id").orderBy("place"))).join(info, "document_id")
    kind = F.when(F.col("is_image") == 1, "image").when(F.col("kind").isin("heading", "table"), F.col("kind")).otherwise("text")
    page = F.coalesce(F.col("page_number").cast("string"), F.lit(""))
    ids = F.when(F.col("is_image") == 1, stable_id(F.col("document_id"), page, F.col("filename"))).otherwise(stable_id(F.col("document_id"), page, F.col("sequence"), kind))
    is_table, is_image = F.col("kind") == "table", F.col("is_image") == 1
    around = F.struct(
        F.left("before.near", F.lit(NEARBY)).alias("nearby_text_before"), F.left("after.near", F.lit(NEARBY)).alias("nearby_text_after"), F.coalesce("before.table", "after.table").alias("nearby_table_markdown"), F.col("reason").alias("selection_reason")
    )
    elements = _as_elements(
        kept, element_id=ids, document_id=F.col("document_id"), domain=F.col("domain"), source_type=F.lit("pdf"), source_name=F.col("source_name"), page_number=F.col("page_number"), sequence=F.col("sequence"),
        section_title=F.try_element_at("section_path", F.lit(-1)), section_path=F.col("section_path"), element_type=kind, text=F.when(~is_image, F.col("text")), table_markdown=F.when(is_table & ~is_image, F.col("md")), table_html=F.when(is_table & ~is_image, F.col("html")),
        image_path=F.col("image_path"), bbox=F.when(F.col("bbox.x").isNotNull(), F.col("bbox")), metadata=F.when(is_image, around),
    )
    return Normalized(elements, _counted(info, elements, rows.where(dropped).select("document_id", F.col("kind").alias("reason"))))


def from_sections(documents: DataFrame) -> Normalized:
    """Elements of web pages: sections with a path and elements of type, text, tables and images, in order.

    documents: domain, source_name, root_url, parsed (JSON text: pages, each with source_url, page_number and sections of heading, section_path and elements). Of texts and tables alike in a
    document (without letter case), and of images of one address, the first stays. Navigation, repeats and unknown kinds are counted.
    """
    held = documents.select(document_id(F.col("domain"), F.lit("html"), F.coalesce("root_url", F.lit(""))).alias("document_id"), "domain", "source_name", F.try_parse_json("parsed").alias("quern_parsed"))
    info = held.select("document_id", "domain", "source_name")
    pages = _exploded(held, _at("pages", "variant", "quern_parsed"), "page_pos", "document_id").withColumns({"page_number": _at("page_number", "int"), "source_url": _at("source_url")})
    sections = _exploded(pages, _at("sections", "variant"), "section_pos", "document_id", "page_pos", "page_number", "source_url")
    clean_path = F.filter(F.transform(F.coalesce(_at("section_path", "array<string>"), F.array().cast("array<string>")), T.clean_text), lambda t: t != "")
    sections = sections.withColumns({"title": T.clean_text(F.coalesce(_at("heading"), F.lit(""))), "path": clean_path})
    rows = _exploded(sections, _at("elements", "variant"), "pos", "document_id", "page_pos", "page_number", "source_url", "section_pos", "title", "path")
    rows = rows.select(
        "document_id", "page_number", "source_url", "title", "path", F.struct("page_pos", "section_pos", "pos").alias("place"), _at("type").alias("kind"), T.clean_text(F.coalesce(_at("text"), F.lit(""))).alias("text"),
        _at("table_markdown").alias("markdown"), _at("table_html").alias("html"), _at("image_url").alias("image_url"), _at("element_id").alias("given_id"), _at("image_path").alias("image_path"),
    )
    navigation = (F.col("kind") == "text") & T.is_navigation(F.col("text"))
    body = F.when(F.col("kind") == "table", F.coalesce("markdown", F.lit(""))).when((F.col("kind") == "text") & ~navigation, F.col("text"))
    key = F.when(F.col("kind") == "image", F.concat(F.lit("image:"), F.coalesce("image_url", F.lit("")))).when(body.isNotNull(), F.concat(F.lit("content:"), content_hash(T.clean_text(body))))
    # rows without a key (headings, navigation, unknown kinds) are numbered by themselves, spread by their place
    rows = rows.withColumn("quern_key", key)
    nth = F.row_number().over(Window.partitionBy("document_id", "quern_key", F.when(F.col("quern_key").isNull(), F.hash("place"))).orderBy("place"))
    again = F.col("quern_key").isNotNull() & (nth > 1)
    reason = F.when(navigation, "navigation_text").when(again & (F.col("kind") == "image"), "duplicate_image").when(again, "duplicate_content").when(~F.coalesce(F.col("kind"), F.lit("")).isin(*WEB_KINDS), F.coalesce(F.nullif("kind", F.lit("")), F.lit("unknown")))
    rows = rows.withColumn("reason", reason)
    kept = rows.where(F.col("reason").isNull()).withColumn("sequence", F.row_number().over(Window.partitionBy("document_id").orderBy("place"))).join(info, "document_id")
    elements = _as_elements(
        kept, element_id=F.coalesce(F.nullif("given_id", F.lit("")), stable_id(F.col("document_id"), F.col("sequence"))), document_id=F.col("document_id"), domain=F.col("domain"), source_type=F.lit("html"), source_name=F.col("source_name"), source_url=F.col("source_url"),
        page_number=F.col("page_number"), sequence=F.col("sequence"), section_title=F.col("title"), section_path=F.col("path"), element_type=F.col("kind"), text=F.nullif("text", F.lit("")), table_markdown=F.col("markdown"), table_html=F.col("html"), image_path=F.col("image_path"),
    )
    return Normalized(elements, _counted(info, elements, rows.where(F.col("reason").isNotNull())))


def from_categories(categories: DataFrame, source_name: str, domain: Column) -> DataFrame:
    """Category documents of a survey as elements, one each, with profile_id, facility_id, hospital_name and state beside them.

    categories: category_doc_id, document_id, category, retrieval_text, table_markdown, source_row_numbers, profile_id, facility_id, hospital_name, state; they are numbered by id in a document.
    """
    nth = F.row_number().over(Window.partitionBy("document_id", "profile_id").orderBy("category", "category_doc_id"))
    rows = categories.withColumn("sequence", nth)
    beside = ("profile_id", "facility_id", "hospital_name", "state")
    columns = {
        "element_id": F.col("category_doc_id"), "document_id": F.col("document_id"), "domain": domain, "source_type": F.lit("csv"), "source_name": F.lit(source_name), "sequence": F.col("sequence"), "section_title": F.col("category"),
        "section_path": F.array("hospital_name", "category"), "element_type": F.lit("table"), "text": F.col("retrieval_text"), "table_markdown": F.col("table_markdown"), "source_row_numbers": F.col("source_row_numbers"),
    }
    return rows.select(*[(columns[n] if n in columns else F.lit(None)).cast(k).alias(n) for n, k in _fields()], *beside)
