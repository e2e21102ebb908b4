"""Elements of documents to parents and children, with provenance: the whole way from parsed pages to chunks.

Oversized elements are split first. A section is a document's elements of one address and path. Its elements are folded once, in
order: the fold says which parent and which child each element goes to, and both kinds of rows are aggregated from its result.
Then images are attached to children, table crops that found no place get a child of their own, and children
that are alike in a document become one.

Elements have the columns of ``ELEMENT``. They may have others, which are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import tee
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quernstone.functions import text as T
from quernstone.functions.ids import chunk_fingerprint, stable_id
from quernstone.operators import attach, tables
from quernstone.operators.chunking import IMAGES_MAX, expand_oversized
from quernstone.operators.tables import clip_text
from quernstone.storage import checkpoint_folder, small_batches

ELEMENT = """element_id string, document_id string, domain string, source_type string, source_name string, source_url string, page_number int, sequence double,
  section_title string, section_path array<string>, element_type string, text string, table_markdown string, table_html string, image_path string,
  bbox struct<x: double, y: double, w: double, h: double>, source_row_numbers array<bigint>,
  metadata struct<nearby_text_before: string, nearby_text_after: string, nearby_table_markdown: string, selection_reason: string>"""

#: The title of elements without a section, a crop's reason, and the reason and least side of chart crops that are not too small.
UNSECTIONED = "Unsectioned"
TABLE_CROP, CHART_CROP, CHART_SIDE = "layout table or form crop", "layout chart crop", 80
#: Tokens of the text around an image, whole and on each side.
CONTEXT_TOKENS, SIDE_TOKENS = 560, 250
#: What a crop without a child says of itself: its file, section and page; and the lines of a survey's parent.
CROP_NOTE, NO_PAGE = ("Visual table crop ", " from section ", " on ", ". Use the attached image as the table evidence."), "an unspecified page"
PROFILE_LINES = ("Hospital: ", "Facility ID: ", "State: ", "Available categories: ")
_SECTION = ["document_id", "quern_url", "quern_path"]


class Limits(NamedTuple):
    """Tokens of a parent, of a child's texts, and from which on a child is full."""

    parent: int = T.PARENT_MAX
    buffer: int = T.BUFFER_MAX
    target: int = T.CHILD_TARGET


class Chunks(NamedTuple):
    parents: DataFrame
    children: DataFrame


def fold(kinds: Iterable[str], contents: Iterable[int], texts: Iterable[int], limits: Limits) -> Iterator[tuple[int | None, int | None]]:
    """(parent, child) of each element of a section in order, both from 1; None where an element is in neither (headings) or in no child yet (images).

    contents are the tokens of an element's content, texts those of its text. An element that would carry a parent or an open child past its limit
    begins the next; a table is a child of its own; a child that has reached the target is closed.
    """
    parent = child = held = filled = 0
    is_open = False
    for kind, content, text in zip(kinds, contents, texts, strict=True):
        if kind == "heading":
            yield None, None
            continue
        if not parent or held + content > limits.parent:
            parent, held, child, is_open = parent + 1, 0, 0, False
        held += content
        if kind == "image":
            yield parent, None
            continue
        if kind == "table":
            child, is_open = child + 1, False
        else:
            if not is_open or filled + text > limits.buffer:
                child, filled = child + 1, 0
            filled += text
            is_open = filled < limits.target
        yield parent, child


def image_context(limit: int = CONTEXT_TOKENS) -> Column:
    """The text around an image, else the table beside it, as an excerpt."""
    some = lambda c: F.nullif(F.col(f"metadata.{c}"), F.lit(""))
    around = F.nullif(F.array_join(F.array_compact(F.array(some("nearby_text_before"), some("nearby_text_after"))), "\n"), F.lit(""))
    return clip_text(F.coalesce(around, some("nearby_table_markdown")), limit)


def expanded(elements: DataFrame) -> DataFrame:
    """ELEMENT rows with oversized texts and tables in parts, each an element of its own. Adds ``split``: what was split, into how many, which part, how."""
    rows = elements.withColumn("element_type", F.coalesce("element_type", F.lit("text")))
    null = lambda kind: F.lit(None).cast(kind)

    def split(original: Column, part: Column, count: Column, how: Column, first: Column, last: Column) -> Column:
        made = F.struct(original.alias("original_element_id"), part.cast("int").alias("part"), count.cast("int").alias("count"), how.alias("strategy"), first.alias("row_start"), last.alias("row_end"))
        return F.when(count > 1, made)

    def renamed(kind: str, part: Column, count: Column) -> Column:
        return F.when(count > 1, stable_id(F.col("element_id"), kind, part)).otherwise(F.col("element_id"))

    is_text, is_table = ~F.col("element_type").isin("heading", "image", "table"), F.col("element_type") == "table"
    texts = expand_oversized(rows.where(is_text)).withColumn("piece", F.col("piece") + 1)
    texts = texts.withColumn("split", split(F.col("element_id"), F.col("piece"), F.col("pieces"), null("string"), null("int"), null("int")))
    texts = texts.withColumn("element_id", renamed("text_split", F.col("piece"), F.col("pieces"))).drop("piece", "pieces")
    parts = tables.table_parts(rows.where(is_table), "table_markdown", "table_html")
    parts = parts.withColumn("split", split(F.col("element_id"), F.col("part"), F.col("parts"), F.col("p.strategy"), F.col("p.row_start"), F.col("p.row_end")))
    sequence = F.col("sequence") + F.when(F.col("parts") > 1, F.col("part") / (F.col("parts") + 1)).otherwise(0.0)
    parts = parts.withColumns({
        "sequence": sequence, "table_markdown": F.col("p.markdown"), "table_html": F.col("p.html"), "text": F.when(F.col("parts") == 1, F.col("text")),
        "element_id": renamed("table_split", F.col("part"), F.col("parts")),
    }).drop("p", "part", "parts")
    others = rows.where(F.col("element_type").isin("heading", "image")).withColumn("split", F.lit(None).cast(texts.schema["split"].dataType))
    return others.unionByName(texts).unionByName(parts)


def placed(elements: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Elements (with ``split``) and the numbers of their parent and child in their section; the section's key, and its place in the document."""
    path = F.when(F.size("section_path") > 0, F.col("section_path")).otherwise(F.array(F.coalesce(F.nullif("section_title", F.lit("")), F.lit(UNSECTIONED))))
    content = T.element_content(F.col("element_type"), F.col("quern_context"), F.nullif("table_markdown", F.lit("")), F.col("text"))
    context = F.when(F.col("element_type") == "image", image_context())
    names = [f.name for f in S.StructType.fromDDL(ELEMENT).fields]
    rows = elements.select(*names, "split").withColumns({"quern_url": F.coalesce("source_url", F.lit("")), "quern_path": path, "quern_context": context})
    rows = rows.withColumn("quern_content", F.coalesce(content, F.lit("")))
    rows = rows.withColumn("quern_n", T.token_count("quern_content"))
    rows = rows.withColumn("quern_text_n", F.when(F.coalesce("text", F.lit("")) == F.col("quern_content"), F.col("quern_n")).otherwise(T.token_count("text")))
    out = S.StructType([*rows.schema.fields, S.StructField("parent", S.IntegerType()), S.StructField("child", S.IntegerType()), S.StructField("first_at", S.DoubleType()), S.StructField("first_id", S.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = places = None
        fed: deque = deque()
        for batch in batches:
            made = []
            for *key, kind, content, text, at, element in zip(*(batch.column(c).to_pylist() for c in (*_SECTION, "element_type", "quern_n", "quern_text_n", "sequence", "element_id"))):
                if places is None or key != last:
                    last, first = key, (at, element)
                    items = tee(iter(fed.popleft, None), 3)  # the fold of a section goes on from batch to batch
                    places = fold(*(map(itemgetter(i), x) for i, x in enumerate(items)), limits)
                fed.append((kind, content, text))
                made.append((*next(places), *first))
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=out.names)

    small_batches(elements.sparkSession)
    return rows.repartition(*_SECTION).sortWithinPartitions(*_SECTION, F.asc_nulls_last("sequence"), F.asc_nulls_last("element_id")).mapInArrow(run, out)


def _sorted_set(c: str, flat: bool = False) -> Column:
    found = F.collect_list(c)
    return F.array_sort(F.array_distinct(F.flatten(found) if flat else found))


def _in_order(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("sequence", "element_id", *columns)))


def parents_of(rows: DataFrame) -> DataFrame:
    """Parents of placed elements: ids, titles, pages, addresses, text and elements."""
    held = _in_order("section_title", "quern_content")
    made = rows.where(F.col("parent").isNotNull()).groupBy(*_SECTION, "parent", "first_at", "first_id").agg(
        held.alias("held"), _sorted_set("page_number").alias("page_numbers"), *[F.min_by(c, F.struct("sequence", "element_id")).alias(c) for c in ("domain", "source_type", "source_name")],
    )
    text = F.array_join(F.filter(F.transform("held", lambda e: e["quern_content"]), lambda c: c != ""), "\n\n")
    title = F.coalesce(F.nullif(F.col("held")[0]["section_title"], F.lit("")), F.element_at("quern_path", -1), F.lit(UNSECTIONED))
    return made.select(
        "document_id", "domain", "source_type", "source_name", "quern_url", "quern_path", stable_id(F.col("document_id"), F.array_join("quern_path", "|"), F.col("parent"), F.col("quern_url")).alias("parent_id"),
        title.alias("section_title"), F.col("quern_path").alias("section_path"), F.col("parent").alias("part_number"), "page_numbers",
        F.when(F.col("quern_url") != "", F.array("quern_url")).otherwise(F.array().cast("array<string>")).alias("source_urls"), text.alias("parent_text"), T.token_count(text).alias("token_count"),
        F.transform("held", lambda e: e["element_id"]).alias("element_ids"), "first_at", "first_id",
    )


def _child(rows: DataFrame, by: list[str], text: Column) -> DataFrame:
    """The columns of a child that its elements give: provenance, contents, positions. ``text`` is the text that an element adds."""
    held = F.array_sort(F.collect_list(F.struct("sequence", "element_id", text.alias("t"), "page_number", "bbox")))
    is_table = F.col("element_type") == "table"
    only = lambda c: F.max(F.when(is_table, F.col(c))).alias(c)  # noqa: E731  (a table is alone in its child)
    made = rows.groupBy(*by).agg(
        held.alias("held"), _sorted_set("page_number").alias("page_numbers"), F.array_sort(F.array_distinct(F.filter(F.collect_list("source_url"), lambda u: u != ""))).alias("source_urls"),
        _sorted_set("source_row_numbers", flat=True).alias("source_row_numbers"), only("table_markdown"), only("table_html"), only("split"),
    )
    return made.select(
        *by, "page_numbers", "source_urls", "source_row_numbers", T.clean_text(F.array_join(F.transform("held", lambda e: F.coalesce(e["t"], F.lit(""))), "\n\n")).alias("text_content"), "table_markdown", "table_html", "split",
        F.transform("held", lambda e: e["element_id"]).alias("element_ids"),
        F.transform("held", lambda e: F.struct(e["element_id"].alias("element_id"), e["sequence"].alias("sequence"), e["page_number"].alias("page_number"), e["bbox"].alias("bbox"))).alias("element_positions"),
    )


def children_of(rows: DataFrame) -> DataFrame:
    """Children of placed elements by section, parent and number."""
    text = F.when(F.col("element_type") != "table", F.coalesce("text", F.lit("")))
    return _child(rows.where(F.col("child").isNotNull()), [*_SECTION, "parent", "child"], text)


def image_rows(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """The images of placed elements with their parent, and what their attachment needs."""
    key = [F.col(f"i.{c}") == F.col(f"p.{c}") for c in _SECTION] + [F.col("i.parent") == F.col("p.part_number")]
    small = F.coalesce((F.col("i.metadata.selection_reason") == CHART_CROP) & (F.least("i.bbox.w", "i.bbox.h") < CHART_SIDE), F.lit(False))
    near = F.coalesce(F.col("i.metadata.nearby_table_markdown") != "", F.lit(False))
    return rows.where("element_type = 'image'").alias("i").join(parents.alias("p"), key).select(
        "i.*", F.col("p.parent_id").alias("parent_id"), F.col("p.section_title").alias("parent_title"), small.alias("tiny_chart"), near.alias("near_table")
    )


def attached(children: DataFrame, images: DataFrame) -> DataFrame:
    """(parent_id, image_id, child_id, method, score) for the images of each parent, see ``attach.attach_images``. children have child_id and parent_id."""
    boxed = F.filter("element_positions", lambda b: (b["bbox"]["x"] + b["bbox"]["y"] + b["bbox"]["w"] + b["bbox"]["h"]).isNotNull())
    middle = lambda b: F.struct((b["bbox"]["x"] + b["bbox"]["w"] / 2).alias("x"), (b["bbox"]["y"] + b["bbox"]["h"] / 2).alias("y"), b["page_number"].alias("page"))
    held = children.select(
        "parent_id", "child_id", F.col("page_numbers").alias("pages"), F.transform(boxed, middle).alias("places"), F.transform("element_positions", lambda b: b["sequence"]).alias("sequences"),
        F.element_at("element_positions", 1)["sequence"].alias("sequence"), F.concat_ws("\n", F.nullif("text_content", F.lit("")), F.nullif("table_markdown", F.lit(""))).alias("text"),
        (F.coalesce(F.col("table_markdown"), F.col("table_html"), F.lit("")) != "").alias("is_table"),
    )
    wanted = images.select(
        "parent_id", F.col("element_id").alias("image_id"), F.col("page_number").alias("page"), (F.col("bbox.x") + F.col("bbox.w") / 2).alias("x"), (F.col("bbox.y") + F.col("bbox.h") / 2).alias("y"),
        "sequence", F.coalesce("quern_context", F.lit("")).alias("context"), "tiny_chart", "near_table",
    )
    return attach.attach_images(held, wanted)


def _seen(images: DataFrame, method: Column, score: Column) -> Column:
    side = lambda c: clip_text(F.col(f"metadata.{c}"), SIDE_TOKENS).alias(c)
    return F.struct("image_path", side("nearby_text_before"), side("nearby_text_after"), F.col("metadata.selection_reason").alias("selection_reason"), method.alias("assignment_method"), score.cast("double").alias("assignment_score"))


def build(elements: DataFrame, limits: Limits = Limits(), split: bool = True) -> Chunks:
    """Parents and children of all documents.

    Sections come in the order of their first element; elements go by sequence, then element_id. Elements without a path are in the section of
    their title, else in ``Unsectioned``. A null type is text; null and empty texts are elements without words. Rows repeated by element_id are elements
    of their own. Documents without any content but headings have no chunks. An empty table gives none.
    """
    checkpoint_folder(elements.sparkSession)
    rows = expanded(elements) if split else elements.withColumn("split", F.lit(None).cast("struct<original_element_id:string,part:int,count:int,strategy:string,row_start:int,row_end:int>"))
    rows = placed(rows, limits).checkpoint()  # the one fold; parents, children and images are made from it
    parents = parents_of(rows).checkpoint()
    of = parents.select(*_SECTION, F.col("part_number").alias("parent"), "parent_id")
    children = children_of(rows).join(of, [*_SECTION, "parent"]).withColumn("child_id", stable_id(F.col("parent_id"), F.col("child")))
    children = children.select("parent_id", "child_id", F.col("child").alias("child_index"), *[c for c in children.columns if c not in (*_SECTION, "parent", "child", "parent_id", "child_id")])
    children = children.withColumn("matched_table_chunk_id", F.lit(None).cast("string")).checkpoint()  # read by all that follows
    images = image_rows(rows, parents).checkpoint()
    assigned = attached(children, images).checkpoint()
    count = children.groupBy("parent_id").agg(F.count("*").alias("n_children"))

    def made(found: DataFrame, text: Column, order: str, matched: Column) -> DataFrame:
        """Children made for images, numbered behind their parent's."""
        nth = F.row_number().over(Window.partitionBy("parent_id").orderBy(order, "element_id"))
        numbered = found.withColumn("nth", nth).join(count_now, "parent_id", "left").withColumn("child_index", (F.col("nth") + F.coalesce("n_children", F.lit(0))).cast("int"))
        new = _child(numbered.withColumns({"quern_text": text, "matched_table_chunk_id": matched}), ["parent_id", "child_index", "named", "matched_table_chunk_id"], F.col("quern_text"))
        return new.withColumn("child_id", stable_id(F.col("parent_id"), F.col("child_index")))

    # an image with words of its own around it and no child on its page has a child made for it
    count_now = count
    own = assigned.where(F.col("child_id") == F.concat("parent_id", F.lit(":image:"), "image_id")).select(F.col("image_id").alias("element_id"), "parent_id", F.col("child_id").alias("named"))
    fresh = made(images.join(own, ["element_id", "parent_id"]), F.col("quern_context"), "sequence", F.lit(None).cast("string"))
    children = children.unionByName(fresh.drop("named"))
    shown = images.join(assigned.select("parent_id", F.col("image_id").alias("element_id"), "child_id", "method", "score"), ["parent_id", "element_id"]).join(fresh.select("parent_id", F.col("named").alias("child_id"), F.col("child_id").alias("real")), ["parent_id", "child_id"], "left")
    shown = shown.withColumn("child_id", F.coalesce("real", "child_id"))
    # crops of tables that no child shows
    lost = images.where(F.col("metadata.selection_reason") == TABLE_CROP).join(shown.select("document_id", "image_path"), ["document_id", "image_path"], "left_anti")
    full = shown.groupBy("child_id").agg(F.countDistinct("image_path").alias("n_images"))
    doc_of = parents.select("parent_id", "document_id")
    candidates = children.join(doc_of, "parent_id").join(full, "child_id", "left").select(
        "document_id", "child_id", F.transform("page_numbers", lambda p: p).alias("pages"), F.element_at("element_positions", 1)["sequence"].alias("sequence"),
        (F.coalesce("table_markdown", "table_html", F.lit("")) != "").alias("is_table"), F.coalesce("n_images", F.lit(0)).alias("n_images"),
    )
    crops = attach.recovered_children(candidates, lost.select("document_id", "parent_id", F.col("element_id").alias("image_id"), F.col("page_number").alias("page"), "sequence"), by=["document_id"])
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit("page "), F.col("page_number"))).otherwise(NO_PAGE)
    crop, section, on, end = map(F.lit, CROP_NOTE)
    note = F.concat(crop, F.regexp_extract("image_path", r"[^/\\]*$", 0), section, "parent_title", on, page, end)
    count_now = children.groupBy("parent_id").agg(F.count("*").alias("n_children"))
    kept = crops.select("parent_id", F.col("image_id").alias("element_id"), F.col("child_id").alias("named"), "matched_table", "method")
    lost = lost.join(kept, ["parent_id", "element_id"])
    rescued = made(lost, note, "sequence", F.col("matched_table"))
    children = children.unionByName(rescued.drop("named"))
    shown_lost = lost.join(rescued.select("parent_id", "named", F.col("child_id").alias("to")), ["parent_id", "named"])
    pictures = shown.select("child_id", "sequence", "element_id", "page_number", _seen(shown, F.col("method"), F.col("score")).alias("seen")).unionByName(
        shown_lost.select(F.col("to").alias("child_id"), "sequence", "element_id", "page_number", _seen(shown_lost, F.col("method"), F.lit(None)).alias("seen"))
    )
    return finished(parents, children, pictures)


def finished(parents: DataFrame, children: DataFrame, pictures: DataFrame) -> Chunks:
    """Children with the images they show, what is embedded of them and its size; like ones of a document merged; parents with their number of children."""
    per = pictures.groupBy("child_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "element_id", "page_number", "seen"))).alias("quern_images"))
    rows = children.join(per, "child_id", "left").withColumn("quern_images", F.coalesce("quern_images", F.array().cast(per.schema["quern_images"].dataType)))
    of = parents.select("parent_id", "document_id", "domain", "source_type", "source_name", "section_title", "section_path", "part_number", "first_at", "first_id")
    rows = rows.join(of, "parent_id")
    # a passage that stands for a table, without one, gets one of its own
    bare = F.coalesce(F.nullif("table_markdown", F.lit("")), F.nullif("table_html", F.lit(""))).isNull()
    rows = rows.withColumn("quern_signal", F.when(bare, T.table_signal(F.col("source_name"), F.col("text_content"))))
    rows = rows.withColumn("quern_rescued", tables.rescued_table(F.col("quern_signal"), F.col("text_content")))
    rows = rows.withColumns({"table_markdown": F.coalesce("quern_rescued.markdown", "table_markdown"), "table_html": F.coalesce("quern_rescued.html", "table_html")})
    has_table = F.coalesce(F.nullif("table_markdown", F.lit("")), F.nullif("table_html", F.lit(""))).isNotNull()
    retrieval = T.retrieval_text(F.col("domain"), F.col("source_name"), F.col("section_title"), F.col("text_content"), F.col("table_markdown"))
    kinds = [F.when(F.col("text_content") != "", "text"), F.when(has_table, "table"), F.when(F.size("quern_images") > 0, "image")]
    rows = rows.select(
        F.col("child_id").alias("chunk_id"), F.lit("child_chunk").alias("retrieval_type"), "parent_id", "document_id", "domain", "source_type", "source_name", "section_title", "section_path", "part_number", "child_index", "first_at", "first_id",
        F.array_sort(F.array_union("page_numbers", F.array_compact(F.transform("quern_images", lambda i: i["page_number"])))).alias("page_numbers"), "source_urls", "source_row_numbers",
        F.array_compact(F.array(*kinds)).alias("modalities"), "text_content", "table_markdown", "table_html", F.array_distinct(F.transform("quern_images", lambda i: i["seen"]["image_path"])).alias("image_paths"),
        F.array_union("element_ids", F.transform("quern_images", lambda i: i["element_id"])).alias("element_ids"), retrieval.alias("retrieval_text"), T.token_count(retrieval).alias("token_count"),
        F.struct(
            F.coalesce(has_table & F.col("split").isNull() & F.col("quern_signal").isNull(), F.lit(False)).alias("table_kept_intact"), F.col("quern_signal").alias("table_rescue_strategy"), F.col("split").alias("table_split"), "matched_table_chunk_id", "element_positions",
            F.transform("quern_images", lambda i: i["seen"]).alias("image_context"),
        ).alias("metadata"),
    )
    rows = rows.withColumn("fingerprint", chunk_fingerprint(F.col("retrieval_text"), F.col("image_paths")))
    place = F.struct("first_at", "first_id", "part_number", "child_index", "chunk_id")
    united = ("page_numbers", "source_urls", "source_row_numbers", "element_ids")
    own = [c for c in rows.columns if c not in (*united, "document_id", "fingerprint", "first_at", "first_id")]
    order = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("parent_id").alias("v")))), lambda s: s["v"])
    merged = rows.groupBy("document_id", "fingerprint").agg(
        F.min_by(F.struct(*own), place).alias("own"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in united], F.count("*").alias("duplicate_occurrences"), F.array_distinct(order).alias("quern_parents"),
    )
    merged = merged.select("document_id", "fingerprint", "own.*", *united, "duplicate_occurrences", "quern_parents")
    merged = merged.withColumns({
        "alternate_parent_ids": F.array_remove("quern_parents", F.col("parent_id")), "omitted_image_count": F.greatest(F.size("image_paths") - IMAGES_MAX, F.lit(0)), "image_paths": F.slice("image_paths", 1, IMAGES_MAX),
    }).drop("quern_parents").checkpoint()
    with_count = parents.join(merged.groupBy("parent_id").agg(F.count("*").alias("child_count")), "parent_id")
    return Chunks(with_count.drop("quern_url", "quern_path", "first_at", "first_id"), merged)


def category_chunks(elements: DataFrame) -> Chunks:
    """Survey elements (see ``normalize.from_categories``), which are chunks already: a child each, and a parent for each profile that lists its categories.

    The table of a child is left out of what is embedded, since its text says the same.
    """
    listed = F.array_sort(F.collect_list(F.struct("sequence", "element_id", "section_title")))
    made = elements.groupBy("profile_id", "facility_id").agg(
        listed.alias("held"), *[F.min_by(c, F.struct("sequence", "element_id")).alias(c) for c in ("document_id", "domain", "source_name", "hospital_name", "state")], F.count("*").alias("child_count")
    )
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c), F.lit("None")))
    hospital, facility, state, categories = PROFILE_LINES
    text = F.concat_ws("\n", line(hospital, "hospital_name"), line(facility, "facility_id"), line(state, "state"), F.concat(F.lit(categories), F.array_join(F.transform("held", lambda h: h["section_title"]), ", ")))
    parents = made.select(
        F.col("profile_id").alias("parent_id"), "document_id", "domain", F.lit("csv").alias("source_type"), "source_name", F.col("hospital_name").alias("section_title"), F.array("hospital_name").alias("section_path"), F.lit(1).alias("part_number"),
        text.alias("parent_text"), T.token_count(text).alias("token_count"), F.transform("held", lambda h: h["element_id"]).alias("element_ids"), "facility_id", "child_count",
    )
    shown = T.retrieval_text(F.col("domain"), F.col("source_name"), F.col("section_title"), F.col("text"), F.col("table_markdown"), F.lit(True))
    children = elements.select(
        F.col("element_id").alias("chunk_id"), F.lit("hospital_category_doc").alias("retrieval_type"), F.col("profile_id").alias("parent_id"), "document_id", "domain", F.lit("csv").alias("source_type"), "source_name", "section_title", "section_path", "source_row_numbers",
        F.array(F.lit("text"), F.lit("table")).alias("modalities"), F.col("text").alias("text_content"), "table_markdown", F.array("element_id").alias("element_ids"), shown.alias("retrieval_text"), T.token_count(shown).alias("token_count"), "facility_id",
    )
    return Chunks(parents, children)
