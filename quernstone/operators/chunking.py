"""Elements to parents and children: ordered packing, provenance, merge of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.ids import stable_id

IMAGES_MAX = 3


def pack(rows: DataFrame, key: str, order: str, n: Column, limit: int) -> DataFrame:
    """(key, order, n, part): greedy packing of each key's rows in order, a new part where the sum would pass the limit.

    A key's rows form one array: a document's elements, not a table's.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("seq"), n.cast("int").alias("n"))))
    packed = rows.groupBy(key).agg(items.alias("items"))
    zipped = F.arrays_zip(F.col("items").alias("i"), T.pack_groups(F.col("items"), limit).alias("g"))
    return packed.select(key, F.explode(zipped).alias("z")).select(key, F.col("z.i.seq").alias(order), F.col("z.i.n").alias("n"), F.col("z.g").alias("part"))


def pack_children(rows: DataFrame, key: str, order: str, n: Column, is_table: Column, buffer: int = T.BUFFER_MAX, target: int = T.CHILD_TARGET) -> DataFrame:
    """(key, order, n, is_table, part): like ``pack``, but a table is a part of its own and a part that has reached the target ends."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("seq"), n.cast("int").alias("n"), is_table.alias("table"))))
    zero = F.struct(F.lit(-1).alias("part"), F.lit(0).alias("sum"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        joins = s["open"] & ~i["table"] & (s["sum"] + i["n"] <= buffer)
        part = F.when(joins, s["part"]).otherwise(s["part"] + 1)
        total = F.when(joins, s["sum"] + i["n"]).otherwise(i["n"])
        return F.struct(part.alias("part"), total.cast("int").alias("sum"), (~i["table"] & (total < target)).alias("open"), F.concat(s["out"], F.array(part)).alias("out"))

    packed = rows.groupBy(key).agg(items.alias("items"))
    zipped = F.arrays_zip(F.col("items").alias("i"), F.aggregate("items", zero, step)["out"].alias("g"))
    return packed.select(key, F.explode(zipped).alias("z")).select(
        key, F.col("z.i.seq").alias(order), F.col("z.i.n").alias("n"), F.col("z.i.table").alias("is_table"), F.col("z.g").alias("part")
    )


def expand_oversized(elements: DataFrame, limit: int = T.PIECE_MAX) -> DataFrame:
    """Texts over the limit become pieces with fractional sequence numbers; others keep theirs. Adds piece and pieces."""
    parts = T.split_pieces(F.col("text"), limit)
    rows = elements.withColumn("quern_parts", F.when(T.token_count("text") > limit, parts).otherwise(F.array("text")))
    rows = rows.select("*", F.size("quern_parts").alias("pieces"), F.posexplode("quern_parts").alias("piece", "part"))
    sequence = F.col("sequence") + F.when(F.col("pieces") > 1, (F.col("piece") + 1) / (F.col("pieces") + 1)).otherwise(0.0)
    return rows.withColumns({"sequence": sequence.cast("double"), "text": F.col("part")}).drop("quern_parts", "part")


def build_parents(elements: DataFrame, limit: int = T.PARENT_MAX) -> DataFrame:
    """Parents of (document_id, section, sequence, text, page): parent_id, part, text, pages, first and last sequence.

    Elements are packed by section in order; headings are in the section, not in the text.
    """
    body = elements.where(F.coalesce(F.col("element_type"), F.lit("text")) != "heading").withColumn("quern_key", F.concat_ws("\u0001", "document_id", "section"))
    packed = pack(body.withColumn("n", T.token_count("text")), "quern_key", "sequence", F.col("n"), limit)
    rows = body.join(packed.select("quern_key", "sequence", "part"), ["quern_key", "sequence"])
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "text")))
    parents = rows.groupBy("document_id", "section", "part").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n").alias("text"),
        F.array_sort(F.collect_set("page")).alias("pages"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n_elements"),
    )
    return parents.withColumns({"parent_id": stable_id(F.col("document_id"), F.col("section"), F.col("part")), "token_count": T.token_count("text")})


def merge_duplicates(children: DataFrame, images_max: int = IMAGES_MAX) -> DataFrame:
    """One child of each document and fingerprint, the first: merged pages, occurrences, other parents, images in order.

    children: document_id, fingerprint, seq, chunk_id, parent_id, pages ARRAY<INT>, images ARRAY<STRING>.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq"), F.col(c).alias("v")))), lambda s: s["v"])
    merged = children.groupBy("document_id", "fingerprint").agg(
        F.min_by("chunk_id", "seq").alias("chunk_id"), F.min_by("parent_id", "seq").alias("parent_id"), F.count("*").alias("occurrences"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        ordered("parent_id").alias("parents"), F.array_distinct(F.flatten(ordered("images"))).alias("all_images"),
    )
    return merged.select(
        "document_id", "fingerprint", "chunk_id", "parent_id", "occurrences", "pages",
        F.array_remove(F.array_distinct("parents"), F.col("parent_id")).alias("alternate_parents"),
        F.slice("all_images", 1, images_max).alias("images"), F.greatest(F.size("all_images") - images_max, F.lit(0)).alias("omitted_images"),
    )


def with_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents that have children, with their number."""
    return parents.join(children.groupBy("parent_id").agg(F.count("*").alias("child_count")), "parent_id")
