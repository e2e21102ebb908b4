"""Ordered structure of parsed pages: headings, reading order, neighbours, first occurrences, page signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
#: Fixed value: a page with fewer characters than this has little text.
LOW_TEXT = 250


def section_paths(elements: DataFrame, by: list[str], order: str, level: Column, title: Column) -> DataFrame:
    """Adds section_path ARRAY<STRING>: the open headings at each row; a heading closes those of its level and below."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = elements.withColumns({"quern_level": level, "quern_title": title})
    last = lambda n: F.last(F.when(F.col("quern_level") <= n, F.struct("quern_level", "quern_title")), ignorenulls=True).over(upto)
    open_at = [F.when(last(n)["quern_level"] == n, last(n)["quern_title"]) for n in range(1, LEVELS + 1)]
    return heads.withColumn("section_path", F.array_compact(F.array(*open_at))).drop("quern_level", "quern_title")


def reading_order(rows: DataFrame, by: list[str], y: Column, is_image: Column, tie: str) -> DataFrame:
    """Adds position: top to bottom, unplaced last, text before images at one height, then input order."""
    order = Window.partitionBy(*by).orderBy(F.coalesce(y.cast("double"), F.lit(float("inf"))), is_image.cast("int"), tie)
    return rows.withColumn("position", F.row_number().over(order))


def neighbours(rows: DataFrame, by: list[str], order: str, text: Column) -> DataFrame:
    """Adds text_before and text_after: the nearest rows with text on either side."""
    ahead = Window.partitionBy(*by).orderBy(order)
    some = F.nullif(F.trim(text), F.lit(""))
    return rows.withColumns({
        "text_before": F.last(some, ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, -1)),
        "text_after": F.first(some, ignorenulls=True).over(ahead.rowsBetween(1, Window.unboundedFollowing)),
    })


def first_occurrences(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("quern_first"))
    return picked.select(*by, *[F.col(f"quern_first.{c}").alias(c) for c in rest])


def page_signals(rows: DataFrame, by: list[str], text: Column, kind: Column, concerns: Column) -> DataFrame:
    """Per page: has_table, has_parse_concerns, text_chars (without headers and footers), low_text."""
    body = F.when(~kind.isin("header", "footer"), F.length(F.coalesce(text, F.lit("")))).otherwise(0)
    out = rows.groupBy(*by).agg(F.bool_or(kind == "table").alias("has_table"), F.bool_or(concerns).alias("has_parse_concerns"), F.sum(body).alias("text_chars"))
    return out.withColumn("low_text", F.col("text_chars") < LOW_TEXT)
