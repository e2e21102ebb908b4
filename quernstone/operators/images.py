"""Image selection and attachment rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Repeats that make an image decoration, layout images of a page, overlap and area limits.
REPEAT_PAGES, PAGE_LAYOUT = 3, 4
OVERLAP, AREA_LOW, AREA_HIGH = 0.9, 0.7, 1.4


def assess(width: Column, height: Column, stddev: Column, white: Column, dark: Column, red: Column, category: Column, name: Column, complex_page: Column) -> Column:
    """STRUCT<decision, reason> of one image; the first rule that holds decides."""
    ratio = width / height
    lower = F.lower(name)
    verdict = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    mark = ((white > 0.85) & (dark < 0.015) & (red > 0.02)) | ((white > 0.80) & (dark < 0.02) & (red > 0.10))
    return (
        F.when((width < 100) | (height < 100) | (width * height < 20_000), verdict("reject", "small icon or label"))
        .when((ratio > 8) | (ratio < 0.125), verdict("reject", "extreme decorative aspect ratio"))
        .when(stddev < 5, verdict("reject", "nearly blank or single-color image"))
        .when(mark, verdict("reject", "watermark-only crop"))
        .when((category == "layout") & lower.contains("_table_"), verdict("keep", "layout table or form crop"))
        .when((category == "layout") & lower.contains("_chart_"), verdict("keep", "layout chart crop"))
        .when((category == "layout") & complex_page, verdict("keep", "layout visual from complex or low-text page"))
        .when(category == "layout", verdict("reject", "layout image without page-complexity signal"))
        .otherwise(verdict("keep", "unique meaningful-size embedded image"))
    )


def repeated(images: DataFrame, pages: int = REPEAT_PAGES) -> DataFrame:
    """Hashes that stand on so many distinct pages or more; images without a page share one."""
    return images.groupBy("hash").agg(F.countDistinct(F.coalesce(F.col("page"), F.lit(-1))).alias("n_pages")).where(F.col("n_pages") >= pages)


def best_duplicate(images: DataFrame) -> DataFrame:
    """One image of each hash: embedded before layout, tables and charts first, then the largest, then the first."""
    informative = F.lower("name").rlike("table|chart")
    order = Window.partitionBy("hash").orderBy(F.desc(F.col("category") == "embedded"), F.desc(informative), F.desc("area"), "image_id")
    return images.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == 1).drop("nth")


def page_cap(images: DataFrame, most: int = PAGE_LAYOUT) -> DataFrame:
    """The largest layout images of each page."""
    order = Window.partitionBy("page").orderBy(F.desc("area"), "image_id")
    return images.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")


def overlap_area(a: str, b: str) -> Column:
    """Shared area of two boxes with columns x, y, w, h under the two prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    side = lambda o, s: F.greatest(F.lit(0.0), F.least(c(a, o) + c(a, s), c(b, o) + c(b, s)) - F.greatest(c(a, o), c(b, o)))
    return side("x", "w") * side("y", "h")


def covered(layout: DataFrame, embedded: DataFrame) -> DataFrame:
    """Layout images that an embedded one of the same page nearly covers. Both: image_id, page, x, y, w, h."""
    a = layout.select("page", *[F.col(c).alias(f"a_{c}") for c in ("image_id", "x", "y", "w", "h")])
    b = embedded.select(F.col("page").alias("b_page"), *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "w", "h")])
    area = lambda p: F.col(f"{p}w") * F.col(f"{p}h")
    same = (
        (F.col("page") == F.col("b_page")) & (area("a_") / area("b_")).between(AREA_LOW, AREA_HIGH)
        & (overlap_area("a_", "b_") / F.least(area("a_"), area("b_")) >= OVERLAP)
    )
    return a.join(b, same, "left_semi").select(F.col("a_image_id").alias("image_id"), "page")


def child_misfit(page_gap: Column, same_page: Column, distance: Column, sequence_gap: Column, overlap: Column, is_table: Column) -> Column:
    """How badly an image fits a child; the smallest wins. A null page gap or distance means that one is unknown."""
    page = F.when(same_page, 0.0).when(page_gap.isNull(), 80.0).otherwise(160 + 20 * page_gap)
    box = F.when(distance.isNull(), 20.0).otherwise(F.least(distance / 40, F.lit(50.0)))
    return page + box + F.least(3 * sequence_gap, F.lit(60)) - F.least(50 * overlap, F.lit(50.0)) - F.when(is_table, 12.0).otherwise(0.0)


def child_score(*parts: Column) -> Column:
    """The misfit as it is stored, with four digits."""
    return F.bround(child_misfit(*parts), 4)


def filter_images(images: DataFrame, verdict: Column) -> DataFrame:
    """All images with decision and reason, by the steps in order: own merits, repeats, duplicates, covered layout crops, crowded pages.

    images: image_id, page, hash, category, name, area, x, y, w, h; verdict: as of ``assess``. A step sees what the steps before it have kept.
    """

    def reject(rows: DataFrame, bad: DataFrame, reason: str) -> DataFrame:
        hit = bad.select("image_id").distinct().withColumn("quern_bad", F.lit(True))
        marked = rows.join(hit, "image_id", "left")
        return marked.withColumns({"decision": F.when(F.col("quern_bad"), "reject").otherwise(F.col("decision")), "reason": F.when(F.col("quern_bad"), reason).otherwise(F.col("reason"))}).drop("quern_bad")

    keep, layout = F.col("decision") == "keep", F.col("category") == "layout"
    rows = images.withColumn("quern_v", verdict).select("*", "quern_v.decision", "quern_v.reason").drop("quern_v")
    rows = reject(rows, rows.where(keep).join(repeated(rows.where(keep)), "hash"), "repeated decorative image")
    rows = reject(rows, rows.where(keep).join(best_duplicate(rows.where(keep)), "image_id", "left_anti"), "duplicate image")
    rows = reject(rows, covered(rows.where(keep & layout), rows.where(keep & ~layout)), "layout crop of an embedded image")
    crowded = rows.where(keep & layout)
    return reject(rows, crowded.join(page_cap(crowded), "image_id", "left_anti"), "over the page's limit of layout images")


def pixel_metrics(pixels) -> dict[str, float | str]:
    """Size, ratios and perceptual hash of an image given as an array of height x width x RGB."""
    import hashlib

    import numpy as np

    rgb = np.asarray(pixels, np.float64)
    height, width = rgb.shape[:2]
    gray = rgb @ np.array([0.299, 0.587, 0.114])
    red = (rgb[..., 0] > 150) & (rgb[..., 1] < 110) & (rgb[..., 2] < 110)
    cells = [[gray[np.ix_(r, c)].mean() for c in np.array_split(np.arange(width), 16) if len(c)] for r in np.array_split(np.arange(height), 16) if len(r)]
    small = np.array(cells)
    bits = "".join("1" if x else "0" for x in (small >= small.mean()).ravel())
    return {
        "width": width, "height": height, "area": width * height, "aspect_ratio": round(width / height, 4), "grayscale_stddev": round(float(gray.std()), 4),
        "white_pixel_ratio": round(float((gray > 245).mean()), 4), "dark_pixel_ratio": round(float((gray < 80).mean()), 4), "red_pixel_ratio": round(float(red.mean()), 4),
        "perceptual_hash": hashlib.sha256(bits.encode()).hexdigest()[:32],
    }
