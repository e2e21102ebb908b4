"""Images to children of a parent: in order, to the child that fits best and has room, or to a child made of their own context."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.chunking import IMAGES_MAX

ASSIGNED = "parent_id string, image_id string, child_id string, method string, score double"
_TERM = re.compile(r"\w[\w-]+\w")


def _terms(text: str | None) -> set[str]:
    return set(_TERM.findall((text or "").lower()))


def _known(x: float | None) -> bool:
    return x is not None and not math.isnan(x)


def _places(child: dict) -> list[dict]:
    """The middles of a child's boxes: of its elements, or the one it has itself."""
    if child.get("places") is not None:
        return list(child["places"])
    return [{"x": child["x"], "y": child["y"], "page": None}] if _known(child["x"]) else []


def misfit(image: dict, child: dict) -> tuple[float, bool]:
    """(score, whether the pages agree); rules as in ``images.child_misfit``."""
    pages, page = set(child["pages"]), image["page"]
    known = page is not None and not math.isnan(page)
    same = known and int(page) in pages
    total = 0.0 if same else 80.0 if not known or not pages else 160 + 20 * min(abs(page - p) for p in pages)
    near = [math.hypot(image["x"] - p["x"], image["y"] - p["y"]) for p in _places(child) if not known or p["page"] is None or p["page"] == page] if _known(image["x"]) else []
    total += min(min(near) / 40, 50) if near else 20
    at = child.get("sequences")
    total += min(3 * min(abs(image["sequence"] - s) for s in (at if at is not None and len(at) else [child["sequence"]])), 60)
    a, b = _terms(image["context"]), _terms(child["text"])
    total -= min(50 * len(a & b) / max(1, min(len(a), len(b))), 50) if a and b else 0
    return round(total - (12 if child["is_table"] and image.get("near_table", True) else 0), 4), same


def attach_one(parent: str, children: list[dict], images: list[dict]) -> list[tuple]:
    """Assignments of one parent. The children that are made for images take part for the images behind."""
    room = {c["child_id"]: IMAGES_MAX for c in children}
    pool, out = list(children), []
    for image in sorted(images, key=lambda i: (i["sequence"], i["image_id"])):
        if image["tiny_chart"]:
            continue
        scored = [(*misfit(image, c), n) for n, c in enumerate(pool) if room[c["child_id"]] > 0]
        best = min(scored, key=lambda s: (s[0], s[2]), default=None)
        if best and best[1]:
            child, method, score = pool[best[2]]["child_id"], "weighted_geometry", best[0]
        elif image["context"]:
            child, method, score = f"{parent}:image:{image['image_id']}", "contextual_fallback", best[0] if best else None
            pages = [int(image["page"])] if image["page"] is not None and not math.isnan(image["page"]) else []
            own = [{"x": image["x"], "y": image["y"], "page": None}] if _known(image["x"]) else []
            pool.append({"child_id": child, "pages": pages, "places": own, "sequence": image["sequence"], "text": image["context"], "is_table": False})
            room[child] = IMAGES_MAX
        else:
            continue
        room[child] -= 1
        out.append((parent, image["image_id"], child, method, score))
    return out


def attach_images(children: DataFrame, images: DataFrame) -> DataFrame:
    """ASSIGNED rows. children: parent_id, child_id, pages ARRAY<INT>, x, y, sequence, text, is_table, or, instead of x and y, places ARRAY<STRUCT<x, y, page>> and sequences
    of their elements; images: parent_id, image_id, page, x, y, sequence, context, tiny_chart, and near_table if only images beside a table prefer tables.

    Rows without a parent take no part, nor do children of parents without images. Each image changes what is left for the next, so a parent is a task's loop; a parent is a section of a few thousand tokens.
    """

    def run(key: tuple, own: pd.DataFrame, pictures: pd.DataFrame) -> pd.DataFrame:
        rows = attach_one(key[0], own.sort_values(["sequence", "child_id"]).to_dict("records"), pictures.to_dict("records"))
        return pd.DataFrame(rows, columns=["parent_id", "image_id", "child_id", "method", "score"])

    images = images.where("parent_id IS NOT NULL")
    children = children.join(images.select("parent_id").distinct(), "parent_id", "left_semi")
    return children.groupBy("parent_id").cogroup(images.groupBy("parent_id")).applyInPandas(run, ASSIGNED)


def recovered_children(children: DataFrame, crops: DataFrame, most: int = IMAGES_MAX, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(parent_id, image_id, child_id, matched_table, method): a new child for every unattached table crop with a parent.

    matched_table is the nearest table child on the crop's page that has fewer than ``most`` images of its own; a crop
    without one has method ``visual_table_fallback``. The crop goes to the new child, so any number may name one table.
    children: child_id, pages, sequence, is_table, n_images; crops: parent_id, image_id, page, sequence; both have the columns ``by``, in which they must agree.
    """
    tables = children.where(F.col("is_table") & (F.col("n_images") < most)).select(*by, "child_id", F.col("sequence").alias("at"), F.explode("pages").alias("page"))
    pairs = crops.where("parent_id IS NOT NULL").join(tables, [*by, "page"], "left").withColumn("gap", F.abs(F.col("sequence") - F.col("at")))
    nearest = F.min_by("child_id", F.when(F.col("child_id").isNotNull(), F.struct("gap", "child_id"))).alias("matched_table")
    found = pairs.groupBy("parent_id", "image_id").agg(nearest)
    method = F.when(F.col("matched_table").isNull(), "visual_table_fallback").otherwise("document_same_page_table_reference")
    return found.select("parent_id", "image_id", F.concat("parent_id", F.lit(":image:"), "image_id").alias("child_id"), "matched_table", method.alias("method"))
