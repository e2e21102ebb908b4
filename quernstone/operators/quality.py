"""Reports: nearest-rank percentiles, chunk quality, metric averages, work left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.storage import numbered


def percentile(x: Column, fraction: float) -> Column:
    """Nearest rank, half to even, as an aggregate. Counts of each value are combined before the shuffle.

    Exact: the value at place round((n-1)*fraction) of all sorted values.
    """
    return F.sort_array(F.collect_list(x))[F.bround((F.count(x) - 1) * F.lit(float(fraction))).cast("int")]


def token_stats(rows: DataFrame, by: list[str], n: str, fraction: float = 0.95) -> DataFrame:
    """count, min, mean, percentile and max of a whole-number column, per group, or over all if by is empty.

    The percentile comes from running counts of distinct values, so no group is held as a list.
    """
    from pyspark.sql import Window

    counts = rows.where(F.col(n).isNotNull()).groupBy(*by, n).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*(by or [F.lit(1)])).orderBy(n).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    placed = counts.withColumns({"upto": F.sum("c").over(upto), "all": F.sum("c").over(whole)})
    rank = F.bround((F.col("all") - 1) * F.lit(float(fraction)))
    return placed.groupBy(*by).agg(
        F.sum("c").alias("n"), F.min(n).alias("least"), (F.sum(F.col(n) * F.col("c")) / F.sum("c")).alias("mean"),
        F.min(F.when(F.col("upto") > rank, F.col(n))).alias("p95"), F.max(n).alias("most"),
    )


def clean_metric(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def metric_averages(traces: DataFrame, metrics: dict[str, Column], by: Column | None = None) -> DataFrame:
    """Mean of the finite values of each metric, and n of all traces; grouped by a key if given, blank keys as unknown."""
    means = [F.avg(clean_metric(c)).alias(name) for name, c in metrics.items()]
    if by is None:
        return traces.agg(F.count("*").alias("n"), *means)
    return traces.groupBy(F.coalesce(F.nullif(by, F.lit("")), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"), *means)


def in_scope(domain: Column, out: str = "out_of_scope") -> Column:
    """A null domain counts as in scope."""
    return ~domain.eqNullSafe(F.lit(out))


def completed(scores: Column, metrics: tuple[str, ...]) -> Column:
    """All metrics are there; a null value counts."""
    out = F.lit(True)
    for m in metrics:
        out = out & F.map_contains_key(scores, m)
    return out


def round_robin(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Adds worker = (place in order) mod n."""
    return numbered(rows, F.col(order), "quern_at").withColumn("worker", F.pmod("quern_at", F.lit(n)).cast("long")).drop("quern_at")


def histogram(rows: DataFrame, key: Column, name: str, by: str = "document_id") -> DataFrame:
    """(by, name MAP<STRING, BIGINT>): how many rows of each key; rows without a key are not counted."""
    counts = rows.select(by, key.alias("quern_key")).where(F.col("quern_key").isNotNull()).groupBy(by, "quern_key").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("quern_key", "n")))).alias(name))


def chunk_report(parents: DataFrame, children: DataFrame, child_most: int = 700, images_most: int = 3, images: DataFrame | None = None) -> DataFrame:
    """One row a document on the parents and children of ``document_chunks``: numbers, token statistics, histograms of modalities, split strategies and image
    assignments, and how many chunks are empty, images only, repeated, too large (tables or not), over the limit of images, or show an image that is not in ``images`` (image_path);
    and how many parents have no child. parents may hold such ones; they come from ``document_chunks.parents_of``.
    """
    is_table, has_text = F.array_contains("modalities", "table"), F.coalesce(F.trim("text_content"), F.lit("")) != ""
    only_image = (F.size("image_paths") > 0) & ~has_text & (F.coalesce("table_markdown", F.lit("")) == "")
    repeats = children.groupBy("document_id", "fingerprint").agg(F.count("*").alias("n")).groupBy("document_id").agg(F.sum(F.col("n") - 1).alias("duplicate_chunks"))
    counts = children.groupBy("document_id").agg(
        F.count("*").alias("children"), F.count_if(F.trim("retrieval_text") == "").alias("empty_chunks"), F.count_if(only_image).alias("image_only_chunks"), F.count_if(is_table).alias("table_chunks"),
        F.count_if((F.col("token_count") > child_most) & ~is_table).alias("oversized_non_table"), F.count_if((F.col("token_count") > child_most) & is_table).alias("oversized_table"), F.count_if(F.size("image_paths") > images_most).alias("over_image_limit"),
        F.countDistinct("metadata.table_split.original_element_id").alias("tables_split"),
    )
    seen = children.select("document_id", F.explode("metadata.image_context").alias("i"))
    stats = lambda rows, prefix: token_stats(rows, ["document_id"], "token_count").select("document_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("least", "mean", "p95", "most")])
    childless = parents.join(children.select("parent_id").distinct(), "parent_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("parents_without_children"))
    parts = [
        counts, repeats, stats(children, "child"), stats(parents, "parent"), childless, histogram(children, F.array_join("modalities", "+"), "modalities"), histogram(children, F.col("metadata.table_split.strategy"), "split_strategies"),
        histogram(seen, F.coalesce(F.col("i.assignment_method"), F.lit("unknown")), "image_assignments"),
    ]
    if images is not None:
        shown = children.select("document_id", F.explode("image_paths").alias("image_path"))
        parts.append(shown.join(images.select("image_path").distinct(), "image_path", "left_anti").groupBy("document_id").agg(F.count("*").alias("missing_images")))
    out = parents.groupBy("document_id").agg(F.count("*").alias("parents"))
    for part in parts:
        out = out.join(part, "document_id", "left")
    numbers = [f.name for f in out.schema.fields if f.dataType.simpleString() == "bigint"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})


def first_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first rows in an order, all if no number is given. Ties beyond the order are in any order, so it should be unique."""
    return rows if most is None else rows.orderBy(order).limit(most)
