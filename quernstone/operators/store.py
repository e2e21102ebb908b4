"""Merging writes, work that is pending, progress and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the last by order: what several writes of a batch leave."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("quern_last")).select(*key, *[F.col(f"quern_last.{c}").alias(c) for c in rest])


def one_a_key(rows: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """Rows of distinct keys: of a key's rows the last by ``order``; without an order, a key that comes twice is an error. The shuffle is that of the join behind it."""
    if order is not None:
        return last_wins(rows, key, order)
    rest = [c for c in rows.columns if c not in key]
    counted = rows.groupBy(*key).agg(F.count("*").alias("quern_n"), F.first(F.struct(*rest)).alias("quern_row") if rest else F.lit(None).alias("quern_row"))
    twice = F.raise_error(F.concat(F.lit("rows to be written hold a key twice: "), F.to_json(F.struct(*key))))
    checked = counted.withColumn("quern_row", F.when(F.col("quern_n") > 1, twice).otherwise(F.col("quern_row"))) if rest else counted.where(F.when(F.col("quern_n") > 1, twice.cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*key, *[F.col(f"quern_row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """old with the rows of new: a new row replaces all columns but those of ``keep``, which stay where the key exists.

    Keys of new must be distinct, or ``order`` says which row of a key is the last. A null key matches none.
    """
    new = one_a_key(new, key, order)
    a, b = old.withColumn("quern_old", F.lit(True)).alias("a"), new.withColumn("quern_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
    was, comes = F.col("quern_old").isNotNull(), F.col("quern_new").isNotNull()

    def value(c: str) -> Column:
        if c in key:
            return F.coalesce(f"b.{c}", f"a.{c}").alias(c)
        if c not in new.columns:
            return F.col(f"a.{c}").alias(c)
        return F.when(comes & (~was if c in keep else F.lit(True)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def upsert_invalidating(old: DataFrame, new: DataFrame, key: list[str], guard: str, derived: list[str], order: str | None = None) -> DataFrame:
    """An upsert after which derived columns are null wherever the guard has changed (a null differs from a value). Repeated keys are as in ``upsert``."""
    new = one_a_key(new, key, order)
    a, b = old.alias("a"), new.withColumn("quern_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
    comes, same = F.col("quern_new").isNotNull(), F.col(f"a.{guard}").eqNullSafe(F.col(f"b.{guard}"))

    def value(c: str) -> Column:
        if c in key:
            return F.coalesce(f"b.{c}", f"a.{c}").alias(c)
        if c in derived:
            return F.when(~comes | same, F.col(f"a.{c}")).alias(c)
        return F.when(comes, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def needs_embedding(vector: Column, model: Column, dimension: Column, want_model: str, want_dimension: int) -> Column:
    """No vector, or one of another model or dimension."""
    return vector.isNull() | ~model.eqNullSafe(F.lit(want_model)) | ~dimension.eqNullSafe(F.lit(want_dimension))


def progress(rows: DataFrame, done: Column, counted: Column | None = None) -> DataFrame:
    """total, completed, pending. Rows outside ``counted`` are not in the total, but completed ones count."""
    inside = F.lit(True) if counted is None else counted
    return rows.agg(F.count_if(inside).alias("total"), F.count_if(done).alias("completed"), F.count_if(inside & ~done).alias("pending"))


def with_any(documents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return documents.join(children.select(key), key, "left_semi")


def with_all(documents: DataFrame, children: DataFrame, key: str, pending: Column) -> DataFrame:
    """Documents that have children, none of them pending."""
    return with_any(documents, children, key).join(children.where(pending).select(key), key, "left_anti")


def json_set(column: Column, key: str, value: Column) -> Column:
    """A JSON object text with one top-level key set to a text; other values keep their types. Null or broken text starts empty.

    Of a key that is there twice the last value stays.
    """
    entries = F.coalesce(F.map_entries(F.from_json(column, "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    new = F.struct(F.lit(key).alias("key"), F.parse_json(F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("v"))), r"^\{\"v\":(.*)\}$", 1)).alias("value"))
    again = lambda e, i: F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"])
    others = F.filter(entries, lambda e, i: (e["key"] != key) & ~again(e, i))
    return F.to_json(F.map_from_entries(F.concat(others, F.array(new))))


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Clear and reload: only the partitions that rows hold are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def fill_vectors(chunks: DataFrame, vectors: DataFrame, key: str, column: str) -> DataFrame:
    """chunks with newly computed vectors; others keep theirs."""
    new = vectors.select(key, F.col(column).alias("quern_vector"))
    return chunks.join(new, key, "left").withColumn(column, F.coalesce("quern_vector", column)).drop("quern_vector")


def append_records(records: DataFrame, columns: list[str], path: str, *by: str) -> None:
    """Appends records as they are, without looking for their keys. Columns come in the order given; one that is missing is null, others are left out."""
    known = {c.lower(): c for c in records.columns}
    rows = records.select(*[F.col(f"`{known[c.lower()]}`").alias(c) if c.lower() in known else F.lit(None).cast("string").alias(c) for c in columns])
    rows.write.mode("append").partitionBy(*by).parquet(path)


def upsert_stamped(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), order: str | None = None, now: Column | None = None) -> DataFrame:
    """An upsert of rows with created_at and updated_at: a row that is there keeps when it was made, rows that come are stamped with the time of the query."""
    now = F.current_timestamp() if now is None else now
    stamped = new.drop("created_at", "updated_at").withColumns({"created_at": now, "updated_at": now})
    return upsert(old, stamped, key, (*keep, "created_at"), order)
