"""Rows pinned in shared storage, where a plan reads them twice and both reads must agree."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees to a folder for checkpoints: the cluster's, by ``spark.checkpoint.dir``; one of our own only in a local session."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quernstone-"))


#: Rows in an Arrow batch, so that a batch of long texts fits a Python worker.
ARROW_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet, in the folder of checkpoints, which the driver and all executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def pinned(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the folder of checkpoints."""
    path = new_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, order: Column, name: str, first: int = 0) -> DataFrame:
    """Rows numbered from ``first`` in the order given.

    Rows are dealt to ranges and sorted once; each row's range and its place there are pinned by a checkpoint, so that no
    second run of the ranges (whose borders are sampled) can deal them otherwise. The ranges before are summed, a row a range.
    """
    checkpoint_folder(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("quern_order", order).repartitionByRange(n, "quern_order").withColumn("quern_part", F.spark_partition_id())
    place = Window.partitionBy("quern_part").orderBy("quern_order")
    pinned = ranged.withColumn("quern_nth", F.row_number().over(place)).drop("quern_order").checkpoint()
    sizes = pinned.groupBy("quern_part").agg(F.max("quern_nth").alias("n"))
    before = sizes.withColumn("quern_before", F.sum("n").over(Window.orderBy("quern_part")) - F.col("n")).drop("n")
    return pinned.join(F.broadcast(before), "quern_part").withColumn(name, F.col("quern_nth") + F.col("quern_before") + (first - 1)).drop("quern_part", "quern_nth", "quern_before")


def running(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Rows with running sums (of whole numbers) in the order of each group, of which none need fit a task.

    Rows are dealt to ranges of (group, order) and summed there, pinned as in ``numbered``. Only the group that a range begins with may have begun
    before, so what is carried from range to range is a row a range at most. ``order`` must be unique in a group, else ties are in any order.
    """
    checkpoint_folder(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumns({f"quern_{c}": x.cast("long") for c, x in sums.items()}).repartitionByRange(n, *by, order).withColumn("quern_part", F.spark_partition_id())
    inside = Window.partitionBy("quern_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pinned = ranged.select(*rows.columns, "quern_part", *[F.sum(f"quern_{c}").over(inside).alias(c) for c in sums], *[f"quern_{c}" for c in sums]).checkpoint()
    totals = pinned.groupBy("quern_part", *by).agg(*[F.sum(f"quern_{c}").alias(f"quern_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("quern_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of the group
    carried = totals.select(F.col("quern_part").alias("quern_p"), *[F.col(c).alias(f"quern_by{i}") for i, c in enumerate(by)], *[F.sum(f"quern_{c}").over(earlier).alias(f"quern_before_{c}") for c in sums])
    first = next(iter(sums))
    carried = carried.where(F.col(f"quern_before_{first}").isNotNull())
    same = F.col("quern_part") == F.col("quern_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"quern_by{i}"))
    return pinned.join(F.broadcast(carried), same, "left").select(*rows.columns, *[(F.col(c) + F.coalesce(f"quern_before_{c}", F.lit(0))).alias(c) for c in sums])
