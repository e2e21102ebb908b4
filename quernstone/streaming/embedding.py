"""Incremental embedding as a stream: new or changed chunks are encoded once, and a stop loses nothing.

Chunks arrive as files of a folder. Each micro-batch keeps the last version of a chunk, drops those whose
input hash is that of the chunk's current vector, encodes the rest and appends them under the batch's number, which
replaces what an interrupted attempt of that batch has left. A chunk that goes back to an earlier text is encoded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.store import last_wins

CHUNK = "chunk_id string, text string, input_hash string, seq long"


def embed_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> None:
    """Runs over all files that are there, then ends. ``encode`` adds a vector column to (chunk_id, text, input_hash, seq)."""

    def done(number: int) -> DataFrame | None:
        """The current input of each chunk by the other batches: rows that an interrupted attempt of this one has left are written anew. Reads no vectors."""
        try:
            return last_wins(spark.read.parquet(out).where(F.col("batch") != number).select("chunk_id", "input_hash", "batch"), ["chunk_id"], "batch")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def batch(rows: DataFrame, number: int) -> None:
        fresh = last_wins(rows, ["chunk_id"], "seq")
        have = done(number)
        if have is not None:
            same = fresh["chunk_id"].eqNullSafe(have["chunk_id"]) & fresh["input_hash"].eqNullSafe(have["input_hash"])
            fresh = fresh.join(have, same, "left_anti")
        encode(fresh).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_batch).json(folder)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_vectors(spark: SparkSession, out: str) -> DataFrame:
    """The newest vector of each chunk."""
    return last_wins(spark.read.parquet(out), ["chunk_id"], "batch")
