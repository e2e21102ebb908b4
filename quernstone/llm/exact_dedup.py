"""Exact deduplication with a heavy-hitter split.

1. Every row gets the SHA-256 digest of its text; (doc_id, digest) is written once.
2. Misra-Gries summaries of ``counters`` digests a partition are built in one pass.
   A digest that makes up more than 1/(counters+1) of all rows does so in some
   partition, so it is in some summary. The summaries' sums are cut to the
   ``counters`` largest again, which bounds what is broadcast.
3. The candidates are verified: their exact counts and the rows that stay come from
   a map-side aggregation of at most ``counters`` groups a task. Those of at least
   ``heavy`` rows are the winners.
4. Rows with a winner's digest are resolved by a broadcast join, without a shuffle.
   All other digests, which are rare by now, are shuffled and resolved by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import materialize

COUNTERS = 1024
HEAVY = 64


def misra_gries(items: Iterator, counters: int, into: dict | None = None) -> dict:
    """Misra-Gries summary of weighted items: at most ``counters`` of them, each with a lower bound of its weight."""
    held = {} if into is None else into
    for item, weight in items:
        if item in held:
            held[item] += weight
        elif len(held) < counters:
            held[item] = weight
        else:
            least = min(weight, min(held.values()))
            for k in [k for k, v in held.items() if v <= least]:
                del held[k]
            for k in held:
                held[k] -= least
            if weight > least:
                held[item] = weight - least
    return held


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            found = batch.column(0).value_counts()
            misra_gries(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True), counters, held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["digest", "least"])

    return run


def heavy_digests(keyed: DataFrame, counters: int) -> DataFrame:
    """Candidates for frequent digests: at most ``counters``, every digest of over 1/(counters+1) of the rows among them."""
    return (
        keyed.select("digest")
        .mapInArrow(_summaries(counters), "digest binary, least long")
        .groupBy("digest").agg(F.sum("least").alias("least"))
        .orderBy(F.desc("least"), "digest").limit(counters)
        .select("digest")
    )


def exact_dedup(docs: DataFrame, counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, heavy.

    Needs columns doc_id and text; others are ignored, whatever their names. A null
    text counts as empty, and empty texts are equal to each other. Of equal texts the
    row with the largest doc_id stays; a null doc_id is below all others, and keep_id
    is null if a group has no other. Of repeated rows (same text and doc_id) exactly
    one stays. An empty table gives no rows.
    """
    row = F.struct("doc_id", F.monotonically_increasing_id().alias("at"))  # ``at`` breaks ties of rows that are alike in text and doc_id
    keyed = materialize(docs.select(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"), row.alias("row")), "digests")
    biggest = (F.max("row").alias("best"), F.count("*").alias("group_size"))
    winners = (
        keyed.join(F.broadcast(heavy_digests(keyed, counters)), "digest", "left_semi")
        .groupBy("digest").agg(*biggest).where(F.col("group_size") >= heavy)
    )
    winners = materialize(winners, "winners")  # at most ``counters`` rows
    common = keyed.join(F.broadcast(winners), "digest").withColumn("heavy", F.lit(True))
    by = Window.partitionBy("digest")
    rare = (
        keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumns({"best": F.max("row").over(by), "group_size": F.count("*").over(by), "heavy": F.lit(False)})
    )
    return common.unionByName(rare).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row.at") == F.col("best.at")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "heavy",
    )


def dedup_report(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs).drop("heavy")


ORACLE = """
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
         max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id DESC NULLS LAST) AS rn
  FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
)
"""
