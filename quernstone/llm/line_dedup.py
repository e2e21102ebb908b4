"""Line deduplication by range partitioning and a stream over sorted hashes.

Lines become (128-bit hash of the key, document, position), are range-partitioned and
sorted by all of that, and are streamed: the first row of a hash is in the smallest
document that holds it, and rows of later documents are dropped. A range may end inside a
hash, so a frequent line is spread over tasks; the rows of a partition's first hash wait
for the first document that the partitions before have seen, of which each partition
reports two at most. The result is a compressed keep bitmap for each document; texts are
only touched when bitmaps are applied.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import map_arrow, materialize, small_batches

MIN_CHARS = 10
NO_ID = 2**63 - 1
_ROWS = "hi long, lo long, doc long, text_key long, at int"


def document_key() -> dict[str, Column]:
    """What identifies a document: its id (null is the largest of all) and a hash of its text."""
    return {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text_key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: ASCII white space and letters only


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least)


def _lines(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    docs, keys, counts, ats, digests = [], [], [], [], []
    for doc, text_key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        n = len(ats)
        for at, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
            if _long_enough(key := line_key(line), least):
                ats.append(at)
                digests.append(xxhash.xxh3_128_digest(key))
        docs.append(doc)
        keys.append(text_key)
        counts.append(len(ats) - n)
    hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    columns = [hashes[:, 0], hashes[:, 1], np.repeat(np.array(docs, np.int64), counts), np.repeat(np.array(keys, np.int64), counts), np.array(ats, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hi", "lo", "doc", "text_key", "at"])


#: What the stream returns: a row to drop; a row of a partition's first hash; the first document of a hash at a partition's edge.
DROP, WAITS, EDGE = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head = last = None  # hash of the partition's first group; (hash, first document) of the current one

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.array(np.full(n, kind, np.int32))], names=["hi", "lo", "doc", "text_key", "at", "kind"])

    def edge(group) -> pa.RecordBatch:
        (hi, lo), doc = group
        return out(EDGE, np.array([hi], np.int64), np.array([lo], np.int64), np.array([doc], np.int64), np.zeros(1, np.int64), np.zeros(1, np.int32))

    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc, key, at = (c.to_numpy() for c in batch.columns)
        new = np.concatenate(([last is None or (int(hi[0]), int(lo[0])) != last[0]], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
        if head is None:
            head = (int(hi[0]), int(lo[0]))
            yield edge((head, int(doc[0])))
        group = np.cumsum(new) - 1
        firsts = doc[new] if new.any() else np.zeros(0, np.int64)
        first = np.where(group >= 0, firsts[np.maximum(group, 0)] if len(firsts) else 0, last[1] if last else 0)
        waits = (hi == head[0]) & (lo == head[1])
        drop = ~waits & (doc > first)
        for kind, rows in ((WAITS, waits), (DROP, drop)):
            if rows.any():
                yield out(kind, hi[rows], lo[rows], doc[rows], key[rows], at[rows])
        last = ((int(hi[-1]), int(lo[-1])), int(first[-1]))
    if last is not None:
        yield edge(last)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_key, at): the lines that go, by document and position."""
    small_batches(docs.sparkSession)
    source = docs.select(*[c.alias(n) for n, c in document_key().items()], F.col("text").cast("string").alias("text"))
    lines = map_arrow(source, lambda batch: _lines(batch, min_chars), _ROWS)
    order = ["hi", "lo", "doc", "text_key", "at"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = materialize(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_stream, _ROWS + ", kind int"), "lines")
    edges = seen.where(F.col("kind") == EDGE).groupBy("hi", "lo").agg(F.min("doc").alias("first"))  # two rows a partition at most
    waiting = seen.where(F.col("kind") == WAITS).join(F.broadcast(edges), ["hi", "lo"]).where("doc > first")
    return seen.where(F.col("kind") == DROP).select("doc", "text_key", "at").unionByName(waiting.select("doc", "text_key", "at"))


def pack(n_lines: int, dropped: list[int] | None) -> bytes:
    """A keep bitmap (first line first, lowest bit first), compressed."""
    keep = np.ones(n_lines, np.uint8)
    keep[dropped or []] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack(n_lines: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_key, n_lines, n_dropped, keep BINARY) for each distinct document of docs.

    Needs columns doc_id and text; others are ignored. A null or empty text is one empty
    line. Rows with one doc_id are one document even if their texts differ: each has a
    bitmap of its own, and none loses a line to another. Null ids are one document, behind
    all others. Lines repeated inside the first document stay. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    every = docs.select(*[c.alias(n) for n, c in document_key().items()], n_lines.alias("n_lines")).groupBy("doc", "text_key").agg(F.max("n_lines").alias("n_lines"))
    gone = dropped_lines(docs, min_chars).groupBy("doc", "text_key").agg(F.array_distinct(F.collect_list("at")).alias("gone"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([len(g or ()) for g in gone], pa.int32()), pa.array([pack(a, g) for a, g in zip(n, gone, strict=True)], pa.binary())],
            names=["doc", "text_key", "n_lines", "n_dropped", "keep"],
        )

    return map_arrow(every.join(gone, ["doc", "text_key"], "left"), run, "doc long, text_key long, n_lines int, n_dropped int, keep binary")


def kept_text(text: str | None, n_lines: int, bitmap: bytes) -> str:
    return "\n".join(line for line, keep in zip((text or "").split("\n"), unpack(n_lines, bitmap), strict=True) if keep)


def line_report(docs: DataFrame) -> DataFrame:
    """The bitmaps of ``line_dedup`` applied to the texts: doc_id, n_lines, n_dropped, kept_sha256, for each row of docs."""
    bitmaps = materialize(line_dedup(docs), "bitmaps")
    texts = docs.select("doc_id", *[c.alias(n) for n, c in document_key().items()], "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, text, n, dropped, keep = (c.to_pylist() for c in batch.columns)
        sha = [hashlib.sha256(kept_text(*row).encode("utf-8", "surrogatepass")).hexdigest() for row in zip(text, n, keep, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = texts.join(bitmaps.hint("shuffle_hash"), ["doc", "text_key"]).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "n_lines", "n_dropped", "keep")
    return map_arrow(joined, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
