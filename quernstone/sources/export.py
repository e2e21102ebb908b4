"""Vectors as files that other programs open: one matrix, its manifest, and one file of sparse lines, published at once.

Rows are numbered by chunk id. A row of the matrix has a fixed width, so its number is its place in the file; a line's
place is the sum of the lines before it. With places known, all tasks write into the same file at the same time, and a task that is run
again writes the same bytes to the same place. Nothing is gathered, and no file is read again to be put together.

The folder must be one that the driver and all executors mount, since only such files can be written from the middle. It is
filled under another name and renamed when it is whole.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.storage import numbered, running

MATRIX, MANIFEST, LINES = "dense_embeddings.npy", "manifest.json", "sparse_vectors.jsonl"
IDS = "ids"
VECTORS = "chunk_id string, dense array<float>, indices array<int>, values array<float>"


def problems(vectors: DataFrame, dimension: int) -> dict[str, int]:
    """How many rows can't be exported, for each reason; empty if all can."""
    bad = {
        "without an id": F.col("chunk_id").isNull(), "without a dense vector": F.col("dense").isNull(), "with a dense vector of another size": F.size("dense") != dimension,
        "without a sparse vector": F.col("indices").isNull() | F.col("values").isNull(), "with a sparse vector of unequal lists": F.size("indices") != F.size("values"),
    }
    counts = vectors.agg(*[F.count_if(c).alias(name) for name, c in bad.items()]).first().asDict()
    repeated = vectors.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1)).first()[0]
    return {name: n for name, n in {**counts, "with an id that comes again": repeated or 0}.items() if n}


def _header(rows: int, dimension: int) -> bytes:
    """What stands before the numbers in a file of numpy's format."""
    out = io.BytesIO()
    np.lib.format.write_array_header_2_0(out, {"descr": "<f4", "fortran_order": False, "shape": (rows, dimension)})
    return out.getvalue()


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is no mounted folder")
    return path.removeprefix("file://").removeprefix("file:")


def _write_rows(file: str, first: int, width: int):
    """Rows (place, bytes) of one width into a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, handle = 0, os.open(file, os.O_WRONLY)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.column(0).to_numpy()
                order = np.argsort(at, kind="stable")
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(batch.num_rows, -1)[order]
                runs = np.flatnonzero(np.diff(at[order], prepend=at[order][0] - 2) != 1)
                for lo, hi in zip(runs, np.append(runs[1:], batch.num_rows), strict=True):
                    os.pwrite(handle, values[lo:hi].tobytes(), first + int(at[order][lo]) * width)
                n += batch.num_rows
        finally:
            os.close(handle)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


def _write_lines(file: str):
    """Lines (end, line) into a file, each before its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, handle = 0, os.open(file, os.O_WRONLY)
        try:
            for batch in batches:
                for end, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = line.encode()
                    os.pwrite(handle, raw, end - len(raw))
                n += batch.num_rows
        finally:
            os.close(handle)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


def _made(file: str, head: bytes, size: int) -> None:
    with open(file, "wb") as out:
        out.write(head)
        out.truncate(len(head) + size)


def export(vectors: DataFrame, out: str, dimension: int, model: str, sparse_model: str) -> dict:
    """Writes the matrix, the sparse lines, the ids and the manifest of rows (columns of VECTORS) to a new folder, and returns the manifest.

    Rows come in the order of their ids, the same in all files. Nothing is published unless every row has an id of its own and both vectors. No rows make
    an empty matrix.
    """
    wrong = problems(vectors, dimension)
    if wrong:
        raise ValueError("not exported: " + ", ".join(f"{n} rows {name}" for name, n in wrong.items()))
    target = _local(out)
    if os.path.exists(target):
        raise FileExistsError(target)
    made = f"{target}.{uuid.uuid4().hex}.tmp"
    os.makedirs(made)
    rows = numbered(vectors.select("chunk_id", "dense", "indices", "values"), F.col("chunk_id"), "row_index")
    n = vectors.count()
    head = _header(n, dimension)
    _made(f"{made}/{MATRIX}", head, n * dimension * 4)
    written = rows.select("row_index", "dense").mapInArrow(_write_rows(f"{made}/{MATRIX}", len(head), dimension * 4), "n long").agg(F.sum("n")).first()[0] or 0
    line = F.concat(F.to_json(F.struct("chunk_id", "indices", "values", F.lit(sparse_model).alias("model"))), F.lit("\n"))
    lines = running(rows.select("row_index", line.alias("line")), [], "row_index", {"end": F.octet_length("line")})
    _made(f"{made}/{LINES}", b"", lines.agg(F.max("end")).first()[0] or 0)
    lined = lines.select("end", "line").mapInArrow(_write_lines(f"{made}/{LINES}"), "n long").agg(F.sum("n")).first()[0] or 0
    if (written, lined) != (n, n):
        raise RuntimeError(f"{n} rows, but {written} vectors and {lined} lines were written")
    rows.select("row_index", "chunk_id").write.parquet(f"file://{made}/{IDS}")
    manifest = {"rows": n, "dimension": dimension, "dtype": "float32", "model": model, "sparse_model": sparse_model, "matrix": MATRIX, "sparse": LINES, "ids": IDS}
    with open(f"{made}/{MANIFEST}", "w") as file:
        json.dump(manifest, file, indent=2)
    os.rename(made, target)
    return manifest
