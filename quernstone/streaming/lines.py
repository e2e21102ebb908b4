"""A sink of JSON lines that can stop at any time: no half line and no repeated batch is ever read.

Each task writes its lines to a pending file that no reader looks at, and reports it. When all tasks of a micro-batch are done their files are moved to the
batch's folder, and a marker of the batch's number is written last. A batch that is run again, because its marker or its
checkpoint is missing, replaces what an earlier attempt has moved; one whose marker is there leaves it as it is. Readers read
marked batches only.

The folder is any that Arrow's file systems and all executors reach.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PENDING, MARKERS = "_pending", "_batches"


@dataclass
class Written(WriterCommitMessage):
    """A task's pending file and its lines; no file for a task without rows."""

    file: str | None
    lines: int


def _at(path: str) -> tuple[fs.FileSystem, str]:
    found, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, base


class LineWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = _at(self.path)
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        store.create_dir(posixpath.join(base, PENDING))
        file, lines = posixpath.join(base, PENDING, f"{uuid.uuid4().hex}.jsonl"), 0
        with store.open_output_stream(file) as out:
            for row in (r for part in ([first], iterator) for r in part):
                out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode("utf-8", "surrogatepass"))
                lines += 1
        return Written(file, lines)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, base = _at(self.path)
        marker, folder = posixpath.join(base, MARKERS, str(batchId)), posixpath.join(base, f"batch={batchId}")
        pending = [m for m in messages if m is not None and m.file is not None]
        if store.get_file_info(marker).type != fs.FileType.NotFound:
            self.abort(messages, batchId)  # done before, by an attempt whose checkpoint was lost
            return
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)
        store.create_dir(folder)
        for n, m in enumerate(pending):
            store.move(m.file, posixpath.join(folder, f"part-{n:05d}.jsonl"))
        store.create_dir(posixpath.join(base, MARKERS))
        with store.open_output_stream(marker) as out:
            out.write(str(sum(m.lines for m in pending)).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, _ = _at(self.path)
        for m in messages:
            if m is not None and m.file is not None and store.get_file_info(m.file).type != fs.FileType.NotFound:
                store.delete_file(m.file)


class Lines(DataSource):
    """``writeStream.format("quern_lines").option("path", folder)``, once registered with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "quern_lines"

    def schema(self) -> StructType:
        raise NotImplementedError("lines are read by read_lines")

    def streamWriter(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


def batches(path: str) -> dict[int, int]:
    """The number of lines of each batch that is there as a whole."""
    store, base = _at(path)
    found = store.get_file_info(fs.FileSelector(posixpath.join(base, MARKERS), allow_not_found=True))
    return {int(f.base_name): int(store.open_input_stream(f.path).read() or b"0") for f in found}


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of all whole batches, each file as a partition or more. A line that does not fit the schema is an error."""
    done = [f"{path}/batch={n}" for n, lines in sorted(batches(path).items()) if lines]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(done) if done else spark.createDataFrame([], schema)
