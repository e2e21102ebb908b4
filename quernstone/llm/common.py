"""What the training-data operators share: row keys, shared storage, size checks.

Intermediate results are cut from their lineage by ``materialize``: a Parquet
table in the folder that ``spark.checkpoint.dir`` names. Such a table lives on
storage that every executor sees, so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of every operator here: space and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast up to so many rows (of a few numbers each), beyond them it is shuffled.
BROADCAST_ROWS = 200_000

#: Rows in an Arrow batch, so that a batch of long texts fits a Python worker.
ARROW_ROWS = 256

_created: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/quernstone-{name}-{uuid.uuid4().hex}"
    _created.append((spark, path))
    return path


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


@atexit.register
def _remove_created() -> None:
    for spark, path in _created:
        try:
            remove(spark, path)
        except Exception:  # the session is gone; the folder belongs to the cluster's clean-up then
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder. The path is in ``.quern_path``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and nothing reads any more."""
    remove(df.sparkSession, df.quern_path)


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a counted frame for broadcast if it is small enough, else for a shuffle: Spark's own estimate of a frame that an explode
    has grown may be far too low, and it would broadcast it unasked."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df has not (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """128 bits (32 hex digits) of all columns: rows with equal values in every column are told apart by nothing else.

    Two hashes from different starts, since 64 bits alone would make some rows of 10^11 one.
    """
    cols = [F.col(f"`{f.name}`") if _hashable(f.dataType) else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema.fields]
    half = lambda start: F.lpad(F.hex(F.xxhash64(F.lit(start), *cols)), 16, "0")
    return F.concat(half(1), half(2))


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    """ARRAY<STRING> of the words ``[^\\x20\\x09-\\x0D]+``."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow of a function on batches, in batches small enough for whole long texts."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
