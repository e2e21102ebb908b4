"""An inverted-file index of vectors: cells around trained centres, and a list of rows for each cell.

Centres are trained by spherical k-means on a sample of at most ``SAMPLE_NUMBERS`` numbers, chosen by a hash of the
id; every row is then assigned to the nearest one. Lists are Parquet, partitioned by cell, so that a search reads the folders of its cells only; a list that is
too long for a file is split by the rebalancing of Spark's adaptive execution. The manifest, a row a
cell, is written last: a folder without it is no index.

A search reads the ``probes`` nearest cells of each query. How many that takes is measured on the sample when the index is built. An exact search
goes on with every cell that could hold a better row than the k-th found: no row of a cell is nearer to
a query than the angle to the centre less the cell's largest angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators.search import DIGITS, WAVE, Scorer, top_of, unit

#: Numbers in the sample's vectors, and in the centres' vectors, at most: both are held by the driver, the latter by every task.
SAMPLE_NUMBERS, CENTRE_NUMBERS = 1 << 22, 1 << 22
ROUNDS, SEED = 12, 7
#: Share of the sample's true neighbours that must lie in the probed cells, and how many neighbours and rows are looked at.
TARGET, NEIGHBOURS, JUDGED = 0.95, 50, 512
#: Slack of bounds, beyond the rounding of scores.
SLACK = 10.0**-DIGITS


def _vectors(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("vector").isNotNull()).select(F.col(name).cast("long").alias(name), "vector")


def train(sample: np.ndarray, n_cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centres of length 1. A centre that no row is nearest to moves to the row that fits worst."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), n_cells, replace=False)].copy()
    for _ in range(rounds):
        near = sample @ centres.T
        cell, fit = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=n_cells) == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, target: float = TARGET, k: int = NEIGHBOURS, judged: int = JUDGED) -> int:
    """The fewest cells in which ``target`` of the k nearest neighbours lie, on average over rows of the sample."""
    if len(sample) < 2:
        return 1
    queries = sample[: min(judged, len(sample))]
    k = min(k, len(sample) - 1)
    nearest = np.argpartition(-(queries @ sample.T), k - 1, axis=1)[:, :k]
    cell = (sample @ centres.T).argmax(axis=1)
    order = np.argsort(-(queries @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    found = np.sort(np.take_along_axis(place, cell[nearest], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)]) + 1


def build(rows: DataFrame, path: str, n_cells: int | None = None) -> None:
    """Writes the index of rows (id, vector) to a new folder. There are about as many cells as the square root of the rows, if the bounds allow it.

    Null vectors are left out; vectors of unequal length are an error. A zero vector is in some cell and has similarity 0 to all. An empty table makes an
    index in which nothing is found. Repeated ids are rows of their own.
    """
    spark, rows = rows.sparkSession, _vectors(rows, "id")
    shape = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    n, dimension = shape[0], max(1, shape[1] or 1)
    held = max(1, min(n, SAMPLE_NUMBERS // dimension))
    sample = unit(rows.orderBy(F.xxhash64("id"), "id").limit(held).select("vector").toArrow().column(0).combine_chunks(), dimension)
    wanted = n_cells or round(n**0.5)
    centres = train(sample, max(1, min(wanted, len(sample), CENTRE_NUMBERS // dimension))) if len(sample) else np.zeros((0, dimension))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = unit(batch.column(1), shared.value.shape[1]) @ shared.value.T
                added = [pa.array(near.argmax(axis=1).astype(np.int32)), pa.array(near.max(axis=1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=["id", "vector", "cell", "fit"])

    kind = rows.schema["vector"].dataType.simpleString()
    assigned = rows.mapInArrow(assign, f"id long, vector {kind}, cell int, fit double")
    assigned.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/lists")
    lists = spark.read.schema(f"id long, vector {kind}, fit double, cell int").parquet(f"{path}/lists")
    sizes = lists.groupBy("cell").agg(F.count("*").alias("rows"), F.min("fit").alias("least_fit"))
    probes = probes_for(sample, centres) if len(centres) else 1
    made = spark.createDataFrame(pa.table({"cell": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float64()))}))
    manifest = made.join(F.broadcast(sizes), "cell", "left").select("cell", "centre", F.coalesce("rows", F.lit(0)).alias("rows"), "least_fit", F.lit(probes).alias("probes"))
    manifest.coalesce(1).write.parquet(f"{path}/cells")  # as many rows as centres


class Index:
    """A written index. The manifest is read by the driver; it is as large as the centres."""

    def __init__(self, spark: SparkSession, path: str):
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow().combine_chunks()
        self.centres = np.array(cells.column("centre").to_pylist(), np.float64).reshape(cells.num_rows, -1 if cells.num_rows else 0)
        self.rows = cells.column("rows").to_numpy()
        self.reach = np.arccos(np.clip(cells.column("least_fit").to_pandas().fillna(1.0).to_numpy(), -1, 1))
        self.probes = int(cells.column("probes")[0].as_py()) if cells.num_rows else 1
        self.lists = spark.read.parquet(f"{path}/lists") if self.rows.any() else None

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest similarity that a row of each cell can have to each query. A query without direction has 0 to all."""
        angle = np.arccos(np.clip(queries @ self.centres.T, -1, 1))
        return np.where(np.linalg.norm(queries, axis=1)[:, None] > 0, np.cos(np.maximum(0, angle - self.reach)), 0) + SLACK


def _scan(index: Index, ids: np.ndarray, queries: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
    """(query_id, id, score): the k best rows a task finds for each query in the cells that it asks for (queries x cells)."""
    cells = np.flatnonzero(asked.any(axis=0))
    shared = index.lists.sparkSession.sparkContext.broadcast((queries, asked))

    def score(batch: pa.RecordBatch, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        queries, asked = shared.value
        own, x, cell = batch.column(0).to_numpy(), unit(batch.column(1), queries.shape[1]), batch.column(2).to_numpy()
        for c in np.unique(cell).tolist():
            at, by = np.flatnonzero(cell == c), np.flatnonzero(asked[:, c])
            yield own[at], by, queries[by] @ x[at].T

    scorer: Scorer = score
    read = index.lists.where(F.col("cell").isin(cells.tolist())).select("id", "vector", "cell")  # folders of other cells are not read
    return read.mapInArrow(top_of(scorer, ids, k), "query_id long, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, wave: int = WAVE) -> DataFrame:
    """(query_id, id, score, rank, read_share): the k rows with the largest cosine similarity in the cells read, ties to the smaller id.

    queries: query_id, vector. ``read_share`` is the share of all rows that lies in the cells which were read for the query. With ``exact``
    no row is missed, however many cells that takes. Queries are sent in waves of so many.
    """
    index, queries = Index(spark, path), _vectors(queries, "query_id")
    out = "query_id long, id long, score double, rank int, read_share double"
    if index.lists is None:
        return spark.createDataFrame([], out)
    waves, parts = max(1, -(-queries.count() // wave)), [spark.createDataFrame([], out)]
    total = max(1, int(index.rows.sum()))
    for n in range(waves):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(waves)) == n).toArrow().combine_chunks()  # a wave
        if not own.num_rows:
            continue
        ids, vectors = own.column(0).to_numpy(), unit(own.column(1).chunk(0), index.centres.shape[1])
        near = np.where(index.rows > 0, vectors @ index.centres.T, -np.inf)
        first = np.argsort(-near, axis=1, kind="stable")[:, : probes or index.probes]
        asked = np.zeros(near.shape, bool)
        np.put_along_axis(asked, first, True, axis=1)
        asked &= index.rows > 0
        found = _scan(index, ids, vectors, asked, k)
        if exact:
            found = _best(found, k).drop("rank").checkpoint()
            last = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).toArrow()  # a row a query of the wave
            least = np.full(len(ids), -np.inf)
            full = last.column("n").to_numpy() >= k
            place = {q: i for i, q in enumerate(ids.tolist())}
            least[[place[q] for q in last.column("query_id").to_numpy()[full].tolist()]] = last.column("least").to_numpy()[full]
            more = (index.bounds(vectors) >= least[:, None]) & ~asked & (index.rows > 0)
            if more.any():
                found = found.unionByName(_scan(index, ids, vectors, more, k))
            asked |= more
        share = spark.createDataFrame(pa.table({"query_id": ids, "read_share": (asked @ index.rows) / total}))
        parts.append(_best(found, k).join(F.broadcast(share), "query_id").select("query_id", "id", "score", "rank", "read_share"))
    return reduce(DataFrame.unionByName, parts[1:] or parts)
