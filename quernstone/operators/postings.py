"""Postings of sparse vectors in blocks with bounds: exact nearest neighbours that leave out blocks which can't matter.

Rows are dealt to tiles of ``TILE_ROWS`` where they lie, those with the largest weights together. A block is a term's postings in one tile, with their
largest and smallest weight; blocks lie in the order of their terms, so that a search's filter on terms skips row groups.

A search brings the blocks of a tile together, once a wave of queries, and scores tile after tile in numpy, heavy tiles first:

1. The heads of blocks bound the score of each query in a tile: the sum of its weights times the block's largest.
2. Of many tiles, the very heaviest and then one in ``LEAD_HEAVY`` go first; the k-th best score there is a threshold that all tasks are given.
   Of few, the first ``lead`` tiles of a task are scored for all queries, and each task has thresholds of its own.
3. Of the other tiles the postings are read only for queries whose bound reaches it. All others hold no row of the top k.

A task passes on its own k best of each query only, of those that reach the threshold, so no pair of a query and a row is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.search import ABOVE_0, BLOCK_TERMS, DIGITS, LEAD_HEAVY, SharedTerms, best_of, gathered, top_of
from quernstone.storage import pinned, small_batches

TILE_ROWS, LEAD = 1024, 2
#: Of so many tiles and more, ``LEAD_TILES``, the heaviest, go first, and one in ``LEAD_HEAVY`` after them.
LEAD_FROM, LEAD_TILES = 64, 2
#: Terms of the queries of a wave, which the driver reads and every task holds.
WAVE_TERMS = 1 << 22
#: Slack of bounds, beyond the rounding of scores.
SLACK = 10.0**-DIGITS

_BLOCK = "tile long, mass double, term string, n long, largest double, smallest double, ids array<bigint>, weights array<double>"
_FOUND = "query_id long, id long, score double"
_COUNTS = ("tiles", "blocks", "postings", "blocks_read", "postings_read")


def _entries(df: DataFrame, name: str) -> DataFrame:
    kept = F.filter(F.map_entries("weights"), lambda e: e["value"] != 0)
    return df.select(F.col(name).cast("long").alias(name), F.transform(kept, lambda e: e["key"]).alias("terms"), F.transform(kept, lambda e: e["value"].cast("double")).alias("w"))


def _blocks(tile_rows: int):
    """Batches of (id, terms, w) to blocks. Weights of 0 have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = TaskContext.get().partitionId() << 32
        for batch in gathered(batches):
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
            row, terms, w = np.repeat(np.arange(len(sizes)), sizes), batch.column(1).flatten(), batch.column(2).flatten().fill_null(0).to_numpy()
            if not w.all():
                row, terms, w = row[w != 0], terms.filter(pa.array(w != 0)), w[w != 0]
            ids, place = batch.column(0).to_numpy(), np.empty(len(sizes), np.int64)
            place[np.argsort(-np.bincount(row, np.abs(w), len(sizes)), kind="stable")] = np.arange(len(sizes))
            encoded = terms.dictionary_encode()
            code = encoded.indices.to_numpy()
            nth = np.argsort(np.argsort(ids, kind="stable"))  # places of ids in their order, so that one number a posting is the order
            by = np.argsort((place[row] // tile_rows * len(encoded.dictionary) + code) * len(ids) + nth[row])
            row, code, w, dealt = row[by], code[by], w[by], place[row[by]] // tile_rows
            for lo, hi in _runs(dealt):
                c, x = code[lo:hi], w[lo:hi]
                first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                offsets = pa.array(np.append(first, len(c)).astype(np.int32))
                postings = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids[row[lo:hi]], x)]
                largest, smallest = np.maximum.reduceat(x, first), np.minimum.reduceat(x, first)
                mass, n = np.maximum(np.abs(largest), np.abs(smallest)).sum(), np.diff(np.append(first, len(c)))
                columns = [np.full(len(first), tile), np.full(len(first), mass), encoded.dictionary.take(pa.array(c[first])), n, largest, smallest]
                yield pa.RecordBatch.from_arrays([*[x if isinstance(x, pa.Array) else pa.array(x) for x in columns], *postings], names=["tile", "mass", "term", "n", "largest", "smallest", "ids", "weights"])
                tile += 1

    return run


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where equal values follow one another."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(values) else []


def write(rows: DataFrame, path: str, tile_rows: int = TILE_ROWS) -> None:
    """Writes the blocks of rows (id, weights MAP<STRING, DOUBLE>) to a new folder. Null and empty weights have no postings; ids are taken to be distinct."""
    small_batches(rows.sparkSession)
    lists = rows.select(F.col("id").cast("long").alias("id"), F.map_keys("weights").alias("terms"), F.map_values("weights").cast("array<double>").alias("w"))
    lists.mapInArrow(_blocks(tile_rows), _BLOCK).sortWithinPartitions("term", "tile").write.option("compression", "zstd").parquet(path)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch for each tile; tiles follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in gathered(batches):
        tile = batch.column("tile").to_numpy()
        for lo, hi in _runs(tile):
            if held and held[0].column("tile")[0].as_py() != tile[lo]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


class _Wave:
    """Scores tiles for a wave of queries (query_id, terms, weights), and counts what it reads."""

    def __init__(self, found: pa.Table, lead: int, known: np.ndarray | None = None):
        self.shared, self.lead, lists = SharedTerms(found, BLOCK_TERMS, known), lead, found.column(1).chunk(0)
        code, owner = self.shared.codes(lists.flatten()), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        by = np.argsort(code, kind="stable")
        self.query, self.weight = owner[by], found.column(2).chunk(0).flatten().to_numpy()[by]
        self.first = np.searchsorted(code[by], np.arange(len(self.shared.vocabulary) + 1))
        self.counts = np.zeros((len(_COUNTS), len(lists)), np.int64)

    def __call__(self, tile: pa.RecordBatch, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        code = self.shared.codes(tile.column("term"))
        hit = np.flatnonzero(code >= 0)
        code, (n, largest, smallest) = code[hit], (tile.column(c).to_numpy()[hit] for c in ("n", "largest", "smallest"))
        lens = self.first[code + 1] - self.first[code]
        at = np.repeat(self.first[code] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        query, weight = self.query[at], self.weight[at]
        part = np.maximum(np.maximum(weight * np.repeat(largest, lens), weight * np.repeat(smallest, lens)), 0)
        bound = np.bincount(query, part, len(floor))
        blocks, postings = np.bincount(query, minlength=len(floor)), np.bincount(query, np.repeat(n, lens), len(floor)).astype(np.int64)
        read = (blocks > 0) & ((self.lead > 0) | (bound * (1 + 1e-9) + SLACK >= floor))
        self.lead -= 1
        self.counts += np.stack([blocks > 0, blocks, postings, blocks * read, postings * read])
        if read.any():
            held, w = (tile.column(c).take(pa.array(hit)).flatten().to_numpy() for c in ("ids", "weights"))
            by = np.argsort(held, kind="stable")
            ends = np.flatnonzero(np.concatenate(([True], held[by][1:] != held[by][:-1], [True])))
            ids = held[by[ends[:-1]]]
            for members, rows, sums in self.shared.products(ends, np.repeat(code, n)[by], w[by], np.where(read, floor, np.inf)):
                yield members, ids[rows], sums


def _searched(found: pa.Table, k: int, lead: int, report: bool, known: np.ndarray | None = None):
    own = found.column(0).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = _Wave(found, lead if known is None else 0, known)
        scored = top_of(lambda tile, floor: ((ids, members, sums) for members, ids, sums in wave(tile, floor)), own, k, ABOVE_0, known, _tiles)(batches)
        if not report:
            yield from scored
        else:
            for _ in scored:
                pass
            yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, wave.counts)], names=["query_id", *_COUNTS])

    return run


def _leads(blocks: DataFrame, terms: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of the tiles that go first, none if there are few tiles, and all others."""
    masses = blocks.groupBy("tile").agg(F.max("mass").alias("mass"))
    many = masses.count()
    if many < LEAD_FROM:
        return [], blocks
    top, heavy = masses.agg(F.percentile_approx("mass", [1 - LEAD_TILES / many, 1 - 1 / LEAD_HEAVY], 1 << 16)).first()[0]
    first = pinned(blocks.where(F.col("mass") > heavy).join(F.broadcast(terms), "term", "left_semi").select(*blocks.columns), "first")  # once, not once a wave
    return [first.where(F.col("mass") > top), first.where(F.col("mass") <= top)], blocks.where(F.col("mass") <= heavy)


def _search(spark: SparkSession, path: str, queries: DataFrame, k: int, lead: int, wave_terms: int, report: bool = False) -> DataFrame:
    small_batches(spark)
    asked = pinned(_entries(queries, "query_id"), "queries")
    waves = max(1, -(-(asked.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0) // wave_terms))
    terms = lambda of: of.select(F.explode("terms").alias("term")).distinct()
    leads, rest = _leads(spark.read.schema(_BLOCK).parquet(path), terms(asked))
    schema = f"query_id long, {', '.join(f'{c} long' for c in _COUNTS)}" if report else _FOUND
    parts = [spark.createDataFrame([], schema)]
    for n in range(waves):
        wave = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(waves)) == n)
        found = wave.toArrow().combine_chunks()
        if found.num_rows:
            known = best = None
            for at, blocks in enumerate([*leads, rest]):
                met = blocks.join(F.broadcast(terms(wave)), "term", "left_semi").select(*blocks.columns)
                dealt = met.repartition("tile") if blocks is rest else met.repartition(LEAD_TILES if at == 0 else spark.sparkContext.defaultParallelism, "tile")
                tiles = dealt.sortWithinPartitions(F.desc("mass"), "tile")
                out = tiles.mapInArrow(_searched(found, k, lead, report, known), schema)
                if report or blocks is rest:
                    parts.append(out if waves == 1 else pinned(out if report else best_of(out, k).drop("rank"), "found"))  # so that the shuffle of a wave can go before the next
                if blocks is not rest:
                    got = tiles.mapInArrow(_searched(found, k, lead, False, known), _FOUND)
                    best = pinned(best_of(got if best is None else got.unionByName(best.drop("rank")), k), "lead")
                    reached = {r["query_id"]: r["score"] for r in best.where(F.col("rank") == k).select("query_id", "score").collect()}  # a row a query of the wave
                    known = np.array([reached.get(q, -np.inf) for q in found.column(0).to_pylist()])
            if best is not None and not report:
                parts.append(best.drop("rank"))
    return reduce(DataFrame.unionByName, parts[1:] or parts)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, lead: int = LEAD, wave_terms: int = WAVE_TERMS) -> DataFrame:
    """(query_id, id, score, rank) of the k rows with the largest inner product above 0, exactly; ties go to the smaller id.

    queries: query_id, weights MAP<STRING, DOUBLE>, of either sign, one row an id. Null and empty weights find nothing.
    """
    return best_of(_search(spark, path, queries, k, lead, wave_terms), k).select("query_id", "id", "score", "rank")


def skipped(spark: SparkSession, path: str, queries: DataFrame, k: int, lead: int = LEAD, wave_terms: int = WAVE_TERMS) -> DataFrame:
    """What a search leaves out, a row a query: query_id, tiles, blocks, postings that hold a term of it, and blocks_read, postings_read."""
    seen = _search(spark, path, queries, k, lead, wave_terms, True)
    return seen.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in _COUNTS]).where("tiles > 0")
