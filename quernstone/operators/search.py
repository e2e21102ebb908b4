"""Dense and sparse nearest neighbours of a query set, in one scan, with per-task top-k.

All queries of a wave go to every task; a task scores its rows against them, a block of queries at a time, in
numpy and passes on only its own k best for each query, so that the shuffle holds tasks x
queries x k rows however large the table is, and far fewer after a sample of the rows has told what score a row must reach.
The rows are read once a wave of ``WAVE`` queries; rows and queries are cut from their lineage first, so that nothing makes them anew.
Scores are rounded to ``DIGITS`` and ties go to the smaller id, in the tasks as at the end: the result is the exact top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.storage import pinned, small_batches

DIGITS = 6
#: Queries that a task holds, that it scores at once by vectors or by terms, and products of terms that it adds at once.
WAVE, BLOCK, BLOCK_TERMS, PRODUCTS = 16384, 1024, 2048, 1 << 21
#: A block of queries has so many terms at most in a dense matrix, those that at least this share of its queries have: most products are of few terms.
HEAD, HEAD_SHARE = 768, 0.015
#: Frequent terms by which queries are brought together, and neighbours of a block whose largest weights are one bound.
ANCHORS, GROUP = 32, 16
#: Queries with the lowest floors lie together, this share of all: most rows reach one of them.
LOW = 1 / 8
#: Numbers or terms of a wave's queries, which the driver reads and every task holds. A wave holds whole queries.
WAVE_ENTRIES = 1 << 22
#: Of so many rows and more, one in ``LEAD`` (by a hash of the id) or the heaviest one in ``LEAD_HEAVY`` go first; before these the ``LEAD_ROWS`` heaviest.
LEAD, LEAD_HEAVY, LEAD_FROM, LEAD_ROWS = 16, 32, 1 << 14, 512
#: Rows and bytes that a task scores at once.
GATHER_ROWS, GATHER_BYTES = 4096, 1 << 25
#: The least score that is not 0.
ABOVE_0 = np.nextafter(0, 1)
_OUT = "query_id long, id long, score double"

#: From a batch of rows and the score of each query that they must reach: (ids of rows, positions of queries, scores of queries x rows, NaN where there is none).
Scorer = Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[np.ndarray, slice | np.ndarray, np.ndarray]]]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches as larger ones: a query's best rows are looked through once a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= GATHER_ROWS or sum(b.nbytes for b in held) >= GATHER_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def top_of(scorer: Scorer, queries: np.ndarray, k: int, least: float = -np.inf, known: np.ndarray | None = None, deal: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = gathered):
    """A task's k best rows of each query, of those whose score (before it is rounded) is ``least`` or more, and at least the query's ``known`` one. ``deal`` makes what is scored at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        floor = np.full(len(queries), -np.inf) if known is None else known.copy()  # the k-th best so far
        for batch in deal(batches):
            for ids, block, scores in scorer(batch, floor):
                good = scores >= np.maximum(floor[block] - 10.0**-DIGITS, least)[:, None]
                some = np.flatnonzero(good.any(axis=1)).tolist()
                places = np.arange(len(queries))[block] if some else block
                for at in some:
                    hit = np.flatnonzero(good[at])
                    q, s, i = int(places[at]), np.round(scores[at, hit], DIGITS) + 0.0, ids[hit]
                    if len(s) > 4 * k:
                        keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                        s, i = s[keep], i[keep]
                    if q in held:
                        s, i = np.concatenate((held[q][0], s)), np.concatenate((held[q][1], i))
                    best = np.lexsort((i, -s))[:k]
                    held[q] = (s[best], i[best])
                    if len(best) == k:
                        floor[q] = max(floor[q], s[best[-1]])
        for q, (s, i) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), queries[q], np.int64)), pa.array(i.astype(np.int64)), pa.array(s.astype(np.float64))], names=["query_id", "id", "score"])

    return run


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _topk(queries: DataFrame, rows: DataFrame, k: int, make: Callable[[pa.Table, np.ndarray | None], Scorer], wave: int, least: float = -np.inf, heavy: str | None = None) -> DataFrame:
    """(query_id, id, score, rank). ``make`` turns a wave of queries into their scorer. The first column of both frames is the id, the second a list.

    A wave is about ``wave`` queries, fewer if their lists are long. Of many rows, one in ``LEAD`` are searched first: the k-th best score there is what any other row must
    reach, so that tasks neither look through nor pass on what is only the best of their own. With ``heavy``, a column with a number of a row, those with the largest go first, one in ``LEAD_HEAVY``;
    they have many terms and reach many queries, so a few of them, the heaviest, tell before what these must reach.
    """
    queries, rows = pinned(queries, "queries"), pinned(rows, "rows")
    n, entries = queries.agg(F.count("*"), F.sum(F.size(queries.columns[1]).cast("long"))).first()
    waves = max(1, -(-n // wave), -(-(entries or 0) // WAVE_ENTRIES))
    leads, rest = _leads(rows, heavy)
    parts = [rows.sparkSession.createDataFrame([], _OUT)]
    for n in range(waves):
        found = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(waves)) == n).toArrow().combine_chunks()  # a wave of queries
        if found.num_rows:
            own, known, best = found.column(0).to_numpy(), None, None
            for lead in leads:
                best = lead.mapInArrow(top_of(make(found, known), own, k, least, known), _OUT).unionByName(parts[0] if best is None else best.drop("rank"))
                best = pinned(best_of(best, k), "lead")
                reached = {r["query_id"]: r["score"] for r in best.where(F.col("rank") == k).select("query_id", "score").collect()}  # a row a query of the wave
                known = np.array([reached.get(q, -np.inf) for q in own.tolist()])
            if best is not None:
                parts.append(best.drop("rank"))
            parts.append(rest.mapInArrow(top_of(make(found, known), own, k, least, known), _OUT))
    return best_of(reduce(DataFrame.unionByName, parts[1:] or parts), k)


def _leads(rows: DataFrame, heavy: str | None) -> tuple[list[DataFrame], DataFrame]:
    """The rows that go first, none if there are few rows, and all others. A task of a lead has k rows of each query, so there are not more tasks than cores."""
    many = rows.count()
    if many < LEAD_FROM:
        return [], rows
    firsts = [F.pmod(F.xxhash64("id"), F.lit(LEAD)) == 0]
    if heavy is not None:
        shares = min(LEAD_ROWS / many, 1 / LEAD_HEAVY), 1 / LEAD_HEAVY
        bounds = rows.agg(F.percentile_approx(heavy, [1 - s for s in shares], 1 << 16)).first()[0] or []
        firsts = [F.coalesce((F.col(heavy) > b) | ((F.col(heavy) == b) & firsts[0]), F.lit(False)) for b in bounds]
    cores, before, leads = max(1, rows.sparkSession.sparkContext.defaultParallelism), F.lit(False), []
    for n, first in enumerate(firsts):
        tasks = max(1, cores // 4) if n < len(firsts) - 1 else cores
        leads.append(pinned(rows.where(first & ~before), "first").coalesce(tasks))  # once, not once a wave
        before = first
    return leads, rows.where(~before)


def unit(column: pa.ListArray, dimension: int | None = None) -> np.ndarray:
    """Vectors as rows of length 1 (or 0). All must have one length, the ``dimension`` if it is given."""
    if not len(column):
        return np.zeros((0, dimension or 0))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    dimension = int(sizes[0]) if dimension is None else dimension
    if (sizes != dimension).any():
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()))} numbers where {dimension} are expected")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """(query_id, id, score, rank) of the k rows with the largest cosine similarity.

    queries: query_id, vector; rows: id, vector. Null vectors take no part; a zero vector has similarity 0. Vectors of unequal length are an error.
    """

    def make(found: pa.Table, known: np.ndarray | None = None) -> Scorer:
        matrix = unit(found.column(1).chunk(0))

        def score(batch: pa.RecordBatch, floors: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
            own, x = batch.column(0).to_numpy(), unit(batch.column(1), matrix.shape[1]).T
            for lo in range(0, len(matrix), block):
                yield own, slice(lo, min(lo + block, len(matrix))), matrix[lo : lo + block] @ x

        return score

    vectors = lambda df, name: df.where(F.col("vector").isNotNull()).select(F.col(name).cast("long").alias(name), F.col("vector").cast("array<double>"))
    return _topk(vectors(queries, "query_id"), vectors(rows, "id"), k, make, wave)


def _heaviest(most: int, names: list[str]):
    """Batches of (id, terms) to (id, weights): see ``sparse_vectors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            encoded = lists.flatten().dictionary_encode()
            if not len(encoded):
                continue
            order = pc.sort_indices(encoded.dictionary)  # by bytes of UTF-8
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            pair, n = np.unique(row * len(order) + place[encoded.indices.to_numpy()], return_counts=True)
            row = pair // len(order)
            heavy = np.lexsort((pair, -n, row))
            kept = np.sort(heavy[np.arange(len(row)) - np.searchsorted(row, row) < most])
            ids, first = np.unique(row[kept], return_index=True)
            terms = encoded.dictionary.take(order.take(pa.array(pair[kept] % len(order))))
            weights = pa.MapArray.from_arrays(pa.array(np.append(first, len(kept)).astype(np.int32)), terms, pa.array(np.log(1.0 + n[kept])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), weights], names=names)

    return run


def sparse_vectors(texts: DataFrame, terms: Column, most: int) -> DataFrame:
    """(id, weights MAP<STRING, DOUBLE>): ln(1 + count) of the ``most`` heaviest terms; ties go to the smaller term.

    texts: id, text; terms: a column expression ARRAY<STRING> of the text, repeats included. Terms are counted where they are found, in small batches;
    only if an id has several texts, which count as one, are their terms brought together.
    """
    small_batches(texts.sparkSession)
    found = texts.select("id", terms.alias("terms"))
    if texts.groupBy("id").count().where("count > 1").limit(1).count():
        found = found.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    weights = T.StructField("weights", T.MapType(T.StringType(), T.DoubleType(), False))
    return found.mapInArrow(_heaviest(most, ["id", "weights"]), T.StructType([found.schema["id"], weights]))


class SharedTerms:
    """A wave of queries (query_id, terms, weights), which gives their inner products with rows.

    Queries that share a frequent term lie together, in the order of the scores that rows must reach, so that blocks are much alike (of one language, say). What most queries
    of a block have is a dense matrix, the rest an inverted index. A row is summed only with the groups of queries where it may reach one of the ``floors`` (see ``_reaching``); queries with low
    floors, which most rows may reach, have blocks of their own.
    """

    def __init__(self, found: pa.Table, block: int, floors: np.ndarray | None = None):
        lists = found.column(1).chunk(0)
        encoded = lists.flatten().dictionary_encode()
        self.vocabulary, codes = encoded.dictionary, encoded.indices.to_numpy()
        sizes, weights = lists.value_lengths().fill_null(0).to_numpy(), found.column(2).chunk(0).flatten().to_numpy()
        owner = np.repeat(np.arange(len(lists)), sizes)
        anchor, left = np.full(len(lists), ANCHORS), np.arange(len(owner))
        for n in range(ANCHORS):
            if len(left):
                anchor[owner[left[codes[left] == np.bincount(codes[left]).argmax()]]] = n
                left = left[anchor[owner[left]] == ANCHORS]
        order = np.argsort(anchor, kind="stable") if floors is None else np.lexsort((floors, anchor, floors >= np.quantile(floors, LOW, method="lower")))
        place = np.argsort(order)[owner]
        self.blocks = []
        for lo in range(0, len(lists), block):
            members = order[lo : lo + block]
            own = np.flatnonzero((place >= lo) & (place < lo + block))
            code, query, weight = codes[own], place[own] - lo, weights[own]
            common = np.bincount(code, minlength=len(self.vocabulary))
            head = np.argsort(-common, kind="stable")[:HEAD]
            head = head[common[head] >= max(2, HEAD_SHARE * len(members))]
            column = np.full(len(self.vocabulary), -1, np.int16)
            column[head] = np.arange(len(head))
            dense = np.zeros((len(members), len(head)))
            is_head = column[code] >= 0
            np.add.at(dense, (query[is_head], column[code[is_head]]), weight[is_head])
            lengths = np.sqrt(np.bincount(query, weight**2, len(members)))
            largest = np.zeros(len(self.vocabulary))
            np.maximum.at(largest, code, np.abs(weight))
            code, query, weight = code[~is_head], query[~is_head], weight[~is_head]
            index = self._by_code(code, query, weight)
            tops = np.stack([np.abs(dense[lo : lo + GROUP]).max(axis=0) for lo in range(0, len(members), GROUP)])
            heads = tops.astype(np.float32), float(np.sqrt((tops**2).sum(axis=1).max(initial=0)))
            self.blocks.append((members, lengths, largest, dense, heads, column, index, self._envelopes(index)))

    def _by_code(self, code: np.ndarray, query: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An inverted index: where each term's entries begin, their queries and weights."""
        by = np.lexsort((query, code))
        return np.searchsorted(code[by], np.arange(len(self.vocabulary) + 1)).astype(np.int32), query[by], weight[by]

    def _envelopes(self, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of groups of ``GROUP`` queries, with the largest weight that one of a group has for a term, and where its entries begin in the index."""
        first, query, weight = index
        code = np.repeat(np.arange(len(self.vocabulary)), np.diff(first))
        pair, start = np.unique(code * (query.max(initial=0) // GROUP + 1) + query // GROUP, return_index=True)
        most = np.maximum.reduceat(np.abs(weight), start) if len(start) else weight
        return np.searchsorted(code[start], np.arange(len(self.vocabulary) + 1)).astype(np.int32), (query[start] // GROUP).astype(np.int32), most, np.append(start, len(query))

    def codes(self, terms: pa.Array) -> np.ndarray:
        """Numbers of terms, -1 for those of no query."""
        return pc.index_in(terms, value_set=self.vocabulary).fill_null(-1).to_numpy()

    def products(self, ends: np.ndarray, codes: np.ndarray, weights: np.ndarray, floors: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces (queries, rows, sums). Row j has the terms from ends[j] to ends[j + 1]. With ``floors``, pieces are of a group of queries and the rows that may reach a floor there."""
        rows, hit = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), np.flatnonzero(codes >= 0)
        codes, rows, weights = codes[hit], rows[hit], weights[hit]
        norms = np.sqrt(np.bincount(rows, weights**2, len(ends) - 1))
        for members, lengths, largest, dense, heads, column, index, envelopes in self.blocks:
            kept, code, row, w = np.arange(len(ends) - 1), codes, rows, weights
            if floors is not None:
                reach = norms * (1 + 1e-9) >= ((floors[members] - 10.0**-DIGITS) / np.maximum(lengths, 1e-300)).min()
                kept, code, row, w = _of_rows(reach, kept, code, row, w)
                reach = np.bincount(row, largest[code] * np.abs(w), len(kept)) * (1 + 1e-9) >= floors[members].min() - 10.0**-DIGITS
                kept, code, row, w = _of_rows(reach, kept, code, row, w)
            first, single = index[0], dense.astype(np.float32)
            upto = np.concatenate(([0], np.cumsum(np.bincount(row, first[code + 1] - first[code], len(kept)))))
            lo = 0
            while lo < len(kept):
                hi = min(max(lo + 1, int(np.searchsorted(upto, upto[lo] + PRODUCTS, "right")) - 1), lo + max(1, PRODUCTS // len(members)), len(kept))
                at = slice(*np.searchsorted(row, (lo, hi)))
                piece = code[at], row[at] - lo, w[at]
                x = _dense(column, dense.shape[1], hi - lo, *piece)
                if floors is None or (floors[members] == -np.inf).mean() > 0.5:
                    entry, of = _entries(first, piece[0])
                    sums = np.bincount(index[1][entry] * (hi - lo) + piece[1][of], index[2][entry] * piece[2][of], len(members) * (hi - lo))
                    yield members, kept[lo:hi], dense @ x.T + sums.reshape(len(members), hi - lo)
                else:
                    for group, some, sums in self._reaching(floors[members], largest, dense, single, heads, column, index, envelopes, x, *piece):
                        yield members[group], kept[lo:hi][some], sums
                lo = hi

    def _reaching(self, floors: np.ndarray, largest: np.ndarray, dense: np.ndarray, single: np.ndarray, heads: tuple[np.ndarray, float], column: np.ndarray, index: tuple, envelopes: tuple, x: np.ndarray, code: np.ndarray, row: np.ndarray, w: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Sums of each group of queries and the rows that may reach a floor there. In single precision, the product with a group's largest weights for the frequent terms,
        then with its queries' own, and what the others could give, first in the block, then in the group, say which. ``x`` are the frequent terms of the rows."""
        tops, longest = heads
        slack = 1e-4 * longest * np.sqrt((x**2).sum(axis=1)) + 1e-6 * np.abs(floors[np.isfinite(floors)]).max(initial=0) + 10.0**-DIGITS
        narrow, floors = x.astype(np.float32), floors.astype(np.float32)
        wanted = np.minimum.reduceat(floors, np.arange(0, len(floors), GROUP))[:, None] - tops @ np.abs(narrow).T  # of the other terms, at least
        rare = np.flatnonzero(column[code] < 0)
        code, row, w = code[rare], row[rare], w[rare]
        left = ~(wanted.min(axis=0) > np.bincount(row, largest[code] * np.abs(w), len(x)) * (1 + 1e-9) + slack)
        kept, code, row, w = _of_rows(left, np.arange(len(x)), code, row, w)
        entry, of = _entries(envelopes[0], code)
        group, row, w = envelopes[1][entry], row[of], w[of]
        most = np.bincount(group * len(kept) + row, envelopes[2][entry] * np.abs(w), len(wanted) * len(kept)).reshape(len(wanted), len(kept)) * (1 + 1e-9) + slack[left]
        reach = ~(wanted[:, left] > most)
        for g in np.flatnonzero(reach.any(axis=1)).tolist():
            some, of = np.flatnonzero(reach[g]), slice(g * GROUP, (g + 1) * GROUP)
            reach[g, some] = ~((floors[of, None] - single[of] @ narrow[kept[some]].T).min(axis=0) > most[g, some])
        place = np.cumsum(reach.ravel()) - 1  # of a group and row that are summed
        inside = np.flatnonzero(reach[group, row])
        entry, cell, w = entry[inside], place[group[inside] * len(kept) + row[inside]], w[inside]
        at, of = _entries(envelopes[3], entry)
        sums = np.bincount(cell[of] * GROUP + index[1][at] % GROUP, index[2][at] * w[of], GROUP * int(reach.sum())).reshape(-1, GROUP)
        lo = 0
        for g in np.flatnonzero(reach.any(axis=1)).tolist():
            some = kept[reach[g]]
            of = slice(g * GROUP, min((g + 1) * GROUP, len(dense)))
            yield of, some, dense[of] @ x[some].T + sums[lo : lo + len(some), : of.stop - of.start].T
            lo += len(some)


def _of_rows(good: np.ndarray, kept: np.ndarray, code: np.ndarray, row: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are good, and their terms, numbered anew."""
    if good.all():
        return kept, code, row, w
    inside = good[row]
    return kept[good], code[inside], (np.cumsum(good) - 1)[row[inside]], w[inside]


def _dense(column: np.ndarray, width: int, n: int, code: np.ndarray, row: np.ndarray, w: np.ndarray) -> np.ndarray:
    """n rows x the frequent terms."""
    at = column[code]
    hit = np.flatnonzero(at >= 0)
    return np.bincount(row[hit] * width + at[hit], w[hit], n * width).reshape(n, width)


def _entries(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of lists, of which list i goes from first[i] to first[i + 1], and for each which one of ``at`` it belongs to."""
    begin = first[at]
    lens = first[at + 1] - begin
    ends = np.cumsum(lens)
    of = np.repeat(np.arange(len(at)), lens)
    return (begin - (ends - lens))[of] + np.arange(len(of)), of


def sparse_topk(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK_TERMS, wave: int = WAVE) -> DataFrame:
    """(query_id, id, score, rank) of the k rows with the largest inner product above 0.

    queries: query_id, weights MAP<STRING, DOUBLE>; rows: id, weights. Null and empty weights find nothing.
    """

    def make(found: pa.Table, known: np.ndarray | None = None) -> Scorer:
        shared = SharedTerms(found, block, known)

        def score(batch: pa.RecordBatch, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            own, terms = batch.column(0).to_numpy(), batch.column(1)
            ends = np.concatenate(([0], np.cumsum(terms.value_lengths().fill_null(0).to_numpy())))
            for at, piece, sums in shared.products(ends, shared.codes(terms.flatten()), batch.column(2).flatten().to_numpy(), floors):
                yield own[piece], at, sums

        return score

    lists = lambda df, name: df.select(F.col(name).cast("long").alias(name), F.map_keys("weights").alias("terms"), F.map_values("weights").cast("array<double>").alias("w"))
    mass = F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x).alias("mass")
    return _topk(lists(queries, "query_id"), lists(rows, "id").select("*", mass), k, make, wave, ABOVE_0, "mass")


def centroids(vectors: DataFrame, *by: str) -> DataFrame:
    """Mean vector and count of each group. vectors: the group columns and vector."""
    flat = vectors.select(*by, F.posexplode("vector").alias("dim", "x")).groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"])
    return flat.groupBy(*by).agg(packed.alias("centroid"), F.max("n").alias("n"))


def model_centroids(chunks: DataFrame, model: str, dimension: int) -> DataFrame:
    """(centroid_id, domain, retrieval_type, n, dense_model, dense_dimension, centroid) of the chunks that have a vector of this model and dimension."""
    ours = (F.col("dense_model") == model) & (F.col("dense_dimension") == dimension) & F.col("dense_embedding").isNotNull()
    made = centroids(chunks.where(ours).select("domain", "retrieval_type", F.col("dense_embedding").alias("vector")), "domain", "retrieval_type")
    name = F.concat_ws(":", "domain", "retrieval_type", F.lit(model), F.lit(dimension))
    return made.select(name.alias("centroid_id"), "domain", "retrieval_type", "n", F.lit(model).alias("dense_model"), F.lit(dimension).alias("dense_dimension"), "centroid")


def rebuilt_centroids(old: DataFrame, chunks: DataFrame, model: str, dimension: int) -> DataFrame:
    """old with all centroids of one model and dimension replaced by those of the chunks."""
    same = F.col("dense_model").eqNullSafe(F.lit(model)) & F.col("dense_dimension").eqNullSafe(F.lit(dimension))
    return old.where(~same).unionByName(model_centroids(chunks, model, dimension))


def domain_scores(queries: DataFrame, cents: DataFrame) -> DataFrame:
    """(query_id, domain, score): the best cosine similarity over a domain's retrieval types.

    queries: query_id, vector; cents: domain, centroid, a row a domain and type, so they are broadcast.
    """
    pairs = queries.select("query_id", "vector").crossJoin(F.broadcast(cents.select("domain", "centroid")))
    return pairs.groupBy("query_id", "domain").agg(F.max(F.round(cosine(F.col("vector"), F.col("centroid")), DIGITS)).alias("score"))


def cosine(a, b):
    """Cosine similarity of two ARRAY<DOUBLE> columns."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def overlap_topk(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """(query_id, id, score, rank) of the k rows that share most distinct terms, over the smaller set.

    queries: query_id, terms ARRAY<STRING> (distinct); rows: id, terms. Null terms are no terms.
    """

    def make(found: pa.Table, known: np.ndarray | None = None) -> Scorer:
        shared, sizes = SharedTerms(found, block), found.column(1).chunk(0).value_lengths().fill_null(0).to_numpy()

        def score(batch: pa.RecordBatch, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            own, terms = batch.column(0).to_numpy(), batch.column(1)
            lens = terms.value_lengths().fill_null(0).to_numpy()
            flat = terms.flatten()
            for at, piece, sums in shared.products(np.concatenate(([0], np.cumsum(lens))), shared.codes(flat), np.ones(len(flat))):
                yield own[piece], at, sums / np.maximum(1, np.minimum(sizes[at, None], lens[None, piece]))

        return score

    ones = F.transform("terms", lambda t: F.lit(1.0)).alias("w")
    return _topk(queries.select(F.col("query_id").cast("long").alias("query_id"), "terms", ones), rows.select(F.col("id").cast("long").alias("id"), "terms"), k, make, wave)
