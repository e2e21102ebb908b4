"""Ranked lexical search over inverted treaps.

1. Documents are dealt to shards of at most ``SHARD_DOCS``. A shard numbers its documents by doc_id and holds, for each term,
   a treap: a tree in the order of documents whose roots have the highest impact. The impact of a term in a document needs
   the size of the collection, which is counted first; the term's weight is the same in all of its documents and comes in at the search.
   The index is a Parquet table, a row for each shard and term, with all terms of all documents.
2. A treap's shape follows from its impacts (ties: the first document is above). It is built for all terms of a shard at
   once, from the nearest larger impacts on either side, and kept as each node's parent.
3. A query set is sent in waves of bounded size. The rows of a wave's terms meet by shard, and all items traverse their terms' treaps at
   the same time, interval of documents by interval: the topmost node of a treap in an interval has the
   term's largest impact there, so the sum over the terms is an upper bound. Where it can't enter an item's top k the interval is left, with all its subtrees.
   Else it is split at the document of the largest impact; intervals of a few documents are scored whole.
4. A few shards go first. The k-th best score of an item there is a threshold that all other shards start from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import lowered, materialize, small_batches
from quernstone.llm.cuts import byte_classes, cut, slices

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CLASSES = byte_classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
TOP = 50
#: Documents of a shard (they are numbered in two bytes), and terms with repeats after which a shard is closed.
SHARD_DOCS, SHARD_TERMS = 1 << 16, 1 << 21
#: Terms of all items of a wave, with repeats across items; they and their items are what a task is sent.
WAVE_TERMS = 1 << 18
#: One shard of so many goes first.
PILOT = 8
#: Intervals of so many documents are scored whole; items are traversed together up to so many terms in all.
WHOLE, TOGETHER = 24, 1 << 11

_INDEX = "shard long, term string, n int, docs binary, impacts binary, parents binary"


def collection(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms with repeats they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for (texts,) in slices(batches, 0):
            row = cut(texts, CLASSES).row
            n, terms = n + len(np.unique(row)), terms + len(row)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], names=["n", "terms"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def parents_of(impacts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The parent of each node of many treaps that lie one behind the other; ``first`` says where each node's treap begins. A root is its own parent.

    A node's parent is the smaller of the nearest larger impacts on either side. The nearest are found for all nodes at once: a
    candidate that is too small is replaced by its own candidate, since all between them is smaller still.
    """
    n = len(impacts)
    at = np.arange(n)
    last = np.empty(n, np.int64)
    if n:
        edge = np.flatnonzero(np.diff(first, prepend=-1))
        last = np.repeat(np.append(edge[1:], n) - 1, np.diff(edge, append=n))
    left, right = at - 1, at + 1
    todo = np.flatnonzero((left >= first) & (impacts[np.maximum(left, 0)] < impacts))
    while len(todo):  # to the left, an equal impact is larger
        left[todo] = left[left[todo]]
        todo = todo[(left[todo] >= first[todo]) & (impacts[np.maximum(left[todo], 0)] < impacts[todo])]
    todo = np.flatnonzero((right <= last) & (impacts[np.minimum(right, n - 1)] <= impacts))
    while len(todo):
        right[todo] = right[right[todo]]
        todo = todo[(right[todo] <= last[todo]) & (impacts[np.minimum(right[todo], n - 1)] <= impacts[todo])]
    has_left, has_right = left >= first, right <= last
    use_left = has_left & (~has_right | (impacts[np.maximum(left, 0)] < impacts[np.minimum(right, max(n - 1, 0))]))
    return np.where(use_left, left, np.where(has_right, right, at))


def _sliced(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """BINARY rows of the values between ends, without a copy a row."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.dtype.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term that comes tf times adds to the score of a document of n terms, before its weight; whole numbers, rounded down."""
    m = 50 + 50 * n * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def shard_rows(ids: np.ndarray, known: np.ndarray, doc: np.ndarray, words: pa.Array, codes: np.ndarray, documents: int, terms: int, shard: int) -> pa.RecordBatch:
    """The index rows of one shard: its documents' ids (term null), then its treaps. ``doc`` and ``codes`` say for each term which document it is in
    and which of ``words`` it is."""
    order = np.lexsort((ids, ~known))  # documents without id are the last
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    size = np.bincount(number[doc], minlength=len(ids))
    pairs, tf = np.unique(codes * len(ids) + number[doc], return_counts=True)
    term, at = np.divmod(pairs, len(ids))
    impacts = impact(tf, size[at], documents, terms)
    ends = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    first = np.repeat(ends[:-1], np.diff(ends))
    parents = parents_of(impacts, first) - first
    names = words.take(pa.array(term[ends[:-1]]))
    treaps = [pa.array(np.full(len(names), shard)), names, pa.array(np.diff(ends).astype(np.int32)), _sliced(at.astype("<u2"), ends), _sliced(impacts.astype("<u4"), ends), _sliced(parents.astype("<u2"), ends)]
    own = [pa.array([shard]), pa.array([None], pa.string()), pa.array([len(ids)], pa.int32()), pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([known[order].astype("u1").tobytes()], pa.binary()), pa.array([b""], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(own, treaps, strict=True)], names=["shard", "term", "n", "docs", "impacts", "parents"])


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, int]:
    """The index of all terms of docs, in the shared folder, and the number of its documents (those with a term).

    Needs columns doc_id and text; others are ignored, whatever their names. Null texts and texts without a term are in no treap. Each
    of repeated rows is a document of its own; rows without doc_id come last among equal scores. Texts may be of any
    length. An empty table has an empty index.
    """
    documents, terms = collection(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        n_docs = n_terms = 0

        def out() -> pa.RecordBatch:
            nonlocal held, n_docs, n_terms, made
            ids, known = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            doc = np.concatenate([h[2] + before for h, before in zip(held, np.cumsum([0, *[len(h[0]) for h in held[:-1]]]), strict=True)])
            words = pa.chunked_array([h[3] for h in held]).combine_chunks().dictionary_encode()
            start = np.cumsum([0, *[len(h[3]) for h in held[:-1]]])
            numbers = words.indices.to_numpy().astype(np.int64)
            codes = np.concatenate([numbers[s : s + len(h[3])][h[4]] for h, s in zip(held, start, strict=True)])
            rows = shard_rows(ids, known, doc, words.dictionary, codes, documents, terms, task << 32 | made)
            held, n_docs, n_terms, made = [], 0, 0, made + 1
            return rows

        for doc_ids, texts in slices(batches, 1):
            found = cut(texts, CLASSES)
            if not len(found.row):
                continue
            rows, doc = np.unique(found.row, return_inverse=True)
            coded = found.words.dictionary_encode()
            own = doc_ids.take(pa.array(rows))
            codes = coded.indices.to_numpy().astype(np.int64)
            for lo in range(0, len(rows), shard_docs):  # a slice may hold more documents than a shard
                inside = (doc >= lo) & (doc < lo + shard_docs)
                part = own.slice(lo, shard_docs)
                if held and (n_docs + len(part) > shard_docs or n_terms + int(inside.sum()) > shard_terms):
                    yield out()
                held.append((part.fill_null(0).to_numpy(), part.is_valid().to_numpy(zero_copy_only=False), doc[inside] - lo, coded.dictionary, codes[inside]))
                n_docs, n_terms = n_docs + len(part), n_terms + int(inside.sum())
        if held:
            yield out()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, _INDEX), "treaps"), documents


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item. Rows of one item_id are one item."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(lowered(F.col("text").cast("string")), F.lit(TERM), F.lit(0)))).alias("term")
    return items.select(F.col("item_id").cast("long").alias("item_id"), found).distinct()


class Treaps:
    """The treaps of some terms in one shard, one behind the other. ``impacts`` are weighted here."""

    def __init__(self, docs: list[bytes], impacts: list[bytes], parents: list[bytes], weights: list[int]):
        sizes = np.array([len(d) // 2 for d in docs], np.int64)
        first = np.cumsum(sizes) - sizes
        start = np.repeat(first, sizes)
        self.docs = np.frombuffer(b"".join(docs), "<u2").astype(np.int64)
        self.impacts = np.frombuffer(b"".join(impacts), "<u4").astype(np.int64) * np.repeat(np.array(weights, np.int64), sizes)
        parents_at = np.frombuffer(b"".join(parents), "<u2").astype(np.int64) + start
        n = len(self.docs)
        at = np.arange(n)
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)  # one more, for the node -1
        self.left[parents_at[parents_at > at]] = at[parents_at > at]
        self.right[parents_at[parents_at < at]] = at[parents_at < at]
        self.roots = at[parents_at == at]
        #: Keys of all postings in ascending order: term, then document.
        self.keys = np.repeat(np.arange(len(sizes)), sizes) << 17 | self.docs
        self.docs, self.impacts = np.append(self.docs, 0), np.append(self.impacts, 0)

    def settle(self, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The topmost nodes strictly between lo and hi under each node, -1 if there are none."""
        nodes = nodes.copy()
        todo = np.flatnonzero(nodes >= 0)
        while len(todo):
            own, doc = nodes[todo], self.docs[nodes[todo]]
            low, high = doc <= lo[todo], doc >= hi[todo]
            moved = low | high
            nodes[todo] = np.where(low, self.right[own], np.where(high, self.left[own], own))
            todo = todo[moved & (nodes[todo] >= 0)]
        return nodes


class Best:
    """The k best (score, document) of each item so far. Documents are numbered in the order in which equal scores rank."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, n = k, len(floors)
        self.scores, self.docs = np.zeros((n, k), np.int64), np.full((n, k), np.iinfo(np.int64).max)
        self.floors = floors  # of other shards: scores below are in no top k

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """The score that a document must reach, and, if only equal to it, the document it must come before."""
        own = self.scores[:, -1]
        return np.maximum(own, self.floors), np.where(own >= self.floors, self.docs[:, -1], np.iinfo(np.int64).max)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        least, before = self.least()
        good = (score > 0) & ((score > least[item]) | ((score == least[item]) & (doc < before[item])))
        item, score, doc = item[good], score[good], doc[good]
        touched = np.unique(item)
        if not len(touched):
            return
        item = np.concatenate((item, np.repeat(touched, self.k)))
        score, doc = np.concatenate((score, self.scores[touched].ravel())), np.concatenate((doc, self.docs[touched].ravel()))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        at = (starts[:, None] + np.arange(self.k)).ravel()
        self.scores[touched], self.docs[touched] = score[at].reshape(-1, self.k), doc[at].reshape(-1, self.k)


def traverse(treaps: Treaps, terms: np.ndarray, n_docs: int, best: Best, rows: np.ndarray, whole: int = WHOLE) -> None:
    """Adds to ``best`` what the items ``rows`` find. ``terms`` has a row an item: the numbers of its terms' treaps, -1 behind the last."""
    item = np.arange(len(terms))
    lo, hi = np.full(len(terms), -1), np.full(len(terms), n_docs)
    nodes = np.where(terms >= 0, np.append(treaps.roots, -1)[terms], -1)
    while len(item):
        bound = np.where(nodes >= 0, treaps.impacts[nodes], 0).sum(axis=1)
        least, before = best.least()
        own = rows[item]
        # of equal scores the first documents rank: an interval behind the k-th needs more than its score
        open_ = (bound > 0) & ((bound > least[own]) | ((bound == least[own]) & (lo + 1 < before[own])))
        item, lo, hi, nodes = item[open_], lo[open_], hi[open_], nodes[open_]
        small = hi - lo <= whole + 1
        _score(treaps, terms, item[small], lo[small], hi[small], best, rows)
        item, lo, hi, nodes = item[~small], lo[~small], hi[~small], nodes[~small]
        if not len(item):
            return
        top = np.argmax(np.where(nodes >= 0, treaps.impacts[nodes], -1), axis=1)
        at = treaps.docs[nodes[np.arange(len(item)), top]]
        _score(treaps, terms, item, at - 1, at + 1, best, rows)
        wide = lambda x: np.broadcast_to(x[:, None], nodes.shape).ravel()
        below = treaps.settle(nodes.ravel(), wide(lo), wide(at)).reshape(nodes.shape)
        above = treaps.settle(nodes.ravel(), wide(at), wide(hi)).reshape(nodes.shape)
        item, lo, hi, nodes = np.concatenate((item, item)), np.concatenate((lo, at)), np.concatenate((at, hi)), np.concatenate((below, above))


def _score(treaps: Treaps, terms: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, best: Best, rows: np.ndarray, most: int = 1 << 21) -> None:
    """Scores all documents strictly between lo and hi for items."""
    step = max(1, most // (terms.shape[1] * 8))
    for part in range(0, len(item), step):
        i, a, b = item[part : part + step], lo[part : part + step], hi[part : part + step]
        own = terms[i]
        row, _ = np.nonzero(own >= 0)
        term = own[own >= 0]
        start = np.searchsorted(treaps.keys, (term << 17) + a[row] + 1)
        n = np.searchsorted(treaps.keys, (term << 17) + b[row]) - start
        upto = np.cumsum(n)
        if not len(upto) or not upto[-1]:
            continue
        at = np.repeat(start - (upto - n), n) + np.arange(upto[-1])
        slot, width = np.repeat(row, n), int((b - a).max())
        score = np.zeros(len(i) * width, np.int64)
        np.add.at(score, slot * width + treaps.docs[at] - a[slot], treaps.impacts[at])
        keys = np.flatnonzero(score)
        where, doc = np.divmod(keys, width)
        best.add(rows[i[where]], score[keys], doc + a[where])


_FOUND = "item int, doc_id long, score long"


def _searcher(shared, k: int):
    """From the index rows of one shard: the k best documents of each item of a wave. ``shared``: the terms of each item, and a floor of scores."""

    def run(table: pa.Table) -> pa.Table:
        item, number, floors = shared.value
        columns = {c: table.column(c).to_pylist() for c in ("number", "weight", "docs", "impacts", "parents")}
        at = [i for i, t in enumerate(columns["number"]) if t is not None]
        at.sort(key=columns["number"].__getitem__)
        own = columns["number"].index(None)
        ids, known = np.frombuffer(columns["docs"][own], "<i8"), np.frombuffer(columns["impacts"][own], "u1") > 0
        treaps = Treaps(*[[columns[c][i] for i in at] for c in ("docs", "impacts", "parents")], [columns["weight"][i] for i in at])
        here = np.full(int(number.max(initial=-1)) + 1, -1)
        here[[columns["number"][i] for i in at]] = np.arange(len(at))
        local = here[number]
        best = Best(floors, k)
        row, term = item[local >= 0], local[local >= 0]  # by item
        sizes = np.bincount(row, minlength=len(floors))
        ends = np.cumsum(sizes)
        by_size = np.argsort(sizes, kind="stable")
        by_size = by_size[sizes[by_size] > 0].tolist()
        while by_size:  # items of like size together, so that little is padded
            width = int(sizes[by_size[-1]])
            group = [by_size.pop() for _ in range(min(len(by_size), max(1, TOGETHER // width)))]
            terms = np.full((len(group), width), -1)
            for r, i in enumerate(group):
                terms[r, : sizes[i]] = term[ends[i] - sizes[i] : ends[i]]
            traverse(treaps, terms, len(ids), best, np.array(group))
        item, place = np.nonzero(best.scores > 0)
        doc = best.docs[item, place]
        return pa.table({"item": pa.array(item.astype(np.int32)), "doc_id": pa.array(ids[doc], mask=~known[doc]), "score": pa.array(best.scores[item, place])})

    return run


def _ranked(found: DataFrame, k: int, by: str = "item") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, documents: int, items: DataFrame, k: int = TOP, wave_terms: int = WAVE_TERMS, pilot: int = PILOT) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by doc_id.

    items needs columns item_id and text; others are ignored. A null text, or one without a term in the index, finds nothing. Rows
    of one item_id are one item with the terms of all; a null id is an id like others. Repeated items are found once. No
    items or an empty index give no rows.
    """
    spark: SparkSession = index.sparkSession
    terms = materialize(item_terms(items), "terms")
    # one scan of the index's terms and sizes; the rest is read for the terms of a wave only
    df = index.where(F.col("term").isNotNull()).select("term", "n").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double")))).cast("long")
    df = materialize(df.select("term", weight.alias("weight")).where("weight > 0"), "weights")
    sizes = terms.groupBy("item_id").agg(F.count("*").alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    waves = max(1, -(-n // wave_terms))
    found = [_wave(spark, index, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(waves)) == w), df, k, pilot) for w in range(waves)]
    return reduce(DataFrame.unionByName, found)


def _wave(spark: SparkSession, index: DataFrame, terms: DataFrame, weights: DataFrame, k: int, pilot: int) -> DataFrame:
    """One wave: its items' terms, about ``WAVE_TERMS`` rows, are read by the driver and sent to all tasks."""
    rows = terms.join(weights, "term").toArrow().combine_chunks()
    coded = rows.column("term").combine_chunks().dictionary_encode()
    ids = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    number, item = coded.indices.to_numpy().astype(np.int64), ids.indices.to_numpy().astype(np.int64)
    order = np.lexsort((number, item))
    number, item = number[order], item[order]
    weight = np.zeros(len(coded.dictionary), np.int64)
    weight[coded.indices.to_numpy()] = rows.column("weight").to_numpy()
    ids = ids.dictionary
    names = spark.createDataFrame(pa.table({"term": coded.dictionary, "number": pa.array(np.arange(len(weight)), pa.int32()), "weight": weight}))
    held = materialize(index.join(F.broadcast(names), "term", "left").where(F.col("number").isNotNull() | F.col("term").isNull()).drop("term", "n"), "wave")
    lead = F.pmod(F.xxhash64("shard"), F.lit(pilot)) == 0

    def best_of(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((item, number, floors))
        return rows.groupBy("shard").applyInArrow(_searcher(shared, k), _FOUND)

    first = materialize(_ranked(best_of(held.where(lead), np.zeros(len(ids), np.int64)), k), "first")
    floors = np.zeros(len(ids), np.int64)
    reached = first.where(F.col("rank") == k).select("item", "score").toArrow()
    floors[reached.column(0).to_numpy()] = reached.column(1).to_numpy()
    both = first.drop("rank").unionByName(best_of(held.where(~lead), floors))
    of = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(ids)), pa.int32()), "item_id": ids}))
    return _ranked(both, k).join(F.broadcast(of), "item").select("item_id", "rank", "doc_id", "score")


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    index, documents = build_index(docs)
    return search(index, documents, items)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, row_number() OVER () AS id FROM documents)
), size AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM words WHERE len(w) > 0),
postings AS (SELECT doc_id, id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, id, w, unnest(w) AS term FROM words) GROUP BY ALL),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM items) GROUP BY term), size
), scores AS (
  SELECT item_id, doc_id, id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), size GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""
