"""Packing documents into sequences by bin completion, a branch and bound over fillings.

1. Texts become token ids once; a document longer than a sequence is cut into whole sequences and
   a rest. Pieces go to a table with their task and their number among the task's pieces of equal length.
2. Pieces of equal length are interchangeable, so the problem is the number of pieces of each length: a
   table of at most ``capacity`` rows, however many documents there are. It is all that is planned over.
3. The plan is a list of runs: a filling, and how many sequences are filled so. Best-fit decreasing gives
   the first incumbent. Bin completion looks for a better one: around the largest length left it
   enumerates fillings, drops those that another dominates (whose items it could hold in place of its own), tries the fullest
   first, as often as the counts allow, and goes back where the waste so far and the least waste of the rest (a bound on
   the number of sequences) reach the incumbent's. It ends at the lower bound or after ``nodes`` nodes.
4. A piece's number among all of its length (sums over tasks) finds its sequence and place in the plan, which is
   broadcast: at most one run for each length and number of it in a sequence. No text or id is
   shuffled for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import BROADCAST_ROWS, materialize, sized
from quernstone.llm.token_output import END_ID, default_vocabulary, id_type, tokenized

CAPACITY = 4096
#: Fillings tried at a node, and nodes after which the incumbent is taken.
WIDTH, NODES = 6, 10_000
#: Second items for which a third is sought.
SECONDS = 24
#: Lengths with the most tokens that are tried several times in a filling.
MASSES = 4

#: A filling: (length, how many), lengths descending. A run: a filling and the number of sequences filled so.
Filling = tuple[tuple[int, int], ...]


class Run(NamedTuple):
    filling: Filling
    times: int


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the sequences that pieces need (Martello and Toth): lengths over a half can't share one, and for any
    k, those of at least k only fit beside them where over capacity - k is left free."""
    n, total = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    half = capacity // 2
    k = np.arange(half + 1)
    below = np.maximum(k - 1, 0)
    alone = n[capacity] - n[capacity - k]
    halves, halves_sum = n[capacity - k] - n[half], total[capacity - k] - total[half]
    small = total[half] - np.where(k > 0, total[below], 0)
    more = np.maximum(0, -(-(small - (halves * capacity - halves_sum)) // capacity))
    return int((alone + halves + more).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """Best-fit decreasing, for all pieces of a length and all sequences of equal room at once."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    free = np.zeros(capacity + 1, np.int64)  # how many open groups have this room

    def put(filling: dict[int, int], times: int, left: int) -> None:
        room.setdefault(left, []).append((filling, times))
        free[left] += 1

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            open_ = np.flatnonzero(free[length:])
            if len(open_):
                at = length + int(open_[0])
                filling, times = room[at].pop()
                free[at] -= 1
            else:
                at, filling, times = capacity, {}, left
            each = at // length
            full = min(times, left // each)
            rest = left - full * each if full < times else 0
            if full:
                put(filling | {length: each}, full, at - each * length)
            if rest:
                put(filling | {length: rest}, 1, at - rest * length)
            if filling and times > full + bool(rest):
                put(filling, times - full - bool(rest), at)
            left -= full * each + rest
    return [Run(tuple(sorted(f.items(), reverse=True)), n) for groups in room.values() for f, n in groups]


def sequences_of(runs: list[Run]) -> int:
    return sum(r.times for r in runs)


def _fits(items: list[int], bins: list[int]) -> bool:
    """Whether items (descending) can be dealt to bins of these sizes."""
    if not items:
        return True
    tried = set()
    for i, size in enumerate(bins):
        if size >= items[0] and size not in tried:
            tried.add(size)
            if _fits(items[1:], [*bins[:i], size - items[0], *bins[i + 1 :]]):
                return True
    return False


def dominates(a: Filling, b: Filling, most: int = 12) -> bool:
    """Whether the items of b fit into places of a's items, so that a solution with b has one with a that is no worse. Fillings of over
    ``most`` items are not compared."""
    one, two = ([x for x, n in f for _ in range(n)] for f in (a, b))
    return len(one) <= most and len(two) <= most and sum(one) >= sum(two) and _fits(two, one)


def fillings(counts: np.ndarray, capacity: int, width: int = WIDTH, often: bool = False) -> list[Filling]:
    """Undominated fillings around the largest length left, the fullest first, then those of fewest items or, if ``often``, those that
    use up the most common lengths. Each is as full as what is left allows."""
    largest = int(np.flatnonzero(counts)[-1])
    have = counts.copy()
    have[largest] -= 1
    lengths = np.flatnonzero(have)
    #: The largest length left up to each size; 0 if there is none.
    upto = np.maximum.accumulate(np.where(have > 0, np.arange(len(have)), 0))
    left = capacity - largest
    starts: list[tuple[int, ...]] = [()]
    one = int(upto[left])
    if one:
        starts.append((one,))
        seconds = lengths[lengths <= left][::-1]
        thirds = upto[np.minimum(left - seconds, seconds)]
        thirds = np.where((thirds == seconds) & (have[seconds] < 2), upto[np.maximum(thirds - 1, 0)], thirds)
        sums = seconds + thirds
        order = np.lexsort((-seconds, -sums))[:width]
        starts += [(int(a), int(b)) for a, b in zip(seconds[order], thirds[order], strict=True) if b]
        for a in seconds[np.linspace(0, len(seconds) - 1, min(SECONDS, len(seconds))).astype(int)].tolist():
            rest = left - a
            inner = lengths[lengths <= min(a, rest)]
            if len(inner):
                last = upto[np.minimum(rest - inner, inner)]
                best = int(np.argmax(inner + last))
                starts.append((a, int(inner[best]), int(last[best])) if last[best] else (a, int(inner[best])))
        # lengths that many pieces have: as often as they fit, or less often with the best pair beside them
        for a in seconds[np.argsort(-(have[seconds] * seconds), kind="stable")[:MASSES]].tolist():
            for k in range(min(left // a, int(have[a])), 0, -1):
                rest = left - k * a
                inner = lengths[(lengths <= rest) & (lengths != a)]
                last = upto[np.minimum(rest - inner, inner)] if len(inner) else inner
                best = int(np.argmax(inner + last)) if len(inner) else -1
                starts.append((*[a] * k, *([int(inner[best]), int(last[best])] if best >= 0 else [])))
    found: dict[Filling, int] = {}
    for start in starts:
        used: dict[int, int] = {largest: 1}
        free = left
        for x in start:
            if 0 < x <= free and used.get(x, 0) < counts[x]:
                used[x] = used.get(x, 0) + 1
                free -= x
        size = free
        while size > 0 and (x := int(upto[size])):  # whatever else fits: what is not full is dominated by what is fuller
            n = min(free // x, int(counts[x]) - used.get(x, 0))
            if n > 0:
                used[x] = used.get(x, 0) + n
                free -= n * x
            size = min(free, x - 1)
        found[tuple(sorted(used.items(), reverse=True))] = free
    common = (lambda f: -sum(x * n * int(counts[x]) for x, n in f)) if often else (lambda f: 0)
    ranked = sorted(found, key=lambda f: (found[f], common(f), sum(n for _, n in f), tuple(-x for x, _ in f)))
    kept: list[Filling] = []
    for f in ranked:
        if len(kept) == width or (kept and found[kept[0]] == 0 and len(kept[0]) == 2 and kept[0][1][1] == 1 and kept[0][0][1] == 1):
            break  # one item that fills the sequence dominates all else
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def complete(counts: np.ndarray, capacity: int, width: int = WIDTH, nodes: int = NODES) -> list[Run]:
    """The plan with the fewest sequences found. A node fills sequences around the largest length left; its branches are undominated fillings."""
    counts = counts.astype(np.int64)
    best, bound = best_fit(counts, capacity), least_sequences(counts, capacity)
    for often in (False, True):
        best = _search(counts.copy(), capacity, best, bound, width, nodes, often)
    return best


def _search(counts: np.ndarray, capacity: int, best: list[Run], bound: int, width: int, nodes: int, often: bool) -> list[Run]:
    n_best = sequences_of(best)
    taken: list[Run] = []
    n_taken = 0
    #: The branches not yet tried at each node on the path.
    path: list[list[Filling]] = []
    forward = True
    while n_best > bound and nodes > 0:
        if forward:
            nodes -= 1
            if not counts.any():
                if n_taken < n_best:
                    best, n_best = list(taken), n_taken
                forward = False
                continue
            if n_taken + least_sequences(counts, capacity) >= n_best:
                forward = False
                continue
            path.append(fillings(counts, capacity, width, often)[::-1])
        else:
            if not path:
                break
            if len(taken) == len(path):
                run = taken.pop()
                n_taken -= run.times
                for x, n in run.filling:
                    counts[x] += n * run.times
            if not path[-1]:
                path.pop()
                continue
            forward = True
        filling = path[-1].pop()
        times = min(int(counts[x]) // n for x, n in filling)
        for x, n in filling:
            counts[x] -= n * times
        taken.append(Run(filling, times))
        n_taken += times
    return best


_PIECES = "doc_id long, piece int, start long, length int, task int, nth long, ids binary"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, task, nth, ids BINARY of u32): the ids of each document, cut where it is longer than a sequence.
    ``nth`` counts the pieces of one length that a task has made."""
    kind = id_type(vocabulary or default_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            sizes = np.array([len(i) for i in ids], np.int64) // np.dtype(kind).itemsize
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(ids)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(sizes[row] - piece * capacity, capacity)
            order = np.argsort(length, kind="stable")
            own = length[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row))) + made[own]
            made += np.bincount(length, minlength=capacity + 1)
            wide = np.frombuffer(b"".join(ids), kind).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)
            columns = [
                batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length.astype(np.int32)), pa.array(np.full(len(row), task, np.int32)), pa.array(nth),
                pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(wide)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "task", "nth", "ids"])

    return tokenized(docs, vocabulary, end_id).mapInArrow(run, _PIECES)


_PLAN = "length int, first_rank long, n long, each long, first_sequence long, first_offset long"


def plan_rows(runs: list[Run]) -> pd.DataFrame:
    """Where the pieces of each length go, in the order of their numbers: ``each`` to a sequence, side by side from an offset."""
    rows, used, first = [], {}, 0
    for filling, times in runs:
        offset = 0
        for length, each in filling:
            rows.append((length, used.get(length, 0), each * times, each, first, offset))
            used[length] = used.get(length, 0) + each * times
            offset += each * length
        first += times
    frame = pd.DataFrame(rows, columns=["length", "first_rank", "n", "each", "first_sequence", "first_offset"])
    return frame.sort_values(["length", "first_rank"])


def plan(lengths: DataFrame, capacity: int = CAPACITY, width: int = WIDTH, nodes: int = NODES) -> DataFrame:
    """The plan for a table (length, n) of at most ``capacity`` rows, made in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(capacity + 1, np.int64)
        counts[rows["length"]] = rows["n"]
        return plan_rows(complete(counts, capacity, width, nodes))

    return lengths.groupBy().applyInPandas(run, _PLAN)


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids BINARY of u32, sequence_id, offset.

    Needs columns doc_id and text; others are ignored. A null or empty text is the end id alone, a piece of length 1. Each of
    repeated rows is a document of its own, and so is a row without doc_id. Only documents longer than ``capacity`` are cut, into whole sequences
    and a rest, however long they are. Sequences are numbered from 0 without gaps; which of the pieces of equal length is where has no meaning. An empty table gives no rows.
    """
    pieces = materialize(pieces_of(docs, capacity, vocabulary, end_id), "pieces")
    made = materialize(pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")), "lengths")
    rows = materialize(plan(made.groupBy("length").agg(F.sum("n").alias("n")), capacity), "plan").orderBy("length", "first_rank").toArrow()
    length, first, n, each, sequence, offset = (rows.column(i).to_numpy().astype(np.int64) for i in range(6))
    #: Numbers of pieces, those of shorter lengths first.
    base = np.concatenate(([0], np.cumsum(np.bincount(length, n, capacity + 1))[:-1])).astype(np.int64) if len(n) else np.zeros(capacity + 1, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((base, base[length] + first, each, sequence, offset))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task that made one of the length
    before = made.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, starts, each, sequence, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = base[length] + rank
            run = np.searchsorted(starts, at, "right") - 1
            inside = at - starts[run]
            found = [sequence[run] + inside // each[run], offset[run] + inside % each[run] * length]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids")]
            columns[3] = columns[3].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    ranked = pieces.join(sized(before, made.count(), BROADCAST_ROWS), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids BINARY of u32, doc_ids, offsets): the sequences that ``packed`` describes, a row each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` of them
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def packing_report(docs: DataFrame) -> DataFrame:
    return packed(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

