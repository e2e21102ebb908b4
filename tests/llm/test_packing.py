import itertools
import zlib

import numpy as np
import pytest

from quernstone.llm.packing import CAPACITY, best_fit, complete, dominates, fillings, least_sequences, packed, packing_report, sequences, sequences_of
from quernstone.llm.token_output import default_vocabulary, tokenizer
from tests.llm.helpers import DOCS, docs_of


def fewest(items, capacity):
    """The optimum, by trying all ways."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(items):
            return
        if i == len(items):
            best = min(best, len(bins))
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def assert_plan(runs, counts, capacity):
    used = np.zeros_like(counts)
    for filling, times in runs:
        assert times > 0 and sum(x * n for x, n in filling) <= capacity
        for x, n in filling:
            used[x] += n * times
    assert (used == counts).all()


def test_plans_hold_every_piece_and_are_optimal_on_small_problems():
    rng = np.random.default_rng(5)
    better = 0
    for _ in range(150):
        capacity = int(rng.integers(10, 60))
        items = sorted(rng.integers(1, capacity + 1, int(rng.integers(0, 11))).tolist(), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        plain, plan = best_fit(counts, capacity), complete(counts, capacity)
        assert_plan(plain, counts, capacity)
        assert_plan(plan, counts, capacity)
        assert least_sequences(counts, capacity) <= fewest(items, capacity) == sequences_of(plan) <= sequences_of(plain)
        better += sequences_of(plan) < sequences_of(plain)
    assert sequences_of(complete(np.bincount([6, 5, 5, 4, 4, 3, 3], minlength=11), 10)) == 3


def test_completion_beats_best_fit():
    items = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # best-fit decreasing takes three of 61
    counts = np.bincount(items, minlength=62)
    assert sequences_of(complete(counts, 61)) == fewest(items, 61) == 3


def test_many_pieces_come_near_the_bound_in_bounded_steps():
    rng = np.random.default_rng(7)
    counts = np.bincount(np.clip(rng.lognormal(6.5, 1.2, 30_000), 1, CAPACITY).astype(int), minlength=CAPACITY + 1)
    plan = complete(counts * 1000, CAPACITY)  # thirty million pieces, planned over their lengths
    assert_plan(plan, counts * 1000, CAPACITY)
    assert sequences_of(plan) <= least_sequences(counts * 1000, CAPACITY) + 1 and len(plan) < 40_000
    hot = counts + np.bincount([777], minlength=CAPACITY + 1) * 20_000
    plan = complete(hot, CAPACITY)
    assert_plan(plan, hot, CAPACITY)
    assert sequences_of(plan) <= sequences_of(best_fit(hot, CAPACITY))


def test_dominance_and_fillings():
    assert dominates(((10, 1), (5, 1)), ((10, 1), (3, 1), (2, 1))) and not dominates(((10, 1), (3, 1), (2, 1)), ((10, 1), (5, 1)))
    counts = np.bincount([10, 5, 3, 2, 2], minlength=16)
    found = fillings(counts, 15)
    assert found == [((10, 1), (5, 1))]
    for f in fillings(np.bincount([9, 4, 3, 3, 1], minlength=17), 16):
        assert f[0][0] == 9 and sum(x * n for x, n in f) <= 16


def check(df, capacity):
    encode = tokenizer(default_vocabulary()).encode
    rows = packed(df, capacity=capacity).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for doc, many in texts.items():
        whole = sorted(tuple([*encode(t or "", add_special_tokens=False).ids, 1]) for t in many)
        parts = sorted(got.pop(doc), key=lambda r: r["piece"])
        if len(many) == 1:
            assert [r["piece"] for r in parts] == list(range(len(parts))) and [r["start"] for r in parts] == [capacity * i for i in range(len(parts))]
            assert tuple(np.frombuffer(b"".join(r["ids"] for r in parts), "<u4")) == whole[0]
        assert sum(r["length"] for r in parts) == sum(map(len, whole))
        assert all(r["length"] == len(r["ids"]) // 4 for r in parts)
    assert not got
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(at) == list(range(len(at)))
    for parts in at.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= capacity
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts))
    return rows


def test_pieces_lie_side_by_side(spark):
    texts = [None, "", "one two three", "word " * 300, "a b " * 20_000, *["same text again"] * 40, *[f"text {'x ' * (i % 17)}" for i in range(120)]]
    df = docs_of(spark, texts).repartition(5)
    rows = check(df, 64)
    counts = np.bincount([r["length"] for r in rows], minlength=65)
    assert len({r["sequence_id"] for r in rows}) == sequences_of(complete(counts, 64))
    whole = sequences(packed(df, capacity=64)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in rows) and max(len(r["ids"]) for r in whole) <= 4 * 64
    assert all(r["offsets"] == sorted(r["offsets"]) for r in whole)


def test_report_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", "x", "y", 1), (1, "a b", "x", "y", 1), (None, "c", None, None, None), (2, None, "x", "y", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "sequence_id").withColumnRenamed("source", "Ids")
    got = packing_report(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["length"]) for r in got) == [(False, 1, 3), (False, 1, 3), (False, 2, 1), (True, 0, 2)]
    assert next(r["ids_crc32"] for r in got if r["doc_id"] == 2) == zlib.crc32(np.array([1], "<u4").tobytes())
    assert {r["sequence_id"] for r in got} == {0} and sorted(r["offset"] for r in got)[0] == 0
    assert packing_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op13_pack"])
def test_query_over_whole_table(spark, name):
    from quernstone.llm.registry import queries

    rows = queries()[name](spark, "/root/testdata/sf0.001").collect()
    counts = np.bincount([r["length"] for r in rows], minlength=CAPACITY + 1)
    assert len({r["doc_id"] for r in rows}) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len({r["sequence_id"] for r in rows}) <= least_sequences(counts, CAPACITY) + 1
