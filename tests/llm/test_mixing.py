import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm.mixing import flight, landing, mix, mix_report, mixed, source_targets
from tests.llm.helpers import DOCS, docs_of, rows_of


def water_fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap, total, fixed = {s: most * sizes[s] for s in names}, sum(sizes.values()), {}
    while len(fixed) < len(names):
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[t] for t in names if t not in fixed) for s in names if s not in fixed}
        over = {s: cap[s] for s in share if share[s] > cap[s] + 1e-9}
        if not over:
            return fixed | share
        fixed |= over
    return fixed


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 200)), "en", [None, "b", "a", "c", "é"][min(4, int(rng.integers(0, 9)))], 0) for i in range(4000)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_targets_are_water_filled(spark):
    for sizes in ({"a": 10, "b": 500, "c": 3, None: 70}, {"a": 0, "b": 9}, {"x": 5}, {"a": 0}, {f"s{i:02}": i * i for i in range(20)}):
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(water_fill(sizes))


def test_mix_meets_targets_and_reruns_agree(spark, docs):
    got = mix(docs, block=64)
    rows = rows_of(got)
    assert rows == rows_of(mix(docs.repartition(3), block=64)) and len(rows) == 4000
    by = {}
    for r in got.collect():
        assert 0 <= r["copies"] <= 3
        at = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"], 0])
        at[0] += r["size"] * r["copies"]
        at[1] += r["copies"]
        at[4] += 1
    want = water_fill({s: v[3] for s, v in by.items()})
    for s, (words, copies, target, size, n) in by.items():
        assert target == pytest.approx(want[s])
        assert abs(words - target) <= 200
        assert abs(copies - n * target / size) <= 3  # documents are balanced beside words


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 500):
        sizes, chances = rng.integers(0, 50, n).astype(float), rng.random(n)
        out = flight(sizes, chances, np.random.default_rng(2))
        assert out.sum() == pytest.approx(chances.sum()) and out @ sizes == pytest.approx(chances @ sizes)
        assert ((out > 0) & (out < 1)).sum() <= 2 or n <= 2
        landed = landing(sizes, out)
        assert set(np.unique(landed)) <= {0.0, 1.0}
    equal = flight(np.full(100, 7.0), np.full(100, 0.3), np.random.default_rng(0))
    assert equal.sum() == pytest.approx(30)


def test_chances_are_kept_on_average():
    sizes, chances = np.array([1.0, 5, 2, 9, 4, 4]), np.array([0.2, 0.5, 0.7, 0.4, 0.6, 0.1])
    mean = np.mean([flight(sizes, chances, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert mean == pytest.approx(chances, abs=0.04)


def test_mixed_repeats_rows(spark, docs):
    copies = {r["doc_id"]: r["copies"] for r in mix(docs).collect()}
    got = {r["doc_id"]: r["count"] for r in mixed(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v}
    assert mixed(docs).columns == docs.columns


def test_edges(spark):
    assert mix_report(docs_of(spark, [])).count() == 0 and mixed(docs_of(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None)] * 2 + [(None, "", None, None, 0), (3, "a b", "x", "s", 1), (3, "a b", "x", "s", 1), (3, "a b", "x", "s", 2)], DOCS)
    odd = odd.withColumns({"size": F.lit("9"), "copies": F.lit(1.5), "row": F.lit(None).cast("int"), "tags": F.create_map(F.lit("k"), F.lit(1))})
    got = mix_report(odd).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got) == 6 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixed(odd).where("doc_id = 3").count() == 3
