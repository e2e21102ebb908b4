import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quernstone.llm.exact_dedup import exact_dedup, heavy_digests, misra_gries
from tests.llm.helpers import DOCS, docs_of

OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = Counter()
        for i in ids:
            keep = i == best and not kept[i]
            kept[i] += keep
            out.append((i, best, len(ids), keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, **options):
    got = sorted((tuple(r) for r in exact_dedup(df, **options).select(*OUT).collect()), key=repr)
    assert got == brute(df.collect())


def test_groups_heavy_and_rare(spark):
    texts = ["hot"] * 300 + ["warm"] * 90 + [f"t{i % 40}" for i in range(100)] + [None, "", None, "x " * 200_000]
    df = docs_of(spark, texts).repartition(7)
    for options in ({}, {"counters": 3, "heavy": 2}, {"heavy": 10_000}):
        check(df, **options)
    assert exact_dedup(df).where("heavy").select("text_sha256").distinct().count() == 2


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "a", None, None, None), (1, "a", None, None, None), (None, "a", "x", "y", 1), (None, "b", None, None, 2), (None, "b", None, None, 2), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"digest": F.lit("x"), "row": F.lit(1), "kept": F.lit(None).cast("string"), "best": F.lit(2)})
    check(df)
    check(df, counters=2, heavy=1)


def test_empty_table(spark):
    check(docs_of(spark, []))


def test_misra_gries_keeps_the_frequent():
    items = [(f"r{i}", 1) for i in range(500)] + [("hot", 1)] * 400 + [(f"q{i}", 1) for i in range(300)]
    held = misra_gries(iter(items), 4)
    assert len(held) <= 4 and held["hot"] <= 400 and "hot" in held
    assert misra_gries(iter([("a", 3), ("b", 2), ("c", 5)]), 2) in ({"a": 1, "c": 3}, {"c": 3, "a": 1})


def test_candidates_are_bounded(spark):
    df = spark.createDataFrame([(bytes([i % 50]),) for i in range(1000)], "digest binary")
    assert heavy_digests(df, 8).count() <= 8
