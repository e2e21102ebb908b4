"""The pipeline on a small corpus, stage by stage, against plain versions of what each stage does."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.helpers import DOCS
from tests.llm.test_decontaminate import ITEM, brute
from tests.llm.test_langid import text_of
from tests.llm.test_mixing import water_fill
from tests.llm.test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    items = [(i, text_of("aa", r, 30)) for i in range(5)]
    rows = []
    for i in range(150):
        lang = r.choice(["aa", "bb", "cc"])
        text = text_of(lang, r, r.randint(5, 80))
        if i % 30 == 1:
            text = text_of("aa", r, 20) + " " + items[i // 30][1] + " " + text_of("aa", r, 20)
        if i % 10 == 3:
            text = rows[-1][1]
        rows.append((i, text, lang, ["x", "y", "z", None][min(3, i % 7)], len(text)))
    long = text_of("bb", r, 400)
    rows += [(200, long, "bb", "x", 1), (201, long.replace(" ", "  ", 3) + " ung", "bb", "x", 1), (202, None, None, None, None), (203, "", "aa", "y", 0), (204, "12 !? 34", "aa", "y", 9), (7, rows[7][1], "aa", "y", 1), (7, rows[7][1], "aa", "y", 1)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, ITEM).write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages(spark, folder, tmp_path):
    path, rows, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), [sorted(rows, key=repr)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "sharding" or docs.columns == columns
        seen.append(sorted((tuple(r) for r in docs.collect()), key=repr))
    start, spoken, single, clean, mix, shards = seen
    letters = [x for x in start if any(c.isalpha() for c in x[1] or "")]
    assert set(spoken) <= set(letters) and len(spoken) >= len(letters) - 2  # a tiny text may be rejected

    prints = {x[1]: slow_fingerprint(x[1], 5) for x in spoken}
    root = slow_components(set(prints.values()), 5)
    firsts = {}
    for x in spoken:
        group = root[prints[x[1]]]
        firsts[group] = min(firsts.get(group, x[0]), x[0])
    assert sorted(x[0] for x in single) == sorted(firsts.values()) and set(single) <= set(spoken)

    leaks = {d for d, _ in brute([x[:2] for x in single], items)}
    assert leaks and clean == [x for x in single if x[0] not in leaks]

    sizes = Counter()
    for x in clean:
        sizes[x[3]] += len(x[1].split())
    want, taken = water_fill(dict(sizes)), Counter()
    for x in mix:
        taken[x[3]] += len(x[1].split())
    assert set(mix) <= set(clean) and max(Counter(x[0] for x in mix).values()) <= 3
    largest = max(len(x[1].split()) for x in clean)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)

    assert Counter(x[0] for x in shards) == Counter(x[0] for x in mix) and len({x[1:3] for x in shards}) == len(mix)


def test_run_is_the_stages(spark, folder):
    path, _, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert {"doc_id", "shard", "row_index"} <= set(got.columns) and got.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None
