import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.llm import decontaminate
from quernstone.llm.decontaminate import clean, find_leaks, item_index, shingle_hashes, similarity, simhash, slots_an_item
from tests.llm.helpers import DOCS, docs_of, rows_of

ITEM = "item_id long, text string"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(docs, items, least=0.8):
    """All windows of the item's size of all documents."""
    out = {}
    for d, t in docs:
        s = shingles(t)
        for i, x in items:
            want = shingles(x)
            m = len(want)
            best = max((jaccard(s[p : p + m], want) for p in range(max(1, len(s) - m + 1))), default=0) if s and want else 0
            if best >= least:
                out[d, i] = best
    return out


@pytest.fixture(scope="module")
def planted():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(r.choices(vocab, k=r.choice((12, 30, 31, 60))))) for i in range(25)]
    docs = []
    for d in range(60):
        body = r.choices(vocab, k=r.randint(0, 200))
        if d % 2:
            passage = r.choice(items)[1].split()
            for _ in range(d % 5 // 2):  # up to two edits
                passage[r.randrange(len(passage))] = "edited"
            at = r.randint(0, len(body))
            body[at:at] = [p.upper() for p in passage]
        docs.append((d, " \n".join(body)))
    return docs, items


def test_equals_brute_force(spark, planted):
    docs, items = planted
    df = docs_of(spark, [t for _, t in docs]).withColumns({"item_id": F.lit(1), "m": F.lit("x"), "s": F.lit(None).cast("int"), "text_key": F.lit(2)})
    bench = spark.createDataFrame(items, ITEM).withColumns({"doc_id": F.lit(1), "item": F.lit("y")})
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(df, bench).collect()}
    assert set(got) == set(want) and len(want) > 12
    assert all(got[k]["similarity"] == pytest.approx(want[k]) for k in want)
    dirty = {d for d, _ in want}
    kept = clean(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - dirty


def test_simhash_and_similarity(spark):
    r = random.Random(3)
    rows = [([r.getrandbits(64) - 2**63 for _ in range(r.randint(1, 300))],) for _ in range(30)] + [([-1] * 1000,), ([5],), ([3, 3, 4],)]
    df = spark.createDataFrame(rows, "h array<bigint>")
    for row, got in zip(rows, df.select(simhash(F.col("h"))).collect(), strict=True):
        h = [x % 2**64 for x in row[0]]
        assert got[0] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    pairs = [([1, 1, 2], [1, 2, 2]), ([1, 2], [2, 3]), ([1], [1]), ([1, 1], [1])] + [([r.randint(0, 6) for _ in range(r.randint(1, 40))], [r.randint(0, 6) for _ in range(r.randint(1, 40))]) for _ in range(60)]
    got = [x[0] for x in spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>").select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [2 / 4, 1 / 3, 1, 1 / 2] and got == [pytest.approx(jaccard(a, b)) for a, b in pairs]


def test_index_holds_all_within_the_radius(spark):
    r = random.Random(4)
    fp = r.getrandbits(64)
    items = spark.createDataFrame([(1, 9, fp - 2**64 if fp >> 63 else fp)], "item_id long, m int, item_fp long")
    slots = {x["slot"] for x in item_index(items, 19).collect()}
    assert len(slots) == slots_an_item(19) == 4 * (1 + 13 + 78 + 286) + 1 + 12 + 66 + 220
    for _ in range(2000):
        near = fp ^ sum(1 << b for b in r.sample(range(64), 19))
        assert any(9 * (5 << 13) + (b << 13) + (near >> 13 * b & 0x1FFF) in slots for b in range(5))


def test_edges(spark, planted):
    _, items = planted
    passage = items[0][1]
    rows = [(1, None), (2, ""), (3, " \n"), (None, passage), (5, passage), (5, passage), (6, "short item"), (7, "a short item"), (8, " ".join(passage.split()[:-1])), (9, "word " * 100_000 + passage)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "Short  item"), (None, "word word word word word word")], ITEM)
    got = rows_of(find_leaks(df, bench), "doc_id", "item_id")
    assert got == sorted([(None, 0), (5, 0), (6, 92), (8, 0), (9, 0), (9, None)], key=repr)
    assert find_leaks(docs_of(spark, []), bench).count() == 0 and find_leaks(df, spark.createDataFrame([], ITEM)).count() == 0
    assert clean(df, spark.createDataFrame([], ITEM)).count() == len(rows) and clean(docs_of(spark, []), bench).count() == 0


def test_shingles_of_whole_texts(spark):
    texts = [None, "", "a", "A b", "a b c d", "a b c d e", "a b c d e f", "x\x0by"]
    got = [r[0] for r in docs_of(spark, texts).select(shingle_hashes(F.col("text"))).collect()]
    assert [len(g) for g in got] == [0, 0, 1, 1, 1, 1, 2, 1] and got[5][0] == got[6][0] and len({g[0] for g in got[2:6]}) == 4


def test_long_items(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    texts = ["word " * 40_003, "x " + long + " y", long[: len(long) // 2], "word " * 100]
    items = spark.createDataFrame([(1, "word " * 40_000), (2, long)], ITEM)
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 6), r["start"], r["n_words"]) for r in find_leaks(docs_of(spark, texts), items).collect()}
    assert got == {(0, 1): (1, 0, 40_000), (1, 2): (1, 1, 70_000)}


def test_passes_over_parts_of_a_large_benchmark_find_the_same(spark, planted, monkeypatch):
    docs, items = planted
    df, bench = docs_of(spark, [t for _, t in docs]), spark.createDataFrame(items, ITEM)
    want = rows_of(find_leaks(df, bench))
    monkeypatch.setattr(decontaminate, "SEED_ROWS", 300)
    assert rows_of(find_leaks(df, bench)) == want and want


def test_recall_at_080_and_090(spark):
    """Edited copies of items inside other words, by exact similarity: at least 0.99 of those from 0.8 on are found."""
    r = random.Random(21)
    items = [(i, " ".join(f"v{r.randint(0, 5000)}" for _ in range(r.randint(60, 160)))) for i in range(400)]
    docs = []
    for i, text in items:
        words = text.split()
        share = (0.8, 0.9)[i % 2]
        while True:  # edit words until the similarity would fall below
            edited = list(words)
            edited[r.randrange(len(words))] = f"e{r.randint(0, 10**9)}"
            if jaccard(shingles(" ".join(edited)), shingles(text)) < share:
                break
            words = edited
        docs.append((i, "before " * 30 + " ".join(words) + " after" * 30))
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in find_leaks(docs_of(spark, [t for _, t in docs]), spark.createDataFrame(items, ITEM)).collect()}
    found = [[(i, i) in got for i in range(400) if i % 2 == k] for k in (0, 1)]
    recall = [sum(f) / len(f) for f in found]
    print("recall at 0.8 and 0.9:", recall)
    assert recall[0] >= 0.99 and recall[1] == 1


BIG = """
import random, sys
sys.path.insert(0, {repo!r})
from quernstone.llm.decontaminate import find_leaks
from quernstone.session import local_session

spark = local_session(4, memory="1500m", **{{"spark.sql.shuffle.partitions": "8"}})
r = random.Random(3)
vocabulary = [f"w{{i}}" for i in range(5000)]
items = [(i, " ".join(r.choices(vocabulary, k=30))) for i in range(20_000)]
docs, want = [], set()
for d in range(70):
    body = r.choices(vocabulary, k=100)
    if d % 2:
        i = r.randrange(len(items))
        body[50:50] = items[i][1].split()
        want.add((d, i))
    docs.append((d, " ".join(body)))
found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
assert {{(x.doc_id, x.item_id) for x in found.collect()}} == want and len(want) == 35
"""


def test_a_benchmark_of_many_items_in_a_small_heap():
    """Its index has 36 million slots: no table of that size may be broadcast. The heap is that of the driver and of all tasks."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", BIG.format(repo=repo)], check=True, timeout=900, capture_output=True)
