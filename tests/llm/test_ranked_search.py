import math
import re
from collections import Counter, defaultdict

import numpy as np

from quernstone.llm.ranked_search import TERM, Best, Treaps, build_index, parents_of, search, traverse
from tests.llm.helpers import DOCS, docs_of

ITEMS = "item_id long, text string"


def terms_of(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    rows = [(r["doc_id"], Counter(terms_of(r["text"]))) for r in docs.collect()]
    rows = [r for r in rows if r[1]]
    n, size = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = defaultdict(set)
    for r in items.collect():
        asked[r["item_id"]].update(terms_of(r["text"]))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in rows:
            m = 50 + 50 * sum(c.values()) * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if null else doc, -score))
    return sorted(out, key=repr)


def check(docs, items, k=50, pilot=3, wave_terms=1 << 18, **options):
    index, n = build_index(docs, **options)
    got = sorted((tuple(r) for r in search(index, n, items, k, wave_terms, pilot).collect()), key=repr)
    assert got == brute(docs, items, k)
    return got


def texts_of(n, seed=1, longest=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "of", "and", "É_é", "naïve", *[f"w{i}" for i in range(300)]]
    p = 1 / (1 + np.arange(len(vocabulary)))
    return [" ,".join(rng.choice(vocabulary, size=int(rng.integers(0, longest)), p=p / p.sum())) for _ in range(n)]


def items_of(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), ITEMS)


def test_parents():
    rng = np.random.default_rng(0)

    def plain(values, lo, hi, up, out):
        if lo < hi:
            root = max(range(lo, hi), key=lambda i: (values[i], -i))
            out[root] = root if up is None else up
            plain(values, lo, root, root, out)
            plain(values, root + 1, hi, root, out)

    for _ in range(60):
        sizes = rng.integers(1, 40, int(rng.integers(1, 6)))
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        values = rng.integers(0, int(rng.choice([2, 5, 1000])), int(sizes.sum()))
        out = np.zeros(len(values), np.int64)
        for lo, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
            plain(values, int(lo), int(lo + n), None, out)
        assert (parents_of(values, first) == out).all()
    for values in (np.arange(50_000), np.arange(50_000)[::-1], np.full(50_000, 7)):
        assert (np.sort(parents_of(values, np.zeros(len(values), np.int64))) >= 0).all()
    assert len(parents_of(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_traversal_prunes_and_is_exact():
    rng = np.random.default_rng(4)
    n_docs = 4000
    lists = [np.sort(rng.choice(n_docs, int(rng.integers(1, n_docs)), replace=False)) for _ in range(12)]
    impacts = [rng.pareto(1.5, len(x)).clip(0, 1e4).astype(np.int64) + 1 for x in lists]
    parents = [parents_of(i, np.zeros(len(i), np.int64)) for i in impacts]
    treaps = Treaps([x.astype("<u2").tobytes() for x in lists], [x.astype("<u4").tobytes() for x in impacts], [x.astype("<u2").tobytes() for x in parents], [3] * 12)
    scored = []
    best = Best(np.zeros(2, np.int64), 5)
    add = best.add
    best.add = lambda item, score, doc: (scored.append(len(doc)), add(item, score, doc))
    terms = np.array([[*range(12)], [0, 5, 7, *[-1] * 9]])
    traverse(treaps, terms, n_docs, best, np.arange(2))
    for row in range(2):
        total = np.zeros(n_docs, np.int64)
        for t in terms[row][terms[row] >= 0]:
            total[lists[t]] += 3 * impacts[t]
        want = np.lexsort((np.arange(n_docs), -total))[:5]
        assert best.docs[row].tolist() == want.tolist() and best.scores[row].tolist() == total[want].tolist()
    assert sum(scored) < n_docs  # two items over n_docs documents: over half were never scored


def test_against_brute_force(spark):
    texts = [*texts_of(400), *["the of w9"] * 90, "w7 " * 50_000, None, "", " .;", "W9-w9"]
    docs, items = docs_of(spark, texts).repartition(6), items_of(spark, [*texts_of(12, 7, 40), "the of w9", "unknown", None, "", "w7 w7", "nothing"])
    for options in ({}, {"shard_docs": 16}, {"shard_docs": 40, "wave_terms": 60, "k": 7}, {"shard_terms": 300, "pilot": 1}):
        assert len(check(docs, items, **options)) > 20


def test_nulls_repeats_ties_and_clashing_columns(spark):
    rows = [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts_of(80, 3))]
    docs = spark.createDataFrame([*rows, *rows[:30], *rows[:30]], DOCS).withColumnRenamed("lang", "term").withColumnRenamed("source", "Shard")
    items = items_of(spark, ["the w1", "of w2", "w3 w4", "w3 w4", "of w2"], [5, 5, None, 6, None])
    check(docs, items, shard_docs=11)
    check(docs, items, k=4)
    index, n = build_index(docs.limit(0))
    assert search(index, n, items).count() == 0
    index, n = build_index(docs)
    assert search(index, n, items.limit(0)).count() == 0
