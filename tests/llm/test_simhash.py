import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import simhash
from quernstone.llm.simhash import CHECK_RADIUS, CHECK_WORDS, HELD, _sifted, components, covering_masks, fingerprint, links, minima, near_dedup, shingles, signed, simhash_report
from tests.llm.helpers import DOCS, docs_of, rows_of


def slow_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, radius):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints_equal_the_plain_way():
    r = random.Random(1)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É Ä x y", "a  b\x0bc\x0cd\r\ne \x1c f g  h"] + [" ".join(r.choices("abcdefgh", k=r.randint(1, 900))) for _ in range(20)]
    for t in texts:
        assert fingerprint(t) == slow_fingerprint(t), t
        assert fingerprint(t, 5) == slow_fingerprint(t, 5)


def test_every_pair_within_the_radius_collides():
    r = random.Random(2)
    for radius in (1, 3, 5):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            diff = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not diff & m for m in masks)
        free = [b for b in range(64) if not masks[0] >> b & 1]
        for _ in range(500):
            diff = sum(1 << b for b in r.sample(free, radius))
            assert any(not diff & m for m in covering_masks(radius, free))


def clustered(n, seed):
    r, out = random.Random(seed), set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 30)):
            out.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    return sorted(out)[:n]


def test_links_and_components_equal_brute_force(spark):
    for radius, large in ((3, 1024), (3, 3), (2, 2)):
        fps = clustered(400, radius + large)
        df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
        found = {x: x for x in map(signed, fps)} | {r["node"]: r["root"] for r in components(links(df, radius, large)).collect()}
        slow = slow_components(fps, radius)
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
        assert groups(found) == groups({signed(k): signed(v) for k, v in slow.items()})


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(105, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {105: 100, 100: 100}


def test_components_of_graphs_with_hubs(spark, monkeypatch):
    from quernstone.llm import simhash

    r = random.Random(8)
    edges = [(n, 0) for n in range(1, 400)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(40)] + [(5000 + n, 5001 + n) for n in range(20)] + [(399, 5003)]
    edges = {(max(e), min(e)) for e in edges if e[0] != e[1]}
    root = {n: n for e in edges for n in e}
    for _ in range(len(edges)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(sorted(edges), "a long, b long").repartition(3)
    for rows, hubs in ((0, 4), (0, 4096), (200_000, 4096)):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(simhash, "HUBS", hubs)
        assert {x["node"]: x["root"] for x in simhash.components(frame).collect()} == root


def test_report_equals_brute_force(spark):
    r = random.Random(5)
    base = [r.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=300) for _ in range(6)]
    texts = [" ".join(w[:i] + ["new"] * (i % 3) + w[i:]) for w in base for i in range(0, 40, 4)] + [None, "", "one", "one", " "]
    df = docs_of(spark, texts).withColumns({"fp": F.lit("x"), "root": F.lit(1), "fingerprint": F.lit(2)})
    fps = [slow_fingerprint(t) for t in texts]
    root = slow_components(set(fps), 3)
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(root[f], i)
    assert rows_of(simhash_report(df)) == sorted(((i, f"{f:016x}", first[root[f]]) for i, f in enumerate(fps)), key=repr)


def test_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i % 50}" for i in range(500))
    rows = [(5, text, "en", "s", 1), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text, None, None, None), (4, "other text altogether here now", "en", None, 2), (None, None, None, None, None), (9, "", "x", "y", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"quern_row": F.lit(1), "fp": F.lit("f")})
    assert rows_of(near_dedup(df), "doc_id") == sorted([(3,), (4,), (9,)], key=repr) and near_dedup(df).columns == df.columns


def test_empty_table(spark):
    assert simhash_report(docs_of(spark, [])).count() == 0 and near_dedup(docs_of(spark, [])).count() == 0


def jaccard_groups(rows, least=0.8):
    """(doc_id, text) to the smallest doc_id of each group of texts that five-word Jaccard similarities of at least ``least`` join."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in sets}


def near_copies(seed, n):
    """Texts of 40 to 200 words, and versions of them with a few words replaced: similarities on both sides of 0.8."""
    r, rows = random.Random(seed), []
    for _ in range(n):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(40, 200))]
        for changes in (0, 1, 1, 2, 3, 4):
            w = list(base)
            for at in r.sample(range(len(w)), changes):
                w[at] = f"new{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_dedup_equals_brute_force_jaccard(spark):
    rows = near_copies(7, 60)
    want = jaccard_groups(rows)
    assert 60 < len(want) < len(rows) - 60  # some versions are near copies, some are not
    got = near_dedup(docs_of(spark, [t for _, t in rows]))
    assert {r["doc_id"] for r in got.collect()} == want


def test_dedup_keeps_texts_that_only_their_fingerprints_join(spark):
    texts = ["one two three four five six seven " * 50 + " ".join(f"{x}{i}" for i in range(20)) for x in "ab"]
    assert (fingerprint(texts[0], 5) ^ fingerprint(texts[1], 5)).bit_count() <= 5
    assert near_dedup(docs_of(spark, texts)).count() == 2


def sift(rows, held):
    """Links of one bucket's texts by _sifted, in batches of 7 rows; unsure ones are verified here."""
    found = [shingles(t) for t in rows]
    nodes = list(range(len(rows)))
    table = pa.table({
        "key": pa.array([5] * len(rows), pa.int64()), "node": pa.array(nodes, pa.int64()), "n": pa.array([len(s) for _, s in found], pa.int32()), "root": pa.array(nodes, pa.int64()),
        "signature": pa.array([minima(s).astype(np.uint8).tobytes() for _, s in found], pa.binary()),
        "shingles": pa.array([None if k % 10 == 3 else s.view(np.int64) for k, (_, s) in enumerate(found)], pa.list_(pa.int64())),
    })
    pairs = [p for out in _sifted(0.8, held)(iter(table.to_batches(7))) for p in out.to_pylist()]
    sets = [set(s.tolist()) for _, s in found]
    near = lambda p: len(sets[p["a"]] & sets[p["b"]]) >= 0.8 * len(sets[p["a"]] | sets[p["b"]]) - 1e-9
    assert all(p["a"] > p["b"] and (near(p) or not p["sure"]) for p in pairs)
    return pairs, [(p["a"], p["b"]) for p in pairs if near(p)]


@pytest.mark.parametrize("held", [HELD, 2000])
def test_a_bucket_links_what_is_similar(held):
    rows = [t for _, t in near_copies(3, 20)]
    pairs, links = sift(rows, held)
    root = list(range(len(rows)))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert {root[k] for k in range(len(rows))} == jaccard_groups(list(enumerate(rows)))
    assert any(p["sure"] for p in pairs) == (held == HELD)


def test_a_bucket_of_texts_below_the_similarity_sends_no_pairs():
    common = " ".join(f"c{k}" for k in range(80))
    rows = [common + " " + " ".join(f"x{i}y{k}" for k in range(14)) for i in range(60)]  # 0.73 for every two
    pairs, links = sift(rows, HELD)
    assert not links and all(p["a"] % 10 == 3 or p["b"] % 10 == 3 for p in pairs)


def test_wide_fingerprints_at_the_similarity_share_a_key_and_are_near():
    r = np.random.default_rng(4)
    width, blocks, words = simhash.layout(10_000)
    masks = [m for j in range(blocks) for m in covering_masks(simhash.STAGE_RADIUS, list(range(j * width, (j + 1) * width)))]
    found = 0
    for _ in range(1000):
        x = r.integers(0, 1 << 64, 100, np.uint64)
        fps = simhash.wide_fingerprint(x[:90], words) ^ simhash.wide_fingerprint(x[10:], words)  # 80 of 100 are shared
        diff = sum(int(w) << 64 * k for k, w in enumerate(fps))
        found += any(not diff & m for m in masks) and np.bitwise_count(fps[-CHECK_WORDS:]).sum() <= CHECK_RADIUS
    assert found >= 998
    assert width * blocks <= 64 * (words - CHECK_WORDS)


def test_wide_links_join_what_is_near(spark):
    r = np.random.default_rng(6)
    width, blocks, words = simhash.layout(10_000)
    rows = [r.integers(0, 1 << 64, words, np.uint64)]
    for _ in range(99):  # a chain with a few bits flipped at each step
        rows.append(rows[-1] ^ (np.uint64(1) << r.integers(0, 64, words, np.uint64)))
    other = [r.integers(0, 1 << 64, words, np.uint64) for _ in range(200)]
    df = spark.createDataFrame([([signed(int(w)) for w in x],) for x in rows + other], "fp array<long>")
    got = components(simhash.wide_links(df, width, blocks)).collect()
    names = {x["name"] for x in df.limit(100).select(simhash.fp_name().alias("name")).collect()}
    assert {x["node"] for x in got} == names and len({x["root"] for x in got}) == 1


def test_candidates_of_the_stage_are_those_of_simhash(spark, monkeypatch):
    docs = docs_of(spark, [t for _, t in near_copies(9, 4)])
    assert near_dedup(docs).count() < docs.count()
    none = lambda fps, width, blocks: fps.sparkSession.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "wide_links", none)
    assert near_dedup(docs).count() == docs.select("text").distinct().count()
