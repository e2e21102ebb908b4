import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quernstone.llm import collocations
from quernstone.llm.collocations import CLASSES, collocations as mine
from quernstone.llm.cuts import byte_classes, cut, slices
from tests.llm.helpers import DOCS, docs_of


def brute(rows, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            if len(g) == 2 and any(100 * b >= percent * a for h, b in cand.items() if len(h) == 3 and g in (h[:2], h[1:])):
                continue
            cuts = [(1000000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def check(df, **options):
    got = sorted(tuple(r) for r in mine(df, **options).collect())
    assert got == brute(df.collect(), **{k: v for k, v in options.items() if k != "bucket_words"})
    return got


def texts_of(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "of", "new", "york", "city", "é", "naïve", "x_1", *[f"w{i}" for i in range(60)]]
    p = 1 / (1 + np.arange(len(vocabulary)))
    out = []
    for _ in range(n):
        words = rng.choice(vocabulary, size=int(rng.integers(0, 60)), p=p / p.sum())
        out.append("".join(w + str(rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n"])) for w in words))
    return [*out, None, "", " ,.;", "new york city " * 30, "a a a a a a a a a a a a a a", "b a b a b a b a b a b a b a b a b a b a b a"]


def test_against_brute_force_whatever_the_buckets(spark):
    df = docs_of(spark, texts_of(200)).repartition(5)
    assert len(check(df)) > 50
    check(df, bucket_words=300)  # most pivots are dealt by n-gram
    check(df, bucket_words=8, least=3, percent=90, top=40)


def test_languages_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(i, t, [None, "und", "en", "a\nb"][i % 4], "s", 1) for i, t in enumerate(texts_of(150, 9))]
    df = spark.createDataFrame([*rows, *rows[:40]], DOCS).withColumnRenamed("n_chars", "phrase").withColumnRenamed("source", "Score")
    got = check(df)
    assert {g[0] for g in got} == {"und", "en", "a\nb"}
    assert mine(df.limit(0)).count() == 0 and mine(df.where("text = ''")).count() == 0


def test_long_text_and_slices(spark, monkeypatch):
    long = " ".join(texts_of(3000, 11)[:3000])
    check(docs_of(spark, [long, *texts_of(30, 12)]))
    batch = pa.record_batch([pa.array(["a"] * 7), pa.array(["12345", None, "123", "1234567890123", "", "1", "22"])], names=["l", "t"])
    parts = [[len(x) for x in s] for s in slices(iter([batch, batch.slice(0, 0), batch]), 1, 6)]
    assert all(parts) and sum(p[1] for p in parts) == 14
    whole = [t for s in slices(iter([batch, batch]), 1, 6) for t in s[1].to_pylist()]
    assert whole == batch.column(1).to_pylist() * 2


def test_cut():
    got = cut(pa.array(["Ab c, D", None, "", "ÄB!x", " ", "y"]).slice(0, 6), CLASSES)
    assert got.words.to_pylist() == ["ab", "c", "d", "Äb", "x", "y"] and got.row.tolist() == [0, 0, 0, 3, 3, 5]
    assert np.diff(got.piece).tolist() == [0, 1, 3, 1, 2]
    assert cut(pa.array(["ab", "cd"]).slice(1), byte_classes(b" ")).words.to_pylist() == ["cd"]
    assert cut(pa.array([], pa.string()), CLASSES).words.to_pylist() == []


def test_exact_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 2, 4_000_000_000_000_000), ("en", "a b c", 3, 3_999_999_999_999_999)], "lang string, phrase string, words int, a long")
    words = spark.createDataFrame([("en", "a", 4_000_000_000_000_001), ("en", "b", 4_000_000_000_000_003), ("en", "c", 4_000_000_000_000_000)], "lang string, word string, f long")
    phrases = phrases.union(spark.createDataFrame([("en", "b c", 2, 4_000_000_000_000_000)], phrases.schema))
    got = {r["phrase"]: r["score"] for r in collocations.scored(phrases, words, 10**16).collect()}
    assert got["a b"] == 1000000 * 4_000_000_000_000_000**2 // (4_000_000_000_000_001 * 4_000_000_000_000_003)
    assert got["a b c"] == 1000000 * 3_999_999_999_999_999**2 // (4_000_000_000_000_001 * 4_000_000_000_000_000)
