"""Phrases of words that stay together, mined by pivot partitioning as in MG-FSM.

1. Words are counted, exactly. Words below the least count can be in no candidate.
2. The order of words by rarity is shared as a sketch of fixed size: two tables of ``CELLS`` cells hold the largest count
   of the frequent words that fall into a cell, and a word's count is estimated by the smaller of its cells. The estimate is never too low, so no
   frequent word is lost; a rare word that shares both cells is mined in vain. Every task orders words alike, by
   estimate, then by hash.
3. The pivot of an n-gram is its rarest word; of several, the first. Each occurrence of a word sends the fragment of text in which it is the pivot
   to its partition: up to two words on either side, cut where a word is rarer, infrequent or in another piece. Fragments of a
   slice of text go as one row for each bucket of pivots, counted once if they are equal.
4. A bucket is mined by itself: all occurrences of the n-grams that its pivots own are there, so their
   counts are whole and only those of the least count and more leave the task.
5. A pivot so frequent that it would outweigh a bucket has its n-grams sent one by one, each
   to the bucket of its own hash. So neither a word nor a pair can make a task large.
6. Scores need the counts of parts, which are joined; words of over 1/4096 of all are at most 4096, and are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import materialize, small_batches
from quernstone.llm.cuts import byte_classes, cut, slices

CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
NO_LANG = "und"
LEAST, INSIDE_PERCENT, TOP = 10, 50, 2000
#: Cells of each of the two tables of the sketch.
CELLS = 1 << 20
#: Words of text for a bucket; a pivot that comes over an eighth as often is dealt by n-gram.
BUCKET_WORDS = 1 << 19
#: Words of over 1/HEAVY of all words are at most so many, by counting.
HEAVY = 4096
#: Parts of a language whose phrases are ranked by themselves first.
SALTS = 32
#: Counted words that a task holds before it adds them up.
_HELD = 1_000_000
#: The n-grams around a pivot in a fragment (two words left, the pivot, two words right): places of their words.
_GRAMS = ((1, 2), (2, 3), (0, 1, 2), (1, 2, 3), (2, 3, 4))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))


def _coded(langs: pa.Array, texts: pa.Array):
    """The distinct (language, word) pairs of some texts as two arrays, the number of each word's pair, and the pieces."""
    found = cut(texts, CLASSES)
    words, lang = found.words.dictionary_encode(), langs.dictionary_encode()
    own = lang.indices.to_numpy()[found.row].astype(np.int64)
    pairs, codes = np.unique(own * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_inverse=True)
    at = np.divmod(pairs, max(1, len(words.dictionary)))
    return lang.dictionary.take(pa.array(at[0])), words.dictionary.take(pa.array(at[1])), codes, found.piece


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "word"], use_threads=False).aggregate([("f", "sum")]).rename_columns(["lang", "word", "f"])

    for langs, texts in slices(batches, 1):
        lang, words, codes, _ = _coded(langs, texts)
        f = np.bincount(codes, minlength=len(words))
        held.append(pa.table({"lang": lang, "word": words, "f": f}))
        if sum(map(len, held)) > _HELD:
            held[:] = [summed()]
            if len(held[0]) > _HELD:
                yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()  # batches of any size: rows are few and short


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): all words; a slice of text sends each once."""
    small_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(_count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _hashes(lang: pa.Array, words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    starts = {x: digest(x) for x in lang.unique().to_pylist()}
    return np.array([digest(w, starts[x]) for x, w in zip(lang.to_pylist(), words.to_pylist(), strict=True)], np.uint64)


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64), (hashes >> np.uint64(32) & np.uint64(CELLS - 1)).astype(np.int64) + CELLS


def sketch(frequent: DataFrame) -> np.ndarray:
    """Two tables of ``CELLS`` cells with the largest count of the words in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for cell in _cells(_hashes(batch.column(0), batch.column(1))):
                np.maximum.at(own, cell, batch.column(2).to_numpy())
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at])], names=["cell", "f"])

    made = frequent.select("lang", "word", "f").mapInArrow(run, "cell int, f long").groupBy("cell").agg(F.max("f").alias("f")).toArrow()
    out = np.zeros(2 * CELLS, np.uint32)
    out[made.column(0).to_numpy()] = np.minimum(made.column(1).to_numpy(), 2**32 - 1)
    return out


def _packed(texts: pa.StringArray) -> bytes:
    """Strings as bytes: their number, their ends, their characters."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.append(len(texts), ends[1:] - ends[0]).astype("<i4").tobytes() + (data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b"")


def _unpacked(raw: bytes) -> pa.StringArray:
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    ends = np.concatenate(([0], np.frombuffer(raw, "<i4", n, 4))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(raw[4 + 4 * n :]))


def _neighbours(codes: np.ndarray, piece: np.ndarray, order: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """For each word the fragment in which it is the pivot: five columns of codes, -1 where it is cut. Words of a smaller order are more frequent;
    of equal words the first is the pivot, so each n-gram is in one fragment."""
    n, pad = len(codes), np.full(2, -1, np.int64)
    ok, own = frequent[codes], order[codes]
    wide, orders = np.concatenate((pad, codes, pad)), np.concatenate((pad, own, pad))
    joined = np.zeros(n + 3, bool)  # whether a word and the next are in one fragment
    joined[2 : n + 1] = (piece[1:] == piece[:-1]) & ok[1:] & ok[:-1]
    left1 = joined[1 : n + 1] & (orders[1 : n + 1] < own)
    left2 = left1 & joined[:n] & (orders[:n] < own)
    right1 = joined[2 : n + 2] & (orders[3 : n + 3] <= own)
    right2 = right1 & joined[3 : n + 3] & (orders[4 : n + 4] <= own)
    out = np.stack([np.where(left2, wide[:n], -1), np.where(left1, wide[1 : n + 1], -1), codes, np.where(right1, wide[3 : n + 3], -1), np.where(right2, wide[4 : n + 4], -1)])
    return out[:, left1 | right1]


def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _fragments(shared, buckets: int, least: int, hot_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for langs, texts in slices(batches, 1):
            lang, words, codes, piece = _coded(langs, texts)
            if not len(codes):
                continue
            hashes = _hashes(lang, words)
            one, two = _cells(hashes)
            estimate = np.minimum(counts[one], counts[two]).astype(np.int64)
            ranked = np.lexsort((hashes, -estimate))
            differs = (np.diff(estimate[ranked], prepend=-1) != 0) | (np.diff(hashes[ranked], prepend=hashes[ranked[:1]]) != 0)
            order = np.empty(len(words), np.int64)
            order[ranked] = np.cumsum(differs)
            parts = _neighbours(codes, piece, order, estimate >= least)
            hot = estimate[parts[2]] > hot_words
            whole = parts[:, ~hot]
            made = [(whole, hashes[whole[2]])]
            for places in _GRAMS:  # each n-gram of a hot pivot is a fragment of its own, in the bucket of all its words
                grams = parts[:, hot & (parts[list(places)] >= 0).all(axis=0)]
                rest = [p for p in range(5) if p not in places]
                grams[rest] = -1
                grams[2] |= np.int64(1) << 40  # bears no other n-gram, see ``_grams_of``
                made.append((grams, _mixed([hashes[grams[p] & ((1 << 40) - 1)] for p in places]) if grams.shape[1] else np.zeros(0, np.uint64)))
            bucket = np.concatenate([h for _, h in made]) % np.uint64(buckets)
            table = pa.table([pa.array(bucket.astype(np.int32)), *map(pa.array, np.concatenate([g for g, _ in made], axis=1))], names=["bucket", *"abcde"])
            table = table.group_by(["bucket", *"abcde"], use_threads=False).aggregate([([], "count_all")])
            bucket, *grams, n = (table.column(c).to_numpy() for c in ("bucket", *"abcde", "count_all"))
            alone = grams[2] >> 40 > 0
            grams[2] = grams[2] & ((1 << 40) - 1)
            by = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
            out: list[list] = [[], [], []]
            keys = pc.binary_join_element_wise(lang, words, "\n")
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = by[lo:hi]
                used, local = np.unique(np.concatenate([g[at] for g in grams]), return_inverse=True)
                blanks = int(used[0] == -1)
                kind = "<u2" if len(used) + 1 - blanks < 1 << 16 else "<u4"
                out[0].append(int(bucket[at[0]]))
                out[1].append(_packed(keys.take(pa.array(used[blanks:]))))
                out[2].append((local + (1 - blanks)).astype(kind).tobytes() + n[at].astype("<u4").tobytes() + alone[at].astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "words", "fragments"])

    return run


def _grams_of(parts: np.ndarray, n: np.ndarray, alone: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For two and three words: the numbers of the words of each n-gram that the pivots own, and how often it comes. A fragment that is one n-gram
    ``alone`` bears only the longest of those that its words make."""
    filled = parts >= 0
    for places in ((0, 1), (2, 3, 4)):
        found, often = [], []
        for which in places:
            at = list(_GRAMS[which])
            bears = filled[at].all(axis=0) & ~(alone & (filled.sum(axis=0) != len(at)))
            found.append(parts[at][:, bears])
            often.append(n[bears])
        grams, often = np.concatenate(found, axis=1), np.concatenate(often)
        if grams.shape[0] == 3:
            pairs, first = np.unique(grams[0] * size + grams[1], return_inverse=True)
            keys, at = np.unique(first * size + grams[2], return_inverse=True)
            pair, last = np.divmod(keys, size)
            words = np.stack([*np.divmod(pairs[pair], size), last]) if len(keys) else np.zeros((3, 0), np.int64)
        else:
            keys, at = np.unique(grams[0] * size + grams[1], return_inverse=True)
            words = np.stack(np.divmod(keys, size))
        yield words, np.bincount(at, often, len(keys)).astype(np.int64)


def _mine(least: int):
    def run(table: pa.Table) -> pa.Table:
        dictionaries, parts, counts, alone = [], [], [], []
        for words, fragments in zip(table.column("words").to_pylist(), table.column("fragments").to_pylist(), strict=True):
            own = _unpacked(words)
            kind = np.dtype("<u2" if len(own) + 1 < 1 << 16 else "<u4")
            n = len(fragments) // (5 * kind.itemsize + 5)
            dictionaries.append(own)
            parts.append(np.frombuffer(fragments, kind, 5 * n).reshape(5, n).astype(np.int64))
            counts.append(np.frombuffer(fragments, "<u4", n, 5 * n * kind.itemsize))
            alone.append(np.frombuffer(fragments, "u1", n, (5 * kind.itemsize + 4) * n) > 0)
        coded = pa.concat_arrays(dictionaries).dictionary_encode()
        upto = np.cumsum([0, *map(len, dictionaries)])
        numbers = coded.indices.to_numpy().astype(np.int64)
        parts = [np.append(-1, numbers[a:b])[p] for p, a, b in zip(parts, upto[:-1], upto[1:], strict=True)]
        keys = coded.dictionary.to_pylist()
        langs, phrases, sizes, often = [], [], [], []
        for words, f in _grams_of(np.concatenate(parts, axis=1), np.concatenate(counts), np.concatenate(alone), len(keys)):
            at = np.flatnonzero(f >= least)
            for ids in words[:, at].T.tolist():
                both = [keys[i].rpartition("\n") for i in ids]
                langs.append(both[0][0])
                phrases.append(" ".join(b[2] for b in both))
            sizes += [len(words)] * len(at)
            often.append(f[at])
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string()), "words": pa.array(sizes, pa.int32()), "a": np.concatenate(often)})

    return run


def phrase_counts(docs: DataFrame, frequent: DataFrame, total: int, least: int = LEAST, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(lang, phrase, words, a): all phrases of two and three words that come ``least`` times and more. ``frequent`` are the words that do, ``total`` is
    the number of all words."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch(frequent))
    small_batches(spark)
    sent = _texts(docs).mapInArrow(_fragments(shared, max(1, -(-total // bucket_words)), least, bucket_words // 8), "bucket int, words binary, fragments binary")
    return sent.groupBy("bucket").applyInArrow(_mine(least), "lang string, phrase string, words int, a long")


def _counts_of(parts: DataFrame, grams: DataFrame, heavy: DataFrame) -> DataFrame:
    """parts with the count ``f`` of their ``gram``, which is in ``grams`` (lang, gram, f) or in the broadcast ``heavy``."""
    known = parts.join(F.broadcast(heavy), ["lang", "gram"])
    others = parts.join(F.broadcast(heavy.drop("f")), ["lang", "gram"], "left_anti")
    return known.unionByName(others.join(grams.join(F.broadcast(heavy.drop("f")), ["lang", "gram"], "left_anti"), ["lang", "gram"]))


def _exact(n: str) -> Column:
    return F.col(n).cast("decimal(16,0)")  # up to 10^16 occurrences; products have 38 digits at most


def scored(phrases: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): each phrase with its weakest cut; words are (lang, word, f)."""
    by_word = words.select("lang", F.col("word").alias("gram"), "f")
    heavy = by_word.where(F.col("f") > total // HEAVY)
    grams = by_word.unionByName(phrases.where("words = 2").select("lang", F.col("phrase").alias("gram"), F.col("a").alias("f")))
    split = F.split("phrase", " ")
    part = lambda k, side, first, size: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.array_join(F.slice(split, first, size), " ").alias("gram"))
    two = F.array(part(1, "l", 1, 1), part(1, "r", 2, 1))
    three = F.array(part(1, "l", 1, 1), part(1, "r", 2, 2), part(2, "l", 1, 2), part(2, "r", 3, 1))
    parts = phrases.select("lang", "phrase", "words", "a", F.explode(F.when(F.col("words") == 2, two).otherwise(three)).alias("part")).select("lang", "phrase", "words", "a", "part.*")
    cuts = _counts_of(parts, grams, heavy).groupBy("lang", "phrase", "words", "a")
    value = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    cuts = cuts.agg(value(1, "l"), value(1, "r"), value(2, "l"), value(2, "r"))
    cuts = cuts.withColumns({f"d_{name}": _exact(name) for name in ("a", "l1", "r1", "l2", "r2")})
    score = lambda k: F.expr(f"(d_a * d_a * cast(1000000 as decimal(7,0))) div (d_l{k} * d_r{k})")
    cuts = cuts.withColumn("s1", score(1)).withColumn("s2", score(2))
    first = F.col("s2").isNull() | (F.col("s1") <= F.col("s2"))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return cuts.select("lang", "phrase", "words", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))


def not_inside(phrases: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """Without phrases that lie in a longer one which comes nearly as often: 100 times its count at least ``percent`` times theirs."""
    split = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(split, 1, 2), " "), F.array_join(F.slice(split, 2, 2), " "))
    outer = phrases.where("words = 3").select("lang", F.col("a").alias("outer_a"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("outer_a").alias("outer_a"))
    gone = F.coalesce(F.col("outer_a").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * percent, F.lit(False))
    return phrases.join(outer, ["lang", "phrase"], "left").where(~(gone & (F.col("words") == 2))).drop("outer_a")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = INSIDE_PERCENT, top: int = TOP, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Needs columns text and lang; others are ignored, whatever their names. Null and empty texts hold no words; a null
    language is ``und``, as is that name itself. Repeated rows count as often as they come. Texts may be of any length. Ties are
    ordered by count, then by the phrase in byte order, so every rank is unique and reruns agree. An empty table, or one
    without candidates, gives no rows.
    """
    counted = materialize(word_counts(docs), "words")
    totals = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where(F.col("f") >= least)
    phrases = materialize(phrase_counts(docs, frequent, total, least, bucket_words), "phrases")
    best = scored(phrases, frequent, total).join(not_inside(phrases, percent).select("lang", "phrase"), ["lang", "phrase"])
    best_first = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # first in parts of a language, so that one task ranks at most SALTS times ``top`` phrases, however many tasks there were
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best_first)
    best = best.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= top).drop("nth")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocation_report(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH pieces AS (
  SELECT lang, id, unnest(range(len(ps))) AS pno, unnest(ps) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)
), ws AS (SELECT lang, id, pno, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws), (SELECT unnest([1, 2, 3]) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL
), n AS (SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[1 : c], ' ') AS p1, array_to_string(w[c + 1 :], ' ') AS p2 FROM cand, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scored AS (
  SELECT q.lang, q.phrase, q.a, q.k, q.c, x.a AS l, y.a AS r, ((1000000::HUGEINT * q.a * q.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts q JOIN grams x ON x.lang = q.lang AND x.phrase = q.p1 AND x.k = q.c JOIN grams y ON y.lang = q.lang AND y.phrase = q.p2 AND y.k = q.k - q.c
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, p, max(a) AS outer_a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p FROM cand WHERE k = 3) GROUP BY lang, p
), kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.p = b.phrase AND b.k = 2 WHERE i.outer_a IS NULL OR 100 * i.outer_a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
