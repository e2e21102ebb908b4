"""Benchmark decontamination: SimHash of item-sized windows, with DataFrame operations only.

1. Words are lower-cased (A-Z); five-word shingles are hashed, with repeats.
2. A window has as many shingles as an item. A window that shares no shingle with any
   item of its size has similarity 0, so only windows over a shared shingle are made: the
   shared shingles are found by a join, and the starts they allow are split so that none
   comes twice.
3. A window's SimHash counts the 64 bits of its shingles in 16 longs of four counters each; longer windows in 64 longs.
4. Multi-index: the 64 bits are five blocks. Two fingerprints within ``radius`` bits differ by
   at most radius/5 bits in some block, and the index holds, for each item and block, all
   values that near. So the join on (size, block, value) finds every item within the radius.
   It runs over distinct fingerprints, so that neither a common passage nor the shingles of a window go through it.
5. Candidates within the radius are verified by the exact weighted similarity of the
   shingles: sum of the smaller over sum of the larger of their counts.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import BROADCAST_ROWS, fresh, lowered, materialize, sized, words_of

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 two fingerprints differ in 9.7 bits on average; 19 are 3.2 standard deviations more, and three a block.
RADIUS = 19
#: Distinct shingles of the benchmark that are broadcast at a time. Larger benchmarks take a pass over the documents for each so many.
SEED_ROWS = 5 * BROADCAST_ROWS
#: So many hashes a four-counter long can count.
NARROW = 32_767
BLOCKS, BLOCK_BITS = 5, 13
#: Longs of four 16-bit counters that count the bits of hashes.
COUNTERS = 16
PIECE = 256
_FOURS = 0x0001000100010001


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """ARRAY<LONG> of the hashes of all word shingles; of the whole sequence if it is shorter; empty without words."""
    hashed = F.transform(words_of(lowered(text)), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        last = F.size(h) - words
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(words), *[F.get(h, i + k) for k in range(words)]))
        # not a shingle of five words: the number of words takes part in the hash
        one = F.array(F.aggregate(h, F.xxhash64(F.size(h)), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= words, many).when(F.size(h) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(hashed), of)[0]


def simhash(hashes: Column) -> Column:
    """The bits set in over half the hashes, as a LONG. Sixteen longs count four bits each; over NARROW hashes, part by part, whose counts are added up."""
    zero = lambda width: F.array(*[F.lit(0).cast("long")] * width)
    step = lambda h, k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_FOURS))
    sums = lambda hs: F.aggregate(hs, zero(COUNTERS), lambda a, h: F.array(*[a[k] + step(h, k) for k in range(COUNTERS)]))
    count = lambda a, b: F.shiftrightunsigned(a[b % COUNTERS], COUNTERS * (b // COUNTERS)).bitwiseAND(F.lit(0xFFFF))
    bit = lambda b, n: F.when(n * 2 > F.size(hashes), F.lit(_signed(1 << b))).otherwise(F.lit(0).cast("long"))
    narrow = _let(sums(hashes), lambda a: reduce(Column.bitwiseOR, [bit(b, count(a, b)) for b in range(64)]))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(NARROW)), lambda first: sums(F.slice(hashes, first, NARROW)))
    totals = F.aggregate(parts, zero(64), lambda all_, a: F.array(*[all_[b] + count(a, b) for b in range(64)]))
    wide = _let(totals, lambda all_: reduce(Column.bitwiseOR, [bit(b, all_[b]) for b in range(64)]))
    return F.when(F.size(hashes) <= NARROW, narrow).otherwise(wide)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _block(fp: Column, b: int) -> Column:
    """Bits of block b; the last block is shorter."""
    return F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def block_bits(b: int) -> int:
    return min(BLOCK_BITS, 64 - BLOCK_BITS * b)


def near_values(distance: int, bits: int) -> list[int]:
    """All patterns of at most so many bits."""
    return [sum(1 << b for b in c) for k in range(distance + 1) for c in itertools.combinations(range(bits), k)]


def slots_an_item(radius: int) -> int:
    return sum(len(near_values(radius // BLOCKS, block_bits(b))) for b in range(BLOCKS))


def benchmark_items(items: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, m, item, item_fp): shingle hashes, their number and fingerprint, of items with words."""
    rows = items.select(F.col("item_id").cast("long"), shingle_hashes(F.col("text"), words).alias("item")).distinct()
    return rows.where(F.size("item") > 0).select("item_id", F.size("item").alias("m"), "item", simhash(F.col("item")).alias("item_fp"))


def item_index(items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(slot, m, item_fp): a row for each size and fingerprint of items, block and value within radius/5 bits of the item's. A slot is size, block and value."""

    def slots_of(b: int) -> Column:
        flips = F.array(*map(F.lit, near_values(radius // BLOCKS, block_bits(b))))
        return F.transform(flips, lambda x: _slot(F.col("m"), b, _block(F.col("item_fp"), b).bitwiseXOR(x.cast("long"))))

    slots = [slots_of(b) for b in range(BLOCKS)]
    return items.select("m", "item_fp", F.explode(F.concat(*slots)).alias("slot"))


def _slot(m: Column, block: int, value: Column) -> Column:
    return m.cast("long") * (BLOCKS << BLOCK_BITS) + F.lit(block << BLOCK_BITS) + value


def near_fingerprints(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(m, fp, item_fp, distance): all pairs within the radius of distinct (m, fp) and distinct (m, item_fp). Each pair meets in a slot; it is a row once."""
    slots = F.array(*[_slot(F.col("m"), b, _block(F.col("fp"), b)) for b in range(BLOCKS)])
    index = sized(item_index(items, radius).drop("m"), items.count() * slots_an_item(radius), 5 * BROADCAST_ROWS)
    near = windows.select("m", "fp", F.explode(slots).alias("slot")).join(index, "slot")
    return near.select("m", "fp", "item_fp", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")).where(F.col("distance") <= radius).distinct()


def _let(x: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.transform(F.array(x), fn)[0]


def _shared(a: Column, b: Column, levels: int = 4) -> Column:
    """Size of the intersection of two sorted arrays as multisets: that of their sets, and that of what each repeats."""
    distinct = F.size(F.array_intersect(a, b))
    repeated = lambda s: F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))
    if not levels:
        count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
        return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    more = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), _shared(x, y, levels - 1)).otherwise(F.lit(0))
    return distinct + _let(repeated(a), lambda x: _let(repeated(b), lambda y: more(x, y)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets. Only values that come more than four times in both are counted one by one."""
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) & (F.size(F.array_distinct(b)) < F.size(b))
    multiset = _let(F.array_sort(a), lambda x: _let(F.array_sort(b), lambda y: _shared(x, y)))
    both = F.when(repeats, multiset).otherwise(F.size(F.array_intersect(a, b)))  # where one side repeats nothing, sets do
    return _let(both, lambda n: n / (F.size(a) + F.size(b) - n))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))


def find_leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per contaminated document and item: doc_id, text_key, item_id, similarity, distance, start (first word), n_words.

    docs needs doc_id and text, items needs item_id and text; other columns are ignored. Null,
    empty and blank texts match nothing. A text of fewer than ``words`` words is one
    shingle, its whole sequence, so it matches only an equal whole text. A document that is
    shorter than an item is one window. Of several windows the most similar is
    reported, then the first. Repeated rows of docs give one row; an item id that comes
    with several texts is reported once, for the best; a null id is an id like others. Empty tables give no rows. Texts and items may be of any length.
    """
    items = materialize(benchmark_items(items, words), "items")
    seeds_of = materialize(items.select(F.explode("item").alias("h"), "m").distinct(), "seeds")
    n_items, n_seeds = items.count(), seeds_of.count()
    base = _documents(docs)
    shingled = base.select("doc_id", "text_key", shingle_hashes(F.col("text"), words).alias("s"))
    at = shingled.select("doc_id", "text_key", F.size("s").alias("n"), F.posexplode("s").alias("pos", "h"))
    key = ["doc_id", "text_key", "m"]
    passes = max(1, -(-n_seeds // SEED_ROWS))
    hits = [at.join(F.broadcast(seeds_of.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == i)), "h") for i in range(passes)]  # SEED_ROWS of them, or about
    seeds = materialize(reduce(DataFrame.unionByName, hits).select(*key, "n", "pos").distinct(), "shared")
    # windows of m shingles over a shared one; those that the shared shingle before has made already are left out
    before = F.lag("pos").over(Window.partitionBy(*key).orderBy("pos"))
    spans = seeds.withColumn("lo", F.greatest(F.lit(0), F.col("pos") - F.col("m") + 1, F.coalesce(before + 1, F.lit(0))))
    spans = spans.withColumn("hi", F.greatest(F.lit(0), F.least("pos", F.col("n") - F.col("m")))).where("lo <= hi")
    # spans that touch become pieces of about PIECE starts, so that what a row holds does not grow with the text
    place = Window.partitionBy(*key).orderBy("lo")
    spans = spans.withColumn("island", F.sum(F.when(F.col("lo") == F.lag("hi").over(place) + 1, 0).otherwise(1)).over(place))
    spans = spans.groupBy(*key, "island", F.floor(F.col("lo") / PIECE)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = materialize(spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("m", "lo", "hi")).alias("pieces")), "spans")
    n_docs = spans.count()
    found = base.where(F.col("text").isNotNull()).join(
        sized(spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "pieces"), n_docs * 16), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    )
    found = found.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("pieces").alias("pieces"))
    cut = lambda z: F.struct(z["m"].alias("m"), z["lo"].alias("lo"), z["hi"].alias("hi"), F.slice(F.col("s"), z["lo"] + 1, z["hi"] - z["lo"] + z["m"]).alias("part"))
    pieces = found.select("doc_id", "text_key", "pieces", shingle_hashes(F.col("text"), words).alias("s"))
    pieces = materialize(pieces.select("doc_id", "text_key", F.explode(F.transform("pieces", cut)).alias("p")).select("doc_id", "text_key", "p.*"), "pieces")
    window = lambda start: F.slice("part", start - F.col("lo") + 1, F.col("m"))
    starts = pieces.withColumn("start", F.explode(F.sequence("lo", "hi")))
    windows = materialize(starts.select("doc_id", "text_key", "m", "lo", "start", simhash(window(F.col("start"))).alias("fp")), "windows")
    pairs = materialize(near_fingerprints(windows.select("m", "fp").distinct(), items.select("m", "item_fp").distinct(), radius), "pairs")
    near = windows.join(sized(pairs, pairs.count()), ["m", "fp"]).drop("fp")
    # only windows near an item go back to their piece for their shingles
    at = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("text_key") == F.col("k"), F.col("m") == F.col("size"), F.col("lo") == F.col("from")]
    near = near.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("m").alias("size"), F.col("lo").alias("from"), "start", "item_fp", "distance")
    near = pieces.join(near, reduce(Column.__and__, at)).select("doc_id", "text_key", "m", "start", "item_fp", "distance", window(F.col("start")).alias("window"))
    of_item = items.select("item_id", F.col("m").alias("items_m"), F.col("item_fp").alias("f"), "item")
    checked = near.join(sized(of_item, n_items), (F.col("m") == F.col("items_m")) & (F.col("item_fp") == F.col("f")))
    checked = checked.withColumn("similarity", similarity(F.col("window"), F.col("item"))).where(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("distance")).alias("near"), F.size("window").alias("size")))
    return checked.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best")).select(
        "doc_id", "text_key", "item_id", "best.similarity", (-F.col("best.near")).alias("distance"), (-F.col("best.back")).alias("start"), (F.col("best.size") + words - 1).alias("n_words")
    )


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return find_leaks(docs, items).drop("text_key")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item (see ``find_leaks``), with the columns of docs.

    Null, empty and blank texts stay, and so do repeated rows, once for each; rows of one doc_id with several texts are judged
    one by one. An empty benchmark removes nothing. Columns of docs may have any names.
    """
    leaks = materialize(find_leaks(docs, items, **options).select("doc_id", "text_key").distinct(), "leaks")
    n, key = leaks.count(), fresh(docs, "quern_text")
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    gone = sized(leaks.select(F.col("doc_id").alias(f"{key}_id"), F.col("text_key").alias(f"{key}_key")), n)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{key}_id")) & (F.col(key) == F.col(f"{key}_key"))
    return rows.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
