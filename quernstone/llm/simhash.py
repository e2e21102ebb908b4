"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a vector phi(i) of radius+1 bits, not zero. For each of the
2^(radius+1)-1 vectors v there is a table, whose key is the fingerprint under the mask of the
bits with <v, phi(i)> odd. If two fingerprints differ in at most ``radius`` bits, the phi of
these bits span less than the whole space, so some v is orthogonal to all of them, and in
its table both have the same key: no pair within the radius is missed.

Only distinct fingerprints are dealt out. Buckets of more than ``large`` fingerprints are
dealt out once more, by the same construction on the bits that their mask leaves
free; then at most a quarter of the bits vary inside a bucket, which bounds it for good. A
bucket reports a spanning forest of its links, never all pairs. Components come from
rounds of large-star and small-star steps.

The pipeline's stage asks for a similarity that no workable radius of 64 bits holds, so ``near_dedup``
makes wider fingerprints (of the distinct shingles), deals them out by the covering masks of every
block of their bits, and links what shares a key and is near over the bits that no key uses. Inside the components of
these links, exact shingle similarity verifies each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import BROADCAST_ROWS, fresh, map_arrow, materialize, release, row_hash, sized, small_batches

BITS = 64
WORDS, RADIUS = 3, 3
#: The pipeline's stage: near copies by exact similarity of five-word shingles.
STAGE_WORDS, STAGE_SIMILARITY = 5, 0.8
#: Its tables: covering masks of radius 2 over each block of a fingerprint, so many blocks that a pair at 0.8 shares no key with probability MISS.
STAGE_RADIUS, MISS = 2, 6e-5
#: Bits of a block, if unrelated texts fill a bucket with FULL on average at most. Wider blocks are taken for more texts.
BLOCK_BITS, FULL = 21, 1024
#: Words of a fingerprint after those of the blocks, and the distance over them up to which texts are linked: at 0.8 the mean is 29 of 192 bits, the deviation 5; without likeness 96 and 7.
CHECK_WORDS, CHECK_RADIUS = 3, 56
#: Blocks whose tables come first.
FIRST = 2
#: Places of a MinHash signature, by which the pairs to verify are sifted.
PLACES = 192
#: A group is verified in up to TILES squared parts, of which each holds two shares of about TILE texts or more.
TILE, TILES = 128, 16
SEED = 42
LARGE = 1024
#: Shingles of a bucket that a task holds to verify pairs on the spot, and of a text that comes to it with its set. Other pairs are verified by joins.
HELD, SET_ROWS = 1 << 22, 1 << 14
_LANES = np.uint64(0x0101010101010101)
_XOR, _ODD = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (2, PLACES), np.uint64)
_ODD |= np.uint64(1)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(parts))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)])
    return majority(np.frombuffer(hashes, ">u8").astype(np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes. Eight counters of a byte are added at a time."""
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    rows, value = padded.reshape(-1, 255), 0
    for k in range(8):
        lanes = ((rows >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n).tolist():
            value |= 1 << (8 * byte + k)
    return value


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, keep: dict[str, Column], words: int = WORDS) -> DataFrame:
    """The kept columns and fp LONG (the fingerprint's 64 bits as a signed number)."""
    names = [*keep, "fp"]
    source = docs.select(F.col("text").cast("string").alias("text"), *[c.alias(n) for n, c in keep.items()])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([signed(fingerprint(t, words)) for t in batch.column(0).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[1:], fps], names=names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return map_arrow(source, run, f"{fields}, fp long")


def covering_masks(radius: int, bits: list[int] | None = None) -> list[int]:
    """The masks of all tables over the given bits of a fingerprint (all of them by default)."""
    bits = list(range(BITS)) if bits is None else bits
    n = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if (v & (i % n + 1)).bit_count() & 1) for v in range(1, n + 1)]


def _keyed(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(fp) to (key, fp) for each (table, mask). Tables share a key space: a clash costs a comparison, no error."""
    key = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in masks]
    return fps.select(F.explode(F.array(*key)).alias("key"), "fp")


def _bucket_links(radius: int):
    """From a stream sorted by key: links (a, b), a > b, that join all fingerprints of a bucket within the radius."""

    def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root, a, b = np.arange(len(fps)), [], []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for lo in range(0, len(fps), 512):
            near = np.bitwise_count(fps[lo : lo + 512, None] ^ fps[None, :]) <= radius
            for i, j in np.argwhere(near).tolist():
                if j < lo + i:
                    x, y = find(lo + i), find(j)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(lo + i)
                        b.append(j)
        return fps[a], fps[b]

    def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of whole buckets. Small ones are compared at once, by their distance in the stream."""
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(edge)
        small = np.repeat(size <= 8, size)
        k, f, out = keys[small], fps[small], []
        for lag in range(1, 8):
            if len(k) <= lag:
                break
            at = np.flatnonzero((k[lag:] == k[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= radius))
            out.append((f[at + lag], f[at]))
        out += [forest(np.unique(fps[edge[i] : edge[i + 1]])) for i in np.flatnonzero(size > 8)]
        return tuple(np.concatenate([o[s] for o in out]) if out else np.zeros(0, np.uint64) for s in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = linked(k, f)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            if len(keys) < 50_000:
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            yield from out(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield from out(keys, fps)

    return run


def links(fps: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(a, b) LONG, distinct, a > b: links whose components are those of all pairs within the radius.

    ``fps`` holds distinct fingerprints in a column fp.
    """
    masks = list(enumerate(covering_masks(radius)))
    keyed = _keyed(fps, masks)
    big = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("key"), "buckets")
    n_big = big.count()
    found = keyed
    if n_big:
        found = keyed.join(sized(big, n_big), "key", "left_anti")
        for t, mask in masks:  # the members of large buckets, table by table, on the bits that are free there
            members = _keyed(fps, [(t, mask)]).join(sized(big, n_big), "key", "left_semi")
            free = [b for b in range(BITS) if not mask >> b & 1]
            inner = [(len(masks) * (t + 1) + i, mask | m) for i, m in enumerate(covering_masks(radius, free))]
            found = found.unionByName(_keyed(members, inner))
    small_batches(fps.sparkSession)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = found.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_bucket_links(radius), "a long, b long")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


#: Nodes of a graph with so large a share of its links that they are joined by broadcast are fewer than this.
HUBS = 4096


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the component's smallest node.

    Alternates large-star and small-star steps until nothing moves; the links then form
    stars. Each step is an aggregation, combined before its shuffle, and a join. Few links are joined by broadcast; of many, the nodes with
    more than 1/HUBS of all ends of links, which are fewer than HUBS, so that the links of one node are never one task's.
    """

    def with_least(links: DataFrame, least: DataFrame, ends: int) -> DataFrame:
        if ends <= BROADCAST_ROWS:  # there are no more nodes than ends of links
            return links.join(F.broadcast(least), "a").drop("n")
        most = ends // HUBS
        hubs = least.where(F.col("n") > most)
        others = links.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("n") <= most), "a")
        return links.join(F.broadcast(hubs), "a").unionByName(others).drop("n")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges, "links")
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = with_least(both, least, 2 * now[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large, "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, 2 * now[0]).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct()
        before, edges = edges, materialize(small, "star")
        release(before)
        release(large)
        was, now = now, state(edges)
        if now == was:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): for each distinct fingerprint of rows, the smallest one that it is linked to over any way."""
    fps = materialize(rows.select("fp").distinct(), "fps")
    found = components(links(fps, radius))
    return fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_report(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Needs columns doc_id and text; others are ignored. A null, empty or blank text has
    fingerprint zero and is linked like any other. component_id is the smallest doc_id
    that is reachable over links; null ids don't count, and it is null if there is no other.
    Repeated rows are repeated in the result. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, {"doc_id": F.col("doc_id").cast("long")}, words), "fingerprints")
    group = materialize(near_groups(rows, radius), "groups")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(group, "fp")
    ids = first.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialize(group.join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = STAGE_WORDS) -> tuple[int, np.ndarray]:
    """(hash of the text's words, distinct hashes of its word shingles); (0, none) without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0, np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(parts))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)])
    return xxhash.xxh3_64_intdigest(joined, SEED) or 1, np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """The MinHash signature. Two texts of similarity J have the same value at a place with probability J."""
    least = np.full(PLACES, ~np.uint64(0))
    for lo in range(0, len(found), 128):
        mixed = (found[lo : lo + 128, None] ^ _XOR) * _ODD
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return least


def layout(texts: int, least: float = STAGE_SIMILARITY) -> tuple[int, int, int]:
    """(bits of a block, blocks, words of a fingerprint) for so many texts.

    Two texts of similarity J differ in a bit with probability acos(2J / (1 + J)) / pi. A key of a table is the bits of 4 of 7 parts
    of a block; the probability that any of the seven keys is shared is that of the differing parts, as vectors, not to span the space.
    """
    width = BLOCK_BITS
    while texts > FULL << (4 * width // 7):
        width += 7
    same = 1 - math.acos(2 * least / (1 + least)) / math.pi
    hit = 7 * same ** (4 * width // 7) - 14 * same ** (6 * width // 7) + 8 * same**width
    blocks = 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log(1 - hit))
    return width, blocks, -(-width * blocks // BITS) + CHECK_WORDS


def wide_fingerprint(found: np.ndarray, words: int) -> np.ndarray:
    """SimHash of so many 64-bit words over distinct shingle hashes: in each word, the bits set in over half of the hashes as mixed for it."""
    counts = np.zeros((words, 8, 8), np.int64)
    for lo in range(0, len(found), 16 * 255):
        part = found[lo : lo + 16 * 255]
        mixed = (part ^ _XOR[:words, None]) * _ODD[:words, None]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD[words : 2 * words, None]
        padded = np.zeros((words, -(-len(part) // 255) * 255), np.uint64)
        padded[:, : len(part)] = mixed ^ (mixed >> np.uint64(29))
        rows = padded.reshape(words, -1, 255)
        for k in range(8):
            lanes = ((rows >> np.uint64(k)) & _LANES).sum(axis=2, dtype=np.uint64)
            counts[:, :, k] += lanes.astype("<u8").view(np.uint8).reshape(words, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > len(found), axis=2, bitorder="little").reshape(words, 8).view("<u8")[:, 0]


def sketches(docs: DataFrame, keep: dict[str, Column], fp_words: int, words: int = STAGE_WORDS) -> DataFrame:
    """The kept columns, node LONG (the text's words), n INT (distinct shingles), fp ARRAY<LONG> (the wide fingerprint)."""
    names = [*keep, "node", "n", "fp"]
    source = docs.select(F.col("text").cast("string").alias("text"), *[c.alias(n) for n, c in keep.items()])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, words) for t in batch.column(0).to_pylist()]
        nodes = pa.array([signed(node) for node, _ in found], pa.int64())
        fps = pa.array([wide_fingerprint(s, fp_words).view(np.int64) for _, s in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], nodes, pa.array([len(s) for _, s in found], pa.int32()), fps], names=names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return map_arrow(source, run, f"{fields}, node long, n int, fp array<long>")


def _whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[list[np.ndarray]]:
    """The columns of a stream sorted by its first, in pieces that end with a bucket."""
    parts: list[list[np.ndarray]] = []
    held, due = 0, rows
    for batch in batches:
        parts.append([c.to_numpy() for c in batch.columns])
        held += batch.num_rows
        if held < due:
            continue
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
        if cut:
            yield [c[:cut] for c in columns]
        parts, held = [[c[cut:].copy() for c in columns]], held - cut
        due = max(rows, 2 * held)
    if held:
        yield [np.concatenate(c) for c in zip(*parts, strict=True)]


def _wide_links(radius: int = CHECK_RADIUS, small: int = 32):
    """From a stream (key, root, words of a fingerprint) sorted by key: links (a.., b..) that join all fingerprints of a bucket within the radius, but for those of one root."""

    def apart(f: list[np.ndarray], x, y) -> np.ndarray:
        return sum(np.bitwise_count(w[x] ^ w[y]).astype(np.uint16) for w in f)

    def forest(group: np.ndarray, f: list[np.ndarray]) -> tuple[list[int], list[int]]:
        """A few rows come first, so that a group of near copies is one before all its pairs are looked at."""
        n = len(f[0])
        group, a, b, lo, step = group.copy(), [], [], 0, 1
        while lo < n:
            x = np.arange(lo, min(n, lo + step))[:, None]
            for left in range(lo, n, 4096):
                y = np.arange(left, min(n, left + 4096))[None, :]
                for i, j in np.argwhere((apart(f, x, y) <= radius) & (group[x] != group[y])).tolist():
                    i, j = lo + i, left + j
                    if group[i] != group[j]:
                        group[group == group[j]] = group[i]
                        a.append(i)
                        b.append(j)
            lo, step = lo + step, min(256, 16 * step)
        return a, b

    def linked(keys: np.ndarray, root: np.ndarray, f: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(edge)
        ends = np.repeat(np.where(size <= small, edge[1:], 0), size)
        at, a, b = np.arange(len(keys)), [], []
        for lag in range(1, small):  # small buckets are compared at once, by their distance in the stream
            at = at[at + lag < ends[at]]
            near = at[root[at] != root[at + lag]]
            near = near[apart(f, near, near + lag) <= radius]
            a.append(near)
            b.append(near + lag)
        for k in np.flatnonzero(size > small).tolist():
            x, y = forest(root[edge[k] : edge[k + 1]], [w[edge[k] : edge[k + 1]] for w in f])
            a.append(edge[k] + np.array(x, np.int64))
            b.append(edge[k] + np.array(y, np.int64))
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, root, *f in _whole_buckets(batches):
            a, b = linked(keys, root, [w.view(np.uint64) for w in f])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(w[x]) for x in (a, b) for w in f], names=[f"{side}{k}" for side in "ab" for k in range(len(f))])

    return run


def wide_links(fps: DataFrame, width: int, blocks: int) -> DataFrame:
    """(a, b) LONG, distinct, a > b: links that join what shares a key in any table and is within CHECK_RADIUS over the last words.

    ``fps`` holds distinct fingerprints (ARRAY<LONG>) in a column fp. A fingerprint is named by the hash of its last words (see ``fp_name``).
    The tables of the first FIRST blocks make most groups; the others give only links between two of these, so that a large group does
    not give its links once for each table.
    """
    keys = []
    for mask in (m for j in range(blocks) for m in covering_masks(STAGE_RADIUS, list(range(j * width, (j + 1) * width)))):
        parts = [(w, mask >> BITS * w & ((1 << BITS) - 1)) for w in range(-(-width * blocks // BITS))]
        keys.append(F.xxhash64(F.lit(len(keys)), *[F.get("fp", F.lit(w)).bitwiseAND(F.lit(signed(m))) for w, m in parts if m]))
    names = [f"c{k}" for k in range(CHECK_WORDS)]
    last = [F.element_at("fp", k - CHECK_WORDS).alias(c) for k, c in enumerate(names)]
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{side}{k} long" for side in "ab" for k in range(CHECK_WORDS))
    a, b = (F.xxhash64(*[F.col(f"{side}{k}") for k in range(CHECK_WORDS)]) for side in "ab")

    def wave(rooted: DataFrame, keys: list[Column]) -> DataFrame:
        keyed = rooted.select(F.array(*keys).alias("keys"), "root", *last).select(F.explode("keys").alias("key"), "root", *names)
        found = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_wide_links(), schema)
        return found.select(a.alias("a"), b.alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()

    cut = FIRST * ((2 << STAGE_RADIUS) - 1)
    named = fps.select("fp", fp_name().alias("name"))
    first = materialize(wave(named.withColumnRenamed("name", "root"), keys[:cut]), "first")
    if cut >= len(keys):
        return first
    joined = materialize(components(first), "first_groups")
    rooted = named.join(sized(joined.withColumnRenamed("node", "name"), joined.count()), "name", "left").select("fp", F.coalesce("root", "name").alias("root"))
    return first.unionByName(wave(rooted, keys[cut:]))


def fp_name() -> Column:
    return F.xxhash64(*[F.element_at("fp", k - CHECK_WORDS) for k in range(CHECK_WORDS)])


def shingle_sets(docs: DataFrame, texts: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """(node, shingles ARRAY<LONG>, signature BINARY: the low byte of each value) of the given texts (node, row), each read from one of its rows in docs."""
    rows = docs.select(F.col("text").cast("string").alias("text"), row_hash(docs).alias("row"))
    source = rows.join(sized(texts, texts.count()), "row").select("node", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, words)[1] for t in batch.column(1).to_pylist()]
        low = pa.array([minima(s).astype(np.uint8).tobytes() for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), low], names=["node", "shingles", "signature"])

    return map_arrow(source, run, "node long, shingles array<long>, signature binary").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, least: float = STAGE_SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have at least the Jaccard similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}s"))
    both = F.size(F.array_intersect("as", "bs"))
    # in tenths of a thousandth, so that 4 of 5 is 0.8 however it is rounded
    near = both * 10_000 >= (F.size("as") + F.size("bs") - both) * round(least * 10_000)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")


def _sifted(least: float, held: int = HELD):
    """From a stream (key, node, n, root, signature, shingles) sorted by key: pairs (a, b, sure), a > b, of a bucket's texts of different components.

    Pairs are sifted by their signatures first, which must agree as often as at similarity ``least`` or up to 4.3 standard deviations less.
    Where both shingle sets are there, they decide, and a bucket gives a spanning forest of its links (sure). Other pairs are left to verify:
    those of texts that come without their set, and those of a bucket of more than ``held`` shingles, which drops its sets.
    """
    places, share = PLACES, round(least * 10_000)
    agree = int(np.ceil(places * least - 4.3 * np.sqrt(places * least * (1 - least))))

    def bucket(node: np.ndarray, n: np.ndarray, root: np.ndarray, signature: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = np.array([s is not None for s in sets], bool)
        size = np.array([0 if s is None else len(s) for s in sets], np.int64)
        off, group, codes, mark = np.cumsum(size) - size, root.copy(), None, None
        for i in range(0, len(node), 128):
            for j in range(0, len(node), 1024):
                x, y = slice(i, i + 128), slice(j, j + 1024)
                maybe = (np.minimum(n[x, None], n[None, y]) * 10_000 >= np.maximum(n[x, None], n[None, y]) * share) & (group[x, None] != group[None, y]) & (node[x, None] > node[None, y])
                if maybe.any():
                    maybe &= (signature[x, None] == signature[None, y]).sum(axis=2, dtype=np.int32) >= agree
                both = known[x, None] & known[None, y]
                at = np.nonzero(maybe & ~both)
                a, b, sure = [i + at[0]], [j + at[1]], [np.zeros(len(at[0]), bool)]
                for r in np.flatnonzero((maybe & both).any(axis=1)).tolist():
                    one, others = i + r, j + np.flatnonzero(maybe[r] & both[r])
                    if codes is None:
                        distinct, codes = np.unique(np.concatenate([s for s in sets if s is not None]), return_inverse=True)
                        mark = np.zeros(len(distinct), bool)
                    own = codes[off[one] : off[one] + size[one]]
                    mark[own] = True
                    lens = size[others]
                    begin = np.cumsum(lens) - lens
                    common = np.add.reduceat(mark[codes[np.repeat(off[others] - begin, lens) + np.arange(lens.sum())]], begin, dtype=np.int64)
                    mark[own] = False
                    for other in others[common * 10_000 >= (size[one] + lens - common) * share].tolist():
                        if group[one] != group[other]:
                            group[group == group[other]] = group[one]
                            a.append(np.array([one]))
                            b.append(np.array([other]))
                            sure.append(np.ones(1, bool))
                a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(sure)], names=["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        rows, shingled, due, bare = 0, 0, 50_000, None

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1], [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield from bucket(*(c[a:b] for c in columns[1:]))

        def weight(sets: np.ndarray) -> int:
            return sum(len(s) for s in sets if s is not None)

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(5)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())[:-1]
            sets = np.empty(batch.num_rows, object)
            for k, found in enumerate(np.split(column.flatten().to_numpy(), ends)):
                sets[k] = found
            sets[column.is_null().to_numpy(zero_copy_only=False)] = None
            keys = batch.column(0).to_numpy()
            sets[keys == bare] = None
            signature = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, places)
            parts.append([keys, batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), signature, sets])
            rows, shingled = rows + len(keys), shingled + weight(sets)
            if rows < due and shingled < held:
                continue
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
            yield from out([c[:cut] for c in columns])
            rest = [c[cut:].copy() for c in columns]
            rows, shingled = len(rest[0]), weight(rest[5])
            if shingled >= held:
                bare, shingled = int(rest[0][-1]), 0
                rest[5][:] = None
            parts, due = [rest], max(50_000, 2 * rows)
        if parts:
            yield from out([np.concatenate(c) for c in zip(*parts, strict=True)])

    return run


def similar_links(docs: DataFrame, texts: DataFrame, width: int, blocks: int, words: int = STAGE_WORDS, least: float = STAGE_SIMILARITY) -> DataFrame:
    """(a, b) LONG, a > b: links whose components are those of all similar pairs that fingerprints bring into one group.

    ``texts`` holds distinct texts: node, row, n, fp. Groups are the components of ``wide_links``. Each member of a group is compared with the
    group's smallest first. Of the other pairs of a group only those are left to compare
    whose texts are not in one component yet, so a group of near copies costs no pair for every two. These are verified
    inside a part of the group, so that a large group of texts that are not similar enough sends no pairs around. Texts of more than
    ``SET_ROWS`` shingles and parts of more than ``HELD`` give their likely pairs to a join instead.
    """
    fps = texts.where("n > 0").select("fp").distinct()
    near = materialize(components(wide_links(fps, width, blocks)), "near")
    named = texts.where("n > 0").select("node", "n", "row", fp_name().alias("name"))
    grouped = named.join(sized(near.withColumnRenamed("node", "name"), near.count()), "name", "left").select(F.coalesce("root", "name").alias("group"), "node", "n", "row")
    grouped = materialize(grouped, "grouped")
    shared = materialize(grouped.groupBy("group").agg(F.count("*").alias("m"), F.min("node").alias("lead")).where("m > 1"), "shared")
    members = materialize(grouped.join(sized(shared, shared.count()), "group"), "members")
    sets = materialize(shingle_sets(docs, members.select("node", "row"), words), "shingles")
    stars = materialize(members.where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")), "stars")
    first = materialize(similar(stars, sets, least), "similar")
    found = materialize(components(first), "joined")
    placed = members.join(sized(found, found.count()), "node", "left").select("group", "m", "node", "n", F.coalesce("root", "node").alias("root"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("group")
    # every two shares of a large group are a part of their own
    shares = F.least(F.lit(TILES), F.ceil(F.col("m") / TILE)).cast("int")
    apart = placed.join(mixed, "group", "left_semi").withColumn("shares", shares).withColumn("own", F.pmod(F.xxhash64("node"), "shares").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("shares") - 1), lambda k: (k != F.col("own")) | (F.col("shares") == 1))
    apart = apart.withColumn("other", F.explode(others)).select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "n", "root")
    apart = materialize(apart, "apart")
    short = sets.select("node", "signature", F.when(F.size("shingles") <= SET_ROWS, F.col("shingles")).alias("shingles"))
    whole = apart.join(short, "node").select("key", "node", "n", "root", "signature", "shingles")
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = materialize(whole.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sifted(least), "a long, b long, sure boolean"), "rest")
    first = first.unionByName(rest.where("sure").select("a", "b"))
    open_ = rest.where("NOT sure").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    return first.unionByName(similar(materialize(open_, "open"), sets, least))


def near_dedup(docs: DataFrame, words: int = STAGE_WORDS, least: float = STAGE_SIMILARITY) -> DataFrame:
    """The documents of which each is the first of its group, with the columns of docs.

    Groups are the components of links between texts whose sets of word shingles have a
    Jaccard similarity of at least ``least``; candidates come from SimHash fingerprints under covering masks, and every link is verified.
    The row with the smallest doc_id stays (null is largest; of several such rows the
    one with the smallest hash of all its columns, once). Rows without words are one group.
    """
    width, blocks, fp_words = layout(docs.count(), least)
    rows = materialize(sketches(docs, {"doc_id": F.col("doc_id").cast("long"), "row": row_hash(docs)}, fp_words, words), "sketches")
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    texts = rows.groupBy("node").agg(stays.alias("first"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    texts = materialize(texts, "texts")
    found = components(similar_links(docs, texts, width, blocks, words, least)).select(F.col("node").alias("member"), "root")
    groups = texts.select("node", "first").join(found, F.col("node") == F.col("member"), "left")
    winners = groups.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    key, nth = fresh(docs, "quern_row"), fresh(docs, "quern_nth")
    winners = materialize(winners.select(F.col("first.row").alias(key)), "winners")
    alike = Window.partitionBy(key).orderBy(key)
    kept = docs.withColumn(key, row_hash(docs)).join(winners, key, "left_semi").withColumn(nth, F.row_number().over(alike))
    return kept.where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
