"""Token-id files coded by a static range asymmetric numeral system (rANS).

1. Texts are tokenized once; ids go to an intermediate table.
2. Ids are counted over the whole corpus. The counts, scaled to a power of two, are the
   frequency table that all blocks share; it is at most as large as the vocabulary.
3. Ids are range-partitioned and sorted by doc_id and cut into blocks. A block is coded by
   itself, in ``LANES`` interleaved states of 64 bits that shed 32-bit words. Every
   ``SEGMENT`` ids it keeps a checkpoint: place in the words, the states, and a checksum
   of the ids up to the next, so that a reader can start at any of them.
4. Blocks are rows of a Parquet table, written by Spark's committer: a lost executor or
   a repeated task leaves no half a file behind, on any store. Files are in ascending
   doc_id order, and so are the blocks inside.

Layout of a block (little endian): magic ``QRNS``, version u16, lanes u16, segment u32,
ids u64, words u64; then for each segment u64 place of its first word, u32 crc32 of
its ids, ``lanes`` u64 states; then the u32 words; last a u32 crc32 of all before.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import map_arrow, materialize, new_path, small_batches

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SCALE_BITS = 20
LANES, SEGMENT = 512, 1 << 17
BLOCK_IDS = 1 << 19
#: Pieces that a worker remembers, and bytes of text that it cuts at a time.
CACHED_WORDS, SLICE_BYTES = 1_000_000, 4 << 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHIQQ")
_MAGIC, _VERSION = b"QRNS", 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(path: str) -> str:
    """How ids are kept between the steps: two bytes each where the vocabulary allows it."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


#: The steps of the tokenizers that ``_Words`` knows.
_STEPS = ("NFC", "Replace", "Lowercase", "Split", "ByteLevel")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer normalizes and cuts as ``_Words`` does. Others are given whole texts."""
    made = json.loads(tokenizer(path).to_str())
    steps = [s for part, key in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for s in (made[part] or {}).get(key, [])]
    return tuple(s["type"] for s in steps) == _STEPS and steps[3]["pattern"] == {"Regex": _SPLIT} and not steps[4]["add_prefix_space"]


class _Words:
    """Ids of pieces between white space, over which the tokenizer never joins.

    It lower-cases a piece and cuts it where letters, single digits and marks meet. Pieces of plain Latin letters, digits
    and marks are cut here and each part goes to the library's BPE model, in its byte alphabet; all others (with apostrophes,
    which begin suffixes, what may be a special token, or letters that need normalizing) go through the whole tokenizer.
    All ids lie in one array; a piece is known by its number.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model, self.code = self.tokenizer.model, np.dtype(id_type(path)).char
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = array.array(self.code), array.array("q", [0])

    def add(self, piece: str, ids: list[int]) -> int:
        n = self.numbers[piece] = len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return n

    def learn(self, pieces: list[str]) -> list[int]:
        """The numbers of new pieces."""
        numbers, ids, ends, tokenize, one_part, out = self.numbers, self.ids, self.ends, self.model.tokenize, _PART.fullmatch, []
        for piece in pieces:
            low = piece.lower()
            if one_part(low) is not None:
                n = numbers.get(low)
                if n is None:
                    n = numbers[low] = len(ends) - 1
                    ids.extend([t.id for t in tokenize(low if low.isascii() else low.translate(_BYTE_ALPHABET))])
                    ends.append(len(ids))
                numbers[piece] = n
            elif _PLAIN.fullmatch(low) is not None:
                parts = self.learn(_PART.findall(low))
                n = self.add(piece, [i for m in parts for i in ids[ends[m] : ends[m + 1]]])
            else:
                n = self.add(piece, self.tokenizer.encode(piece, add_special_tokens=False).ids)
            out.append(n)
        return out

    def lookup(self, pieces: list[str]) -> np.ndarray:
        """A number for each of the distinct pieces."""
        if len(self.numbers) + 2 * len(pieces) > CACHED_WORDS:
            self.clear()
        found = list(map(self.numbers.get, pieces))
        new = [i for i, n in enumerate(found) if n is None]
        for i, n in zip(new, self.learn([pieces[i] for i in new]), strict=True):
            found[i] = n
        return np.array(found, np.int64)


_words: dict[str, _Words] = {}
#: Plain pieces hold, in lower case, letters of ASCII and Latin-1, digits and marks: none that normalizing changes but for its case, no apostrophe, no "<".
_MARKS = r"""!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"""
_PLAIN = re.compile(f"[a-z0-9\u00df-\u00f6\u00f8-\u00ff{_MARKS}]+")
_PART = re.compile(f"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[{_MARKS}]+")


def _byte_alphabet() -> dict[int, str]:
    """Each letter from U+00DF on as byte-level vocabularies write its two bytes. They give printable bytes the character of
    the same number, and the others, in order, those from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in printable]
    names = {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(others)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


_BYTE_ALPHABET = _byte_alphabet()


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_MARK[list(b"!\"#$%&()*+,-./:;=?@_")] = True


def _marks_apart(texts: pa.Array) -> pa.Array:
    """Texts with a space between each ASCII letter and a mark behind it. The tokenizer cuts there anyway (not at apostrophes
    and not at the marks of special tokens, which stay), so the ids are the same, and there are fewer different pieces."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    at = np.flatnonzero(_LETTER[raw[:-1]] & _MARK[raw[1:]]) + 1  # a text's last letter before another's mark only gets a space more
    ends = ends - ends[0]
    ends += np.searchsorted(at, ends, "left")
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.insert(raw, at, 32)))


def _token_bytes(texts: pa.Array, words: _Words) -> list[bytes]:
    """The pieces of a few texts are numbered as a dictionary, and their ids gathered in one step."""
    lists = pc.ascii_split_whitespace(_marks_apart(texts))
    coded = lists.flatten().dictionary_encode()
    numbers = words.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
    starts, ends = (np.frombuffer(words.ends, np.int64)[at] for at in (numbers, numbers + 1))
    sizes = ends - starts
    upto = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.frombuffer(words.ids, words.code)[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])] if upto[-1] else np.zeros(0, words.code)
    edges = upto[np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))].tolist()
    return [ids[a:b].tobytes() for a, b in itertools.pairwise(edges)]


def token_bytes(texts: list[str | None] | pa.Array, path: str) -> list[bytes]:
    """Ids of whole texts, without end ids, in the bytes of ``id_type``. Texts are taken about SLICE_BYTES at a time."""
    if not cuts_at_spaces(path):
        encode = tokenizer(path).encode
        return [np.array(encode(t or "", add_special_tokens=False).ids, id_type(path)).tobytes() for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
    words = _words.get(path)
    if words is None:
        words = _words[path] = _Words(path)
    column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
    slices = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(slices, prepend=-1, append=-1)).tolist()
    return [ids for a, b in itertools.pairwise(cuts) for ids in _token_bytes(column.slice(a, b - a), words)]


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 wherever a count is not 0."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError("more symbols than the frequency table has room for")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    left = size - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    while left < 0:  # the largest give, so that all keep 1
        give = np.minimum(freq[order] - 1, np.maximum(1, (freq[order] - 1) // 8))
        give = np.minimum(give, np.maximum(0, -left - (np.cumsum(give) - give)))
        freq[order] -= give
        left += int(give.sum())
    return freq


class Coder:
    """rANS over one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.freq = np.uint64(bits), freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64((1 << bits) - 1)

    def encode(self, ids: np.ndarray, lanes: int = LANES, segment: int = SEGMENT) -> bytes:
        """A whole block. Coding runs backwards; a segment's checkpoint is the state before its ids are read."""
        rows = -(-len(ids) // lanes)
        states = np.full(lanes, _LOW, np.uint64)
        out: list[np.ndarray] = []
        n_words, points = 0, []
        per = segment // lanes
        for row in range(rows - 1, -1, -1):
            part = ids[row * lanes : (row + 1) * lanes]
            x, f = states[: len(part)], self.freq[part]
            full = x >= (f << (np.uint64(63) - self.bits))
            if full.any():
                shed = x[full]
                out.append((shed & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
                n_words += len(shed)
                x[full] = shed >> np.uint64(32)
            q = x // f
            states[: len(part)] = (q << self.bits) + (x - q * f) + self.start[part]
            if row % per == 0:
                points.append((n_words, zlib.crc32(ids[row * lanes : (row + per) * lanes].astype("<u4").tobytes()), states.copy()))
        words = np.concatenate(out)[::-1] if out else np.zeros(0, "<u4")
        heads = [struct.pack("<QI", n_words - at, crc) + s.astype("<u8").tobytes() for at, crc, s in reversed(points)]
        body = _HEAD.pack(_MAGIC, _VERSION, lanes, segment, len(ids), n_words) + b"".join(heads) + words.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    def segments(self, block: bytes) -> int:
        _, _, _, segment, n, _ = _HEAD.unpack_from(block)
        return -(-n // segment)

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the segments [first, last) of a block, all by default. Raises ValueError if a checksum fails."""
        magic, version, lanes, segment, n, n_words = _HEAD.unpack_from(block)
        if magic != _MAGIC or version != _VERSION or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("not a block, or a damaged one")
        count, size = self.segments(block), 12 + 8 * lanes
        words = np.frombuffer(block, "<u4", n_words, _HEAD.size + count * size)
        found = []
        for s in range(first, count if last is None else min(last, count)):
            at, crc = struct.unpack_from("<QI", block, _HEAD.size + s * size)
            states = np.frombuffer(block, "<u8", lanes, _HEAD.size + s * size + 12).astype(np.uint64)
            ids = np.empty(min(segment, n - s * segment), np.uint32)
            for lo in range(0, len(ids), lanes):
                x = states[: min(lanes, len(ids) - lo)]
                slot = x & self.mask
                own = self.symbol[slot]
                ids[lo : lo + len(x)] = own
                x[:] = self.freq[own] * (x >> self.bits) + slot - self.start[own]
                need = np.flatnonzero(x < _LOW)
                if len(need):
                    x[need] = (x[need] << np.uint64(32)) | words[at : at + len(need)]
                    at += len(need)
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError(f"checksum of segment {s} fails")
            found.append(ids)
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


def tokenized(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids BINARY, see ``id_type``): the ids of each whole text and the end id."""
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], id_type(path)).tobytes()

    def encoded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = token_bytes(pa.concat_arrays([b.column(1) for b in held]), path)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0) for b in held]), pa.array([i + end for i in ids], pa.binary())], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(b.nbytes for b in held) + batch.nbytes > SLICE_BYTES:  # many short texts are encoded together
                yield encoded(held)
                held = []
            held.append(batch)
        if held:
            yield encoded(held)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all rows: one row an id and task goes to the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            size = max(len(total), len(own))
            total = np.pad(total, (0, size - len(total))) + np.pad(own, (0, size - len(own)))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    small_batches(tokens.sparkSession)
    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_BLOCKS = "part int, block int, n_ids long, n_null int, doc_ids binary, lengths binary, payload binary"


def _encoder(freq, block_ids: int, kind: str):
    """From rows in doc_id order: blocks of whole documents of about ``block_ids`` ids; a longer document is a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = np.dtype(kind).itemsize
        part, coder = TaskContext.get().partitionId(), Coder(freq.value)
        docs: list[int | None] = []
        held: list[bytes] = []
        size = block = 0

        def out() -> pa.RecordBatch:
            nonlocal size, block
            payload = coder.encode(np.frombuffer(b"".join(held), kind))
            lengths = np.array([len(h) // width for h in held], "<i8").tobytes()
            ids = np.array([d or 0 for d in docs], "<i8").tobytes()  # null ids are the last
            row = [[part], [block], [size], [docs.count(None)], [ids], [lengths], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            docs.clear()
            held.clear()
            size, block = 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["part", "block", "n_ids", "n_null", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and size + len(ids) // width > block_ids:
                    yield out()
                docs.append(doc)
                held.append(ids)
                size += len(ids) // width
        if held:
            yield out()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes blocks to path/blocks and the shared frequency table to path/table.

    Needs columns doc_id and text; others are ignored. A null or empty text is the end id
    alone. Rows are in ascending doc_id order; repeated ids follow each other in the
    order of their ids' bytes, null comes last. An empty table
    has no blocks.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, vocabulary, end_id), "tokens")
    kind = id_type(vocabulary or default_vocabulary())
    id_counts(tokens, kind).repartition(1).write.parquet(f"{path}/table")
    table = read_table(spark, path)
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("ids")]  # many rows of one doc_id may be several tasks' work
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(n, *order[:2])
    blocks = dealt.sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(_encoder(spark.sparkContext.broadcast(table), block_ids, kind), _BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The shared frequency table; it has a row for each id of the vocabulary at most."""
    rows = spark.read.schema("id long, n long").parquet(f"{path}/table").collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return scaled(counts)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids BINARY of u32) of every document in the files, decoded block by block, in parallel."""
    table = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a file
    before = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.select("part", "block", "n_ids").withColumn("at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(before, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("at") + F.col("file_start")).alias("block_start"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        for batch in batches:
            for start, n_null, doc_ids, lengths, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = coder.decode(payload).astype("<u4").tobytes()
                n = np.frombuffer(lengths, "<i8")
                ends = np.cumsum(n)
                docs = np.frombuffer(doc_ids, "<i8").tolist()
                docs[len(docs) - n_null :] = [None] * n_null
                texts = [ids[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - n, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "start", "ids"])

    small_batches(spark)
    placed = blocks.join(starts, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).select("block_start", "n_null", "doc_ids", "lengths", "payload")
    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def token_report(docs: DataFrame) -> DataFrame:
    """Writes the ids of docs, reads them back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path)
    return read_ids(docs.sparkSession, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
