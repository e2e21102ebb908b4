import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import token_output
from quernstone.llm.token_output import Coder, cuts_at_spaces, default_vocabulary, id_type, read_ids, scaled, token_bytes, token_report, tokenizer, write_ids
from tests.llm.helpers import DOCS, docs_of

PATH = default_vocabulary()
TEXTS = [
    None, "", " \n", "Hello, World's étude x y \x1c\x1d z", "it's we'll <|endoftext|> a<|startoftext|>b  ΣΑΣ Σ ΑΣ. İ", "́start ̸= x\t̀y",
    "日本語 テスト\r\n123 4567 --- *** 😀😀", "word " * 100_000, "a" * 3000,
]


def plain(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_tokenizers_ids():
    r = random.Random(3)
    alphabet = "ab'sZé́ \t\n.,1<|>Σß \u0085　İ"
    more = "aB's.,*|<>é́\u0345\u00a8’ \n0_-@ßΣ"
    for t in ["".join(r.choices(more, k=r.randint(1, 14))) for _ in range(3000)] + ["It's. DON'T!! x'S, <|ENDOFTEXT|> <|endoftext|>. a<|endoftext|>*** ***. ~a~ b&&& &&&"]:
        assert np.frombuffer(token_bytes([t], PATH)[0], id_type(PATH)).tolist() == plain(t), repr(t)
    plain_more = "abzABéßÿÉ÷×µ.,!'<|^\\]-7 "
    for t in ["".join(r.choices(plain_more, k=r.randint(1, 9))) for _ in range(5000)] + ["H\u0331i T\u0308 w\u030a W\u030a", "".join(map(chr, range(0x20, 0x250))), "\u037e K \u212b"]:
        assert np.frombuffer(token_bytes([t], PATH)[0], id_type(PATH)).tolist() == plain(t), repr(t)
    for t in TEXTS + ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(2000)]:
        assert np.frombuffer(token_bytes([t], PATH)[0], id_type(PATH)).tolist() == plain(t), repr(t)


def test_coder_round_trip():
    r = np.random.default_rng(0)
    for n, size in ((0, 5), (1, 1), (511, 3), (512, 50), (513, 4000), (300_000, 49_408)):
        ids = np.minimum(r.geometric(0.01, n) - 1, size - 1).astype(np.uint32)
        coder = Coder(scaled(np.bincount(ids, minlength=size)))
        for lanes, segment in ((512, 1 << 17), (64, 1024), (1, 4)) if n < 1000 else ((512, 1 << 15),):
            block = coder.encode(ids, lanes, segment)
            assert (coder.decode(block) == ids).all()
            k = coder.segments(block)
            if k > 1:
                assert (coder.decode(block, k - 1) == ids[(k - 1) * segment :]).all() and (coder.decode(block, 0, 1) == ids[:segment]).all()
    assert len(block) < 1.3 * n  # geometric ids: about 8 bits each
    for at in (40, len(block) // 2, len(block) - 2):
        damaged = bytearray(block)
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(damaged))


def test_scaled_tables():
    r = np.random.default_rng(1)
    for counts in (np.array([1]), np.array([0, 5, 0, 1]), r.integers(0, 3, 40_000), np.r_[10**12, np.ones(49_000, np.int64)]):
        freq = scaled(counts)
        assert freq.sum() == 1 << 20 and ((freq > 0) == (counts > 0)).all()
    assert scaled(np.zeros(4, np.int64)).sum() == 0


def brute(rows):
    out, start = [], 0
    for i, t in rows:
        ids = np.array([*plain(t), 1], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_report_equals_direct_encoding(spark):
    r = random.Random(8)
    texts = TEXTS + ["".join(r.choices("abcdef ghi", k=r.randint(0, 400))) for _ in range(300)]
    order = r.sample(range(len(texts)), len(texts))
    df = spark.createDataFrame([(i, texts[i], None, None, None) for i in order], DOCS).repartition(5).withColumns({"ids": F.lit(1), "start": F.lit("x")})
    assert sorted(tuple(x) for x in token_report(df).collect()) == brute(enumerate(texts))


def test_edges(spark, tmp_path):
    assert token_report(docs_of(spark, [])).count() == 0
    df = spark.createDataFrame([(7, "b", None, None, None), (None, "c", None, None, None), (7, "b", None, None, None), (3, None, None, None, None), (2**63 - 1, "d", None, None, None)], DOCS)
    write_ids(df, f"file://{tmp_path}/ids", block_ids=1)
    got = sorted((tuple(x) for x in read_ids(spark, f"file://{tmp_path}/ids").select("doc_id", "start", F.crc32("ids")).collect()), key=lambda x: x[1])
    assert got == [(a, b, d) for a, b, _, d in brute([(3, None), (7, "b"), (7, "b"), (2**63 - 1, "d"), (None, "c")])]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert cuts_at_spaces(PATH) and not cuts_at_spaces(path)
    text = "Hello  world's\tend "
    assert np.frombuffer(token_bytes([text, None], path)[0], id_type(path)).tolist() == tokenizer(path).encode(text, add_special_tokens=False).ids


def test_a_full_memory_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_output, "CACHED_WORDS", 50)
    monkeypatch.setattr(token_output, "SLICE_BYTES", 64)
    texts = [" ".join(f"word{i}x{k}, Other" for k in range(20)) for i in range(30)] + [None, ""]
    assert [np.frombuffer(b, id_type(PATH)).tolist() for b in token_bytes(texts, PATH)] == [plain(t) for t in texts]
