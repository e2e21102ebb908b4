"""Secret scans: patterns for known kinds, and a token-efficiency test for the rest.

Ordinary words are cheap for a byte-pair vocabulary (4 or more characters a token),
random strings are dear (about 2 or less). A maximal run of key characters is a
``random`` finding if its characters per token are below ``ratio``, after digests of known
lengths, UUIDs and identifiers have been excluded. The vocabulary also decides what an identifier is: its
pieces (letters of one case, or capitalised) are themselves cheap. Without digits they may be rare
words, which cost more than common ones and still less than random letters, so a lower ratio holds.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import map_arrow

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters per token: below RATIO a run is dear; below WORD_RATIO its pieces are no words of any language. Random letters of one case have 1.6 to
#: 1.7 on average (at most 1.8 in three of four strings), invented words of 16 letters 2.7 (below 2.0 in one of a hundred).
MIN_RUN, RATIO, WORD_RATIO = 16, 2.4, 1.8

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_DIGIT = re.compile(r"[0-9]")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
#: Letters of a run in one case or capitalised: what may be words of an identifier or path.
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NUMBER = re.compile(r"[0-9]{5}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("quernstone", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known kinds, in code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def known_digest(run: str) -> bool:
    """A digest of a usual length, or a UUID: random to look at, but no secret by itself."""
    return bool(_DIGEST.fullmatch(run) or _UUID.fullmatch(run))


def characters_per_token(run: str, path: str) -> float:
    return len(run) / max(1, len(encoding(path).encode_ordinary(run)))


def made_of_words(run: str, path: str, ratio: float = RATIO, word_ratio: float = WORD_RATIO) -> bool:
    """Pieces of two letters and more, with at most four digits behind one, at ``ratio`` letters a token, or ``word_ratio`` where there are no digits."""
    pieces = _PIECE.findall(run)
    if not pieces or min(map(len, pieces)) < 2 or run.lstrip("+/_=-")[0].isdigit() or _NUMBER.search(run):
        return False
    tokens = sum(len(encoding(path).encode_ordinary(p)) for p in pieces)
    return sum(map(len, pieces)) >= (word_ratio if _DIGIT.search(run) is None else ratio) * tokens


def random_spans(text: str, path: str, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """Runs of key characters that cost many tokens and are not made of words.

    Left out: runs without a letter, digests and UUIDs, runs of fewer than eight different characters (rules, repeated groups), and runs ``made_of_words``: whose
    pieces are all of two letters and more, none behind a leading digit or beside five digits in a row. About three in ten random strings of 20 small letters are taken for words.
    """
    found = []
    for m in _RUN.finditer(text):
        run = m[0]
        if not any(c.isalpha() for c in run) or known_digest(run) or len(set(run)) < 8:
            continue
        if characters_per_token(run, path) < ratio and not made_of_words(run, path, ratio):
            found.append((m.start(), m.end(), "random"))
    return found


def all_spans(text: str, path: str, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    return sorted(base_spans(text) + random_spans(text, path, ratio), key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per row of docs: doc_id and spans ARRAY<STRUCT<start_at INT, end_at INT, kind STRING>>.

    Needs columns doc_id and text; others are ignored. A null or empty text has no
    spans. Spans of different kinds may overlap; those of a kind do not. Positions
    count code points of the whole text; a run is judged whole, whatever its length. Repeated rows give repeated results, an empty
    table none. ``vocabulary`` is the path of a tiktoken rank file on every executor.
    """
    path = vocabulary or default_vocabulary()

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"start_at": a, "end_at": b, "kind": k} for a, b, k in all_spans(t or "", path, ratio)] for t in batch.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("start_at", pa.int32()), ("end_at", pa.int32()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, "doc_id long, spans array<struct<start_at:int,end_at:int,kind:string>>")


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(written([s for s in spans if s[2] != "random"]).encode()).hexdigest()


def secret_report(docs: DataFrame) -> DataFrame:
    """The spans of ``find_secrets`` as counts, a digest of the known kinds and one string."""
    found = find_secrets(docs)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start_at"], s["end_at"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
