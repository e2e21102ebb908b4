"""Models and services behind protocols, each with a deterministic offline default."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Protocol, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T

R = TypeVar("R")
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


class Embedder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class SparseEncoder(Protocol):
    def weights(self, text: Column) -> Column: ...


class Reranker(Protocol):
    """One with ``features`` of a text and a ``share`` of two texts' features as well has the features made once a text, not once a pair."""

    def relevance(self, query: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def answer(self, question: str, context: str, images: list[str]) -> str: ...


class Judge(Protocol):
    def score(self, metric: str, question: str, answer: str, contexts: list[str], reference: str) -> float: ...


class PdfParser(Protocol):
    def parse(self, path: str) -> list[dict]: ...


class PageFetcher(Protocol):
    def pages(self, config: DataFrame) -> DataFrame: ...


class HashedEmbedder:
    """Bag of hashed terms, scaled to length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dimension
            for term in re.findall(T.TERM.replace(r"\p{L}\p{N}_", r"\w"), text.lower()):
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")
                vector[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in vector)) or 1.0
            out.append([x / size for x in vector])
        return out


def embed_query(embedder: Embedder, query: str) -> list[float]:
    """Fails for a blank query and for a vector of another size."""
    if not query.strip():
        raise ValueError("the query is blank")
    vectors = embedder.encode([query])
    if len(vectors) != 1 or len(vectors[0]) != embedder.dimension:
        raise ValueError("the encoder returned another number or size of vectors")
    return vectors[0]


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector") -> DataFrame:
    """rows with vectors, encoded in Arrow batches; number and size of the vectors are checked."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        vectors = embedder.encode(texts.fillna("").tolist())
        if len(vectors) != len(texts) or any(len(v) != embedder.dimension for v in vectors):
            raise ValueError("the encoder returned another number or size of vectors")
        return pd.Series(vectors)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return rows.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(text)))


class OverlapReranker:
    """Share of common terms."""

    def relevance(self, query: Column, text: Column) -> Column:
        return self.share(self.features(query), self.features(text))

    def features(self, text: Column) -> Column:
        return T.lexical_terms(text)

    def share(self, query: Column, text: Column) -> Column:
        return T.term_overlap(query, text)


#: Fixed value: images that go to a generator.
IMAGES_MAX = 8


class ExtractiveGenerator:
    """Answers with the first line of each numbered block."""

    def answer(self, question: str, context: str, images: list[str]) -> str:
        lines = [m[0] for m in re.finditer(r"^\[\d+\].*$", context, re.MULTILINE)]
        return "\n".join([question, *lines, *(f"image: {i}" for i in images[:IMAGES_MAX])])


class OverlapJudge:
    """Scores every metric by common terms of two of its texts."""

    def score(self, metric: str, question: str, answer: str, contexts: list[str], reference: str) -> float:
        terms = lambda t: set(re.findall(r"\w[\w-]+\w", t.lower()))
        joined = " ".join(contexts)
        a, b = {"faithfulness": (answer, joined), "answer_relevancy": (answer, question), "context_precision": (joined, reference), "context_recall": (reference, joined)}[metric]
        x, y = terms(a), terms(b)
        return len(x & y) / max(1, min(len(x), len(y)))


# ---- calls to services that limit their rate


class Fault(Enum):
    """Why a call failed. The order decides where an error says several things."""

    REFUSED = "the key is no good"
    RATE = "too many calls"
    PASSING = "trouble that passes"
    OTHER = "anything else"


#: What errors of each kind say, in any letter case, and how a service asks to wait.
FAULT_WORDS = {
    Fault.REFUSED: ("401", "UNAUTHENTICATED", "ACCESS_TOKEN_TYPE_UNSUPPORTED", "API_KEY_INVALID", "invalid authentication", "invalid api key"),
    Fault.RATE: ("429", "RESOURCE_EXHAUSTED", "quota exceeded", "rate limit"),
    Fault.PASSING: ("timeout", "timed out", "connection is closed", "connection reset", "temporarily unavailable", "503"),
}
DELAY_PATTERNS = (r"retry(?:Delay| delay)?['\"]?\s*[:=]\s*['\"]?(\d+(?:\.\d+)?)s", r"retry in (\d+(?:\.\d+)?)")

_FAULTS = {fault: re.compile("|".join(map(re.escape, words)), re.IGNORECASE) for fault, words in FAULT_WORDS.items()}


@dataclass(frozen=True)
class RetryPolicy:
    """How often a call is repeated, and after what pause. An error is classified once.

    Calls that failed for their rate or in passing are repeated; a refused key never is, whatever else the error says.
    """

    most: int
    fallback: float = 65.0
    sleep: Callable[[float], None] = time.sleep

    def fault(self, error: Exception) -> Fault:
        said = next((fault for fault, words in _FAULTS.items() if words.search(str(error))), Fault.OTHER)
        return Fault.PASSING if said is Fault.OTHER and isinstance(error, TimeoutError) else said

    def pause(self, error: Exception) -> float | None:
        """Seconds until the next try: two more than the service asks for, else the fallback; None if there is none."""
        if self.fault(error) in (Fault.REFUSED, Fault.OTHER):
            return None
        asked = [float(found[1]) for pattern in DELAY_PATTERNS if (found := re.search(pattern, str(error), re.IGNORECASE))]
        return asked[0] + 2 if asked else self.fallback

    def run(self, call: Callable[[], R]) -> R:
        tries = 0
        while True:
            tries += 1
            try:
                return call()
            except Exception as error:
                pause = self.pause(error)
                if pause is None or tries > self.most:
                    raise
            self.sleep(pause)


@dataclass(frozen=True)
class RetrievalConfig:
    """Limits of a retrieval. The usual and the fast ones."""

    dense_limit: int = 50
    sparse_limit: int = 50
    fused_limit: int = 50
    rerank_limit: int = 8
    children: int = 3
    route_minimum: float = 0.25
    route_margin: float = 0.03
    context_characters: int = 60_000
    sources: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def fast(cls) -> RetrievalConfig:
        return cls(dense_limit=20, sparse_limit=20, fused_limit=20, rerank_limit=5)
