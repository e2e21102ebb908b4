"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letters, lower-cased, are cut to words; character n-grams of the words with
their borders are hashed to rows of an embedding table, whose mean goes through a linear
softmax. Both are trained by stochastic gradient descent in numpy, on a bounded
sample of labelled rows. A held-back part of that sample gives the temperature that
calibrates the probabilities and the level below which a prediction is rejected.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import fresh, map_arrow, materialize, sized, small_batches

NGRAMS = (1, 2, 3, 4)
BUCKET_BITS = 16
DIMENSION = 16
#: Bounds of the training sample: about so many rows for each language and in all, and so many characters of each and of all. Of a longer text a slice at a hashed place is learned from.
#: The driver holds the characters and at most four n-grams of six bytes for each: about 230 MB, however many languages and however long the texts.
TRAIN_PER_LANG, TRAIN_ROWS, TRAIN_CHARS, TRAIN_SUM = 800, 12_800, 16_384, 1 << 23
EPOCHS, RATE, BATCH = 8, 2.0, 32
#: A small sample is gone through more often, until it has given so many steps.
MIN_STEPS = 400
#: Of the calibration texts that are predicted rightly, at most this share is rejected; never a probability above MOST_REJECTED.
REJECT_SHARE, MOST_REJECTED = 0.001, 0.5
FOLDS = 5
UNKNOWN = "und"
_SLICE = 1 << 20
_PRIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, words parted and framed by single spaces."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([32], np.where(_letters()[raw], raw, 32), [32])).astype(np.uint32)
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


def features(codes: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Buckets of the n-grams that start in [first, last). An n-gram may begin or end with a word's border, not cross it."""
    last = len(codes) if last is None else last
    found = []
    space = codes == 32
    for n in NGRAMS:
        stop = min(last, len(codes) - n + 1)
        if stop <= first:
            continue
        ok = np.ones(stop - first, bool)
        if n == 1:
            ok = ~space[first:stop]
        for k in range(1, n - 1):
            ok &= ~space[first + k : stop + k]
        if n == 2:
            ok &= ~(space[first:stop] & space[first + 1 : stop + 1])
        h = np.full(stop - first, n * 0x01000193, np.uint32)
        for k in range(n):
            h = (h ^ codes[first + k : stop + k]) * _PRIMES[k]
            h ^= h >> np.uint32(15)
        found.append((h[ok] * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    langs: list[str]
    logits: np.ndarray  # buckets x languages: the embedding table times the softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def raw(self, text: str | None) -> np.ndarray | None:
        """Mean logits over all n-grams of the whole text, in slices of bounded memory; None without letters."""
        if not text or not self.langs:
            return None
        codes = _codes(text)
        if len(codes) <= 2:
            return None
        total, n = np.zeros(len(self.langs)), 0
        for first in range(0, len(codes), _SLICE):
            ids = features(codes, first, first + _SLICE)
            total += self.logits[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, whether it is rejected)."""
        raw = self.raw(text)
        if raw is None:
            return UNKNOWN, 0.0, True
        p = softmax(raw[None, :] / self.temperature)[0]
        best = int(np.argmax(p))
        score = float(min(1.0, max(0.0, p[best])))
        return self.langs[best], score, score < self.reject_below


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], calibrate: list[bool], seed: int = 7) -> LanguageModel:
    """Fits embeddings and softmax on the texts, temperature and rejection level on those with ``calibrate``."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    buckets, n_langs = 1 << BUCKET_BITS, len(langs)
    table = rng.uniform(-1, 1, (buckets, DIMENSION)).astype(np.float32) / DIMENSION
    weights, bias = np.zeros((DIMENSION, n_langs), np.float32), np.zeros(n_langs, np.float32)
    bags, ys = [], []
    for text, label, held in zip(texts, labels, calibrate, strict=True):
        if not held and len(ids := features(_codes(text))):
            at, counts = np.unique(ids, return_counts=True)
            bags.append((at.astype(np.uint16), (counts / len(ids)).astype(np.float32)))
            ys.append(langs.index(label))
    ys = np.array(ys, int)
    batches = max(1, -(-len(bags) // BATCH))
    epochs = max(EPOCHS, -(-MIN_STEPS // batches))
    steps, total = 0, epochs * batches
    for _ in range(epochs if n_langs > 1 else 0):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            ids = np.concatenate([bags[i][0] for i in own])
            part = np.concatenate([bags[i][1] for i in own])
            lengths = [len(bags[i][0]) for i in own]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            mean = np.add.reduceat(table[ids] * part[:, None], starts, axis=0)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(own)), ys[own]] -= 1
            rate = RATE * (1 - steps / total)
            back = error @ weights.T
            weights -= rate * (mean.T @ error) / len(own)
            bias -= 0.1 * rate * error.mean(axis=0)
            grow = -rate * np.repeat(back, lengths, axis=0) * part[:, None]
            np.add.at(table, ids, grow.astype(np.float32))
            steps += 1
    model = LanguageModel(langs, table @ weights, bias)
    held = [(raw, langs.index(y)) for t, y, c in zip(texts, labels, calibrate, strict=True) if c and (raw := model.raw(t)) is not None]
    if held and n_langs > 1:
        raws, truth = np.array([r for r, _ in held]), np.array([y for _, y in held])
        loss = lambda t: -np.log(np.maximum(softmax(raws / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.02, 10, 60), key=loss))
        p = softmax(raws / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        model.reject_below = float(min(MOST_REJECTED, right[int(REJECT_SHARE * len(right))])) if len(right) else 0.0
    return model


def fold() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))


def training_sample(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, most_rows: int = TRAIN_ROWS, most_chars: int = TRAIN_CHARS, most_sum: int = TRAIN_SUM) -> DataFrame:
    """(text, lang, calibrate): about ``per_lang`` labelled rows a language and ``most_rows`` in all, chosen by hash, none of the held-out fold.

    A text gives at most ``most_chars`` characters, fewer where so many rows would give over ``most_sum`` in all.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    n_langs = counts.count()
    each = min(per_lang, most_rows / max(1, n_langs))
    most_chars = max(1, min(most_chars, int(most_sum / max(1, each * n_langs))))
    hashed = F.xxhash64("doc_id", "text")
    chance = (F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)) * F.col("n")
    more = F.greatest(F.length("text") - most_chars, F.lit(0))
    part = F.when(more == 0, F.col("text")).otherwise(F.substring(F.col("text"), (F.pmod(F.shiftright(hashed, 30), more) + 1).cast("int"), F.lit(most_chars)))
    kept = rows.join(sized(counts, n_langs), "lang").where(chance < each)
    return kept.select(part.alias("text"), "lang", (fold() == 1).alias("calibrate"), "doc_id")


def fit(docs: DataFrame, **bounds: int) -> LanguageModel:
    """A model of the labelled rows; one without languages if there are none. Rows are put in order, so fits agree."""
    rows = sorted(tuple(r) for r in training_sample(docs, **bounds).select("text", "lang", "calibrate").collect())
    return train([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected.

    Needs columns doc_id and text; nothing but the text enters a prediction. A text that is
    null, empty or without letters is ``und``, score 0, rejected; so is all text if
    no labelled row was there to learn from. A null doc_id is in the fold of the empty string. Long texts are
    read whole, in slices. Repeated rows give repeated results, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    source = docs.select(F.col("doc_id").cast("long"), (fold() == 0).alias("held_out"), F.col("text").cast("string"))
    return map_arrow(source, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))


def accepted(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents whose language is not rejected, with the columns of docs. The model is fitted on docs unless given.

    Null and empty texts and those without letters are rejected; repeated rows all stay or all go; an empty table stays empty.
    Columns of docs may have any names; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.predict(t)[2] for t in texts], dtype=bool)

    flag = fresh(docs, "quern_known")
    return docs.withColumn(flag, known(F.col("text").cast("string"))).where(F.col(flag)).drop(flag)
