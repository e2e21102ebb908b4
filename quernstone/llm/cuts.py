"""Words of Arrow batches of texts, cut by classes of bytes, without a Python object a word.

All separators are ASCII, so bytes can be cut where characters would be, in any UTF-8 text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a byte is: part of a word, between two words, or between two pieces.
WORD, BLANK, BREAK = 0, 1, 2
#: Bytes of text that are cut at a time; a longer text is cut by itself.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_classes(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each of the 256 bytes; those not named are parts of words."""
    out = np.full(256, WORD, np.uint8)
    out[list(blanks)] = BLANK
    out[list(breaks)] = BREAK
    return out


class Cut(NamedTuple):
    """All words of some texts in order, A-Z lower-cased; ``row`` and ``piece`` are ascending numbers of their texts and pieces."""

    words: pa.StringArray
    row: np.ndarray
    piece: np.ndarray


def cut(texts: pa.Array, classes: np.ndarray) -> Cut:
    """The words of texts; a null has none. A text's end is the end of a word and of a piece."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    ends -= ends[0] if len(ends) else 0
    kind = classes[raw]
    inside = kind == WORD
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(raw)]
    starts[first] = inside[first]
    at = np.flatnonzero(starts)
    upto = np.cumsum(inside)
    words = np.append(upto[at] - 1, upto[-1] if len(upto) else 0).astype(np.int32)
    row = np.searchsorted(ends, at, "right") - 1
    piece = row + np.cumsum(kind == BREAK)[at]
    return Cut(pa.StringArray.from_buffers(len(at), pa.py_buffer(words), pa.py_buffer(_LOWER[raw[inside]])), row, piece)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[list[pa.Array]]:
    """The columns of rows that hold about ``most`` bytes in a text column, whatever the batches."""
    held: list[list[pa.Array]] = []
    size = 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) + size
        full = np.flatnonzero(np.diff(upto // most, prepend=size // most)) + 1  # behind these rows a slice ends
        for lo, hi in itertools.pairwise([0, *full.tolist(), batch.num_rows]):
            if hi > lo:
                held.append([c.slice(lo, hi - lo) for c in batch.columns])
            if held and hi in full:
                yield [pa.concat_arrays(parts) for parts in zip(*held, strict=True)]
                held = []
        size = int(upto[-1] % most) if len(upto) else size
    if held:
        yield [pa.concat_arrays(parts) for parts in zip(*held, strict=True)]
