"""Bases of Arrow columns as numpy arrays, for work inside tasks that touches every base."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Two bits of each known base; other letters count as A and have to be told apart by the caller.
CODE = np.zeros(256, np.uint8)
CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
#: The other strand's letter for each byte.
MIRROR = np.arange(256, dtype=np.uint8)
MIRROR[np.frombuffer(b"ACGTURYSWKMBDHVN", np.uint8)] = np.frombuffer(b"TGCAAYRSWMKVHDBN", np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each text starts in them (one place more than texts). Nulls are empty."""
    large = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(large) and data else np.zeros(0, np.uint8), at - at[0]


def blocks(at: np.ndarray, most: int = 1 << 16):
    """Ranges of texts of about ``most`` bytes, so that what is worked out for each base stays small."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


def texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches start .. end of the bytes as a string column."""
    n = end - start
    ends = np.concatenate([[0], np.cumsum(n)])
    taken = data[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken)))


def words_at(code: np.ndarray, k: int) -> np.ndarray:
    """The word of k bases (31 at most) from each place as a number of base 4."""
    word = np.zeros(max(0, len(code) - k + 1), np.int64)
    for i in range(k):
        word = (word << 2) | code[i : i + len(word)]
    return word


def numbers_at(text: np.ndarray, k: int) -> np.ndarray:
    """A number for the k letters from each place of one text, whatever its letters: equal for equal words only."""
    present = np.flatnonzero(np.bincount(text, minlength=256))
    rank = np.zeros(256, np.int64)
    rank[present] = np.arange(len(present))
    letter, m = rank[text], max(0, len(text) - k + 1)
    word, top = letter[:m], len(present)
    for i in range(1, k):
        if top > (1 << 62) // len(present):  # too large to go on: numbered anew
            seen, word = np.unique(word, return_inverse=True)
            top = len(seen)
        word, top = word * len(present) + letter[i : i + m], top * len(present)
    return word
