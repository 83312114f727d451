"""Vectorised words of many texts at once: numpy over the bytes of an Arrow string column.

A batch is cut into pieces of bounded size at text borders; a text is never cut. All positions of
words are found with array operations on the piece's bytes, and every word gets a 64-bit value
from the bytes it consists of, so later steps handle numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from chromloom.llm.common import KERNEL_BYTES

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: One random value a byte, drawn with a fixed seed.
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_BASE = 0x5851F42D4C957F2D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for words of letters and digits: all ASCII but 0-9, A-Z and a-z.
_MARKS = np.ones(256, bool)
_MARKS[128:] = False
_MARKS[48:58] = _MARKS[65:91] = _MARKS[97:123] = False


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown as longer pieces come."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * KERNEL_BYTES)
            self.up = _geometric(_BASE, size)
            self.down = _geometric(pow(_BASE, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()


def byte_pieces(texts: pa.Array, most: int = KERNEL_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of texts of up to ``most`` bytes (one text at
    least); a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(wide)
    if not n:
        return
    offsets = np.frombuffer(wide.buffers()[1], np.int64, n + 1, wide.offset * 8)
    data = wide.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, flat[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_values(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(value, text, start, end)`` of every word of a piece, in order; A-Z count as a-z.

    Words end at blanks and control spaces, or with ``letters_only`` at every ASCII character
    but letters and digits. A text's end ends its last word.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    gap = (_MARKS if letters_only else _SPACE)[data]
    inside = ~gap
    begins = inside.copy()
    begins[1:] &= gap[:-1]
    border = offsets[1:-1]
    border = border[border < len(data)]
    begins[border] = inside[border]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= gap[1:]
    ends[border[border > 0] - 1] = inside[border[border > 0] - 1]
    end = np.flatnonzero(ends) + 1
    up, down = _POWERS.upto(len(data) + 1)
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE_VALUE[_LOWER[data]] * up[: len(data)], out=run[1:])
    value = mix64((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * _U(0x2545F4914F6CDD1D))
    return value, np.searchsorted(offsets, start, "right") - 1, start, end


def by_text(text: np.ndarray, n_texts: int) -> np.ndarray:
    """Borders of each text's words in arrays ordered by text."""
    return np.searchsorted(text, np.arange(n_texts + 1))
