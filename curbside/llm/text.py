"""Whole texts as UTF-8 bytes in Arrow batches: words, lines and hashes with numpy.

Every function works on many texts at once: ``data`` holds their bytes end to
end and ``offsets`` where each begins (one more entry than texts).  A null text
counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Anything but ASCII letters and bytes of longer code points.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Texts that one step works on, at most.
STEP_TEXTS = 2000


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, content = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, and no more
    than ``STEP_TEXTS`` texts, so that the arrays made from a slice stay small."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        number = offsets[:-1] // limit
        full = np.arange(batch.num_rows) // STEP_TEXTS
        fresh = np.flatnonzero(np.diff(number) | np.diff(full)) + 1
        cuts = [0, *fresh.tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(start, end - start)


def words(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and per text the number of its first word
    (with the number of all words at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    fresh = np.empty_like(inside)
    fresh[0] = True
    np.logical_not(inside[:-1], out=fresh[1:])
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.empty_like(inside)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of byte ranges, from prefix sums of a polynomial modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        self.power = np.cumprod(np.full(size, self.BASE, np.uint64))
        back = pow(self.BASE, -1, 1 << 64)
        self.inverse = np.cumprod(np.full(size + 1, back, np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of the polynomial over the bytes."""
        if len(data) > len(self.power):
            self._grow(max(len(data), 2 * len(self.power)))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=total[1:])
        return total

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each range of bytes; equal ranges hash alike wherever they lie."""
        length = (ends - starts).astype(np.uint64)
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + mix(length))


#: Weights of the 1st, 2nd ... word of a run of words.
PLACES = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def runs_of_words(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside one text, and the number of its first
    word."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - k + 1
    total = np.zeros(size, np.uint64)
    for i in range(k):
        total += hashes[i : i + size] * PLACES[i]
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    where = np.flatnonzero(text[:size] == text[k - 1 :])
    return mix(total[where]), where


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])
