"""Stretches of words that repeat with a period, as loops of a crawler or a model
leave them.

A run is a stretch of consecutive words of smallest period ``q`` (words ``q``
apart are equal), at least ``max(LEAST, 2 * q)`` words long, that neither
neighbouring word extends.

Method.  The suffix automaton of the words has the tree of suffix links; on it a
link-cut forest keeps, as preferred paths, the states whose strings ended last at
the same word.  Appending word ``i`` is an access from the state of the prefix:
each path it passes is a segment of the way to the root, coloured with the
previous end ``e`` of its strings and reaching up to length ``m``; then the path
takes the colour ``i``.  Where ``i - e <= m``, the last ``i - e`` words are a copy
of those just before them: a square.  The first square of a primitive root in
each run is found this way, and is extended to both sides.

Each word of a run lies in a window of ``LEAST // 2`` words that occurs again in
the same run: with a period of at least that many words both halves are such
copies, and a shorter period leaves room for a window and its shift on either
side.  So only stretches made of windows that occur again in the same stretch go
through the automaton; the test is exact, as equal windows have equal hashes.

Work is per document, memory about half a kilobyte per word of a stretch.  Null,
empty and blank texts have no words and no runs.  Repeated rows each give their
row; a null ``doc_id`` stays null.  Columns besides ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.text import PLACES, mix

#: Words of a run, at least.
LEAST = 12

Run = tuple[int, int, int]


def automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest string of each state, and the state of each prefix.
    State 0 is none, 1 the empty string."""
    step: list[dict[int, int]] = [{}, {}]
    link, longest, prefix = [0, 0], [0, 0], []
    last = 1
    for length, code in enumerate(codes, 1):
        state = len(step)
        step.append({})
        link.append(1)
        longest.append(length)
        at = last
        while at and code not in step[at]:
            step[at][code] = state
            at = link[at]
        if at:
            target = step[at][code]
            if longest[target] == longest[at] + 1:
                link[state] = target
            else:
                copy = len(step)
                step.append(dict(step[target]))
                link.append(link[target])
                longest.append(longest[at] + 1)
                while at and step[at].get(code) == target:
                    step[at][code] = copy
                    at = link[at]
                link[target] = link[state] = copy
        prefix.append(state)
        last = state
    return link, longest, prefix


class Paths:
    """Preferred paths of a fixed tree as splay trees in order of depth.

    ``above`` is the parent in the splay tree, or, from its root, the tree parent
    of the path's top.  The root of each splay tree holds the path's colour."""

    def __init__(self, parent: list[int]) -> None:
        size = len(parent)
        self.above, self.left, self.right = list(parent), [0] * size, [0] * size
        self.colour = [-1] * size

    def _splay(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        top = x
        while (p := above[top]) and (left[p] == top or right[p] == top):
            top = p
        if top == x:
            return
        self.colour[x] = self.colour[top]
        while (p := above[x]) and ((on_left := left[p] == x) or right[p] == x):
            g = above[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                # In line: the parent turns first; else the node turns twice.
                if (left[g] == p) == on_left:
                    self._turn(p)
                else:
                    self._turn(x)
            self._turn(x)

    def _turn(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        p = above[x]
        g = above[p]
        if left[p] == x:
            moved = left[p] = right[x]
            right[x] = p
        else:
            moved = right[p] = left[x]
            left[x] = p
        if moved:
            above[moved] = p
        above[p], above[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Make the way from the root to ``x`` one path of this colour; gives for
        each path passed, upwards, its deepest state on the way and its colour."""
        above, right = self.above, self.right
        passed, below, start = [], 0, x
        while x:
            self._splay(x)
            passed.append((x, self.colour[x]))
            if cut := right[x]:
                self.colour[cut] = self.colour[x]
            right[x] = below
            below = x
            x = above[x]
        self._splay(start)
        self.colour[start] = colour
        return passed


def squares(codes: list[int]) -> Iterator[tuple[int, int]]:
    """(last word, period) of squares: for each last word those of all primitive
    roots."""
    link, longest, prefix = automaton(codes)
    # The empty string (state 1) is the root; state 0 stands above it.
    paths = Paths(link)
    for i, state in enumerate(prefix):
        for deepest, last in paths.access(state, i):
            if last >= 0 and i - last <= longest[deepest]:
                yield i, i - last


def runs_in(codes: list[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of the runs of a stretch, by start and period."""
    found: dict[tuple[int, int], int] = {}
    reached: dict[int, int] = {}
    size = len(codes)
    for last, period in squares(codes):
        if reached.get(period, -1) >= last:
            continue
        start, end = last - 2 * period + 1, last + 1
        while end < size and codes[end] == codes[end - period]:
            end += 1
        while start > 0 and codes[start - 1] == codes[start - 1 + period]:
            start -= 1
        reached[period] = end - 1
        if end - start >= max(least, 2 * period):
            # A multiple of the period spans the same words.
            found[start, end] = min(period, found.get((start, end), period))
    return sorted((start, end - start, period) for (start, end), period in found.items())


def stretches(codes: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Stretches of words, each in a window that occurs again in its stretch."""
    window = min(least // 2, len(PLACES))
    waiting = [(0, len(codes))]
    while waiting:
        a, b = waiting.pop()
        size = b - a - window + 1
        if b - a < least:
            continue
        keys = np.zeros(size, np.uint64)
        for k in range(window):
            keys += codes[a + k : a + k + size] * PLACES[k]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        if not same.any():
            continue
        again = np.zeros(size + 2, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        inside = np.zeros(b - a + 2, bool)
        for k in range(window):
            inside[1 + k : 1 + k + size] |= again[:size]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        parts = [(a + int(x), a + int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)]
        if parts == [(a, b)]:
            yield a, b
        else:
            waiting.extend(parts)


def runs_of(words: list[bytes], least: int = LEAST) -> list[Run]:
    """(start, length, period) of the runs of a text, by start and period."""
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    codes = [numbers.setdefault(word, len(numbers)) for word in words]
    if len(numbers) == len(words):
        return []
    found = []
    for a, b in stretches(mix(np.array(codes, np.uint64) + np.uint64(1)), least):
        found += [(a + start, length, period) for start, length, period in runs_in(codes[a:b], least)]
    return sorted(found)


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words outside every run, or among the first ``period`` words of those
    that hold them."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of every tenth document by its hash with a loop to the end: from
    a word on, the next few over and over."""
    if doc_id is None or not words:
        return words
    digest = crc32(str(doc_id).encode())
    if digest % 10:
        return words
    spread, n = digest // 10, len(words)
    a = spread % n
    unit = words[a : a + 1 + (n - a) // (3 + spread % 8)]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[: n - a]


def _each(
    docs: DataFrame, schema: str, give: Callable[[int | None, str | None], Iterable[tuple]]
) -> DataFrame:
    """Rows of each document by ``give(doc_id, text)``."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    names = [field.split()[0] for field in schema.split(", ")]
    arrow = pa.schema(
        [(name, pa.string() if f"{name} string" in schema else pa.int64()) for name in names]
    )

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                row
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True)
                for row in give(doc_id.as_py(), text.as_py())
            ]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return read.mapInArrow(task, schema)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per run of each document: words from ``start``, counted from 0."""

    def give(doc_id: int | None, text: str | None) -> Iterator[tuple]:
        for run in runs_of(words_of(text), least):
            yield doc_id, *run

    return _each(docs, "doc_id long, start long, length long, period long", give)


def without_loops(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text) with each run cut down to its first period; a text without
    runs stays as it is."""

    def give(doc_id: int | None, text: str | None) -> Iterator[tuple]:
        words = words_of(text)
        runs = runs_of(words, least)
        yield doc_id, b" ".join(kept_words(words, runs)).decode() if runs else text

    return _each(docs, "doc_id long, text string", give)


def _sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


DIGEST = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def digest_runs(docs: DataFrame) -> DataFrame:
    """Per document, looped as ``looped`` says: its longest run (the first, then
    the least period, among equals), digests of all runs and of the kept words."""

    def give(doc_id: int | None, text: str | None) -> Iterator[tuple]:
        words = looped(words_of(text), doc_id)
        runs = runs_of(words)
        kept = kept_words(words, runs)
        best: tuple = (None,) * 4
        if runs:
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            best = start, length, period, 1000 * length // period
        listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        texts = _sha256(listed.encode()), _sha256(b" ".join(kept))
        yield doc_id, len(runs), *best, *texts, len(words), len(words) - len(kept)

    return _each(docs, DIGEST, give)
