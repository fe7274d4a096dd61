"""Benchmark passages in documents, up to a few edits.

By the pigeonhole principle a text that holds a test item with at most ``e``
edits holds at least one of any ``e + 1`` pieces of the item unchanged.  All
pieces are searched at once with an Aho-Corasick automaton; around a hit Myers'
bit-parallel algorithm computes the least edit distance, first of two
neighbouring pieces, then of four and so on up to the whole item: a run of ``p``
pieces may hold ``p - 1`` edits.  If it held more in both halves, the whole would
hold more than it may, so one chain of runs from a piece to the item passes.
Chance hits end at two pieces.

Texts and items are compared in lower case with each run of blanks as one space.
Every item is searched whole, with the budget of its whole length.  Items longer
than ``PASSAGE`` are searched by passages of that many characters besides, which
overlap by half and have budgets of their own: a document that holds a stretch of
1.5 * ``PASSAGE`` characters of such an item holds one of them.  Parts of shorter
items are not searched.

The items are the stated query set: they go to the tasks in blocks of bounded
size, each document is read once per block.  Null or blank items and texts match
nothing; equal items each give their rows; without items there are no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed, as a share of the characters of the passage searched.
EDIT_RATE = 0.08
#: Characters of the passages that are searched besides a longer item.
PASSAGE = 200
#: Characters of items that one block holds.
BLOCK_CHARS = 8_000_000

SCHEMA = "doc_id long, item_id long, distance long, match_start long, match_end long"


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def passages(item: str, size: int = PASSAGE) -> list[str]:
    """The item, and of a longer one passages that cover it: any stretch of
    ``size`` * 1.5 characters holds one of them."""
    found = [item] if item else []
    if len(item) > size:
        found += [item[i : i + size] for i in [*range(0, len(item) - size, size // 2), len(item) - size]]
    return found


def masks(pattern: str) -> dict[str, int]:
    """Per character the places where the pattern has it, as bits."""
    found: dict[str, int] = defaultdict(int)
    for place, char in enumerate(pattern):
        found[char] |= 1 << place
    return dict(found)


def myers(equal: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern (its masks and size) to a substring of
    the text, and the end of the first such substring."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best, where = full, 0, size, size, 0
    for place, char in enumerate(text):
        eq = equal.get(char, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise = down | (full & ~(xh | up))
        fall = up & xh
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(xv | rise)), rise & xv
        if score < best:
            best, where = score, place + 1
    return best, where


class Passage:
    """A passage to search, its pieces, and the runs of pieces above each."""

    def __init__(self, item: int, text: str, edits: int) -> None:
        self.item, self.text, self.edits = item, text, edits
        self.bounds = [len(text) * k // (edits + 1) for k in range(edits + 2)]
        self.chains: list[list[tuple[int, int]]] = [[] for _ in range(edits + 1)]
        self._split(0, edits + 1, [])
        self.masks: dict[tuple[int, int], dict[str, int]] = {}

    def _split(self, i: int, j: int, above: list[tuple[int, int]]) -> None:
        if j - i == 1:
            self.chains[i] = above[::-1]
            return
        middle = (i + j) // 2
        self._split(i, middle, [*above, (i, j)])
        self._split(middle, j, [*above, (i, j)])

    def verify(self, text: str, piece: int, begin: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the passage around a piece found at ``begin``."""
        origin = begin - self.bounds[piece]
        for i, j in self.chains[piece]:
            a, b, edits = self.bounds[i], self.bounds[j], j - i - 1
            if (i, j) not in self.masks:
                self.masks[i, j] = masks(self.text[a:b])
            low = max(0, origin + a - edits)
            distance, end = myers(self.masks[i, j], b - a, text[low : max(0, origin + b + edits)])
            if distance > edits:
                return None
        if not self.chains[piece]:
            return 0, begin, begin + len(self.text)
        stretch = text[low : low + end][::-1]
        _, back = myers(masks(self.text[::-1]), len(self.text), stretch)
        return distance, low + end - back, low + end


def match_text(text: str, automaton, searched: list[Passage]) -> Iterator[tuple]:
    """(item, distance, start, end) of the nearest passage of each item held.

    The automaton's values are the length of the piece and its owners: place in
    ``searched`` and number of the piece."""
    nearest: dict[int, tuple[int, int, int]] = {}
    seen: dict[int, list[int]] = defaultdict(list)
    for last, (length, owners) in automaton.iter(text):
        for which, piece in owners:
            passage = searched[which]
            begin = last + 1 - length
            origin = begin - passage.bounds[piece]
            # Other pieces of a match that is already known.
            if any(abs(origin - other) <= passage.edits for other in seen.get(which, ())):
                continue
            if found := passage.verify(text, piece, begin):
                seen[which].append(origin)
                if passage.item not in nearest or found < nearest[passage.item]:
                    nearest[passage.item] = found
    for item, found in sorted(nearest.items()):
        yield item, *found


def _searcher(items: list[tuple[int, str]], rate: float):
    """The function text -> matches, made in the task that uses it."""
    import ahocorasick

    searched = [
        Passage(item, passage, int(len(passage) * rate))
        for item, content in items
        for passage in passages(content)
    ]
    owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for which, passage in enumerate(searched):
        for piece, (a, b) in enumerate(zip(passage.bounds, passage.bounds[1:], strict=False)):
            owners[passage.text[a:b]].append((which, piece))
    automaton = ahocorasick.Automaton()
    for piece, places in owners.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return lambda text: match_text(plain(text), automaton, searched)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with a text, in blocks of about ``BLOCK_CHARS`` characters."""
    asked = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").alias("asked"))
    chars = asked.agg(F.sum(F.length("asked"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "asked"), F.lit(blocks)) == block).collect()
        items = [(r["item"], plain(r["asked"])) for r in rows if r["asked"] and r["item"] is not None]
        if items := sorted(x for x in items if x[1]):
            yield items


def _search(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    """Matches of one block of items."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(items, rate)
        for batch in batches:
            rows = [
                (doc_id.as_py(), *match)
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True)
                if text.is_valid
                for match in search(text.as_py())
            ]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            names = ["doc_id", "item_id", "distance", "match_start", "match_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.mapInArrow(task, SCHEMA)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """One row per document and test item that it holds: the least number of
    edits, and where in the plain text of the document."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = [_search(read, items, rate) for items in item_blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionAll, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The documents, all columns, that hold no test item.  Documents stay where
    they are: each block of items filters them in place."""
    for items in item_blocks(benchmark):

        def task(
            batches: Iterable[pa.RecordBatch], items: list[tuple[int, str]] = items
        ) -> Iterator[pa.RecordBatch]:
            search = _searcher(items, rate)
            for batch in batches:
                clean = [
                    not text.is_valid or next(search(text.as_py()), None) is None
                    for text in batch.column("text")
                ]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
