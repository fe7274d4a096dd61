"""Removal of passages that occur more than once, byte for byte.

A suffix of a text matters if a passage of ``SPAN`` bytes begins near it that
also begins elsewhere.  Not every suffix has to be sorted for that: among the
``WINDOW`` tokens (runs of ``TOKEN`` bytes) inside any ``SPAN`` bytes the one with
the least hash is chosen, the first of equals.  Equal passages choose the same
token at the same place, so the suffixes that begin at chosen tokens, about one in
70, meet wherever passages are equal.

1. Suffixes whose leading token no other suffix has drop out, by a count of the
   hashes of the leading tokens.
2. The rest go with the ``SPAN`` bytes ahead and the ``SPAN - TOKEN`` behind into
   buckets by ranges of their leading token.  Spark samples the tokens for the
   splitters; suffixes with one leading token are parted further by what follows it,
   then by their surroundings and text, so a line of a third of all documents fills
   many buckets.
3. A bucket sorts its suffixes by multikey quicksort, and what lies before them,
   read backwards, as well.  The common prefixes of neighbours in both orders tell
   which passages around the suffixes are equal, and the longest reach to either side
   is what is removed.
4. Across boundaries: a passage can only occur in another bucket too if what of it lies
   ahead of the suffix begins the first or the last suffix of its bucket as well.  Those
   passages, each once from a bucket, are compared between buckets by aggregations with
   partial sums: first what bands of them have in common, then narrower ones of the
   bands left, then passages.

Suffixes with equal surroundings are settled in the task that reads them, and again
in their bucket, and one goes on.  Texts that occur more than once as a whole are
removed as a whole, and stand once for the others to be compared with.

Inside a bucket bytes are compared.  Between buckets passages are equal if 128 bits of
hashes are, and so are whole texts.  (The count of leading tokens names texts by 64
bits: two texts of one name that share a token at one place, which no third has,
would count as one.)  Null text is empty.  Texts of fewer than ``SPAN`` bytes
lose nothing.  Rows are told apart by their text, so null and repeated ids do no
harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.llm.store import discard, stored
from curbside.llm.text import Hasher, mix, steps, text_bytes

#: Bytes of a passage, and of a token.
SPAN, TOKEN = 200, 64
#: Tokens in a passage, and bytes behind a suffix that its passages reach.
WINDOW, BEHIND = SPAN - TOKEN + 1, SPAN - TOKEN
#: Bytes that travel with a suffix.
AROUND = BEHIND + SPAN
#: Bytes of text that tokens are chosen in at once.
SEGMENT = 4 << 20
#: Suffixes that a task groups before it sends them.
FLUSH = 1 << 20
#: Bytes that one task of a grouping reads, about.
GROUP_BYTES = 48 << 20
#: Suffixes that one bucket sorts, about.
BUCKET = 100_000
#: Suffixes that are cut out or compared at once.
ROWS = 8192
#: Passages around a suffix that are looked for in other buckets at once, step by step;
#: each divides the one before.
BANDS = (35, 7, 1)

U = np.uint64


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    size = len(values) - width + 1
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:size], ahead[width - 1 : width - 1 + size])


def chosen(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the chosen tokens of each text."""
    long = np.diff(offsets) >= SPAN
    whole = np.zeros(len(data) + 1, np.int8)
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - SPAN + 1, -1)
    whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
    places, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin in range(0, len(data), SEGMENT):
        part = data[begin : begin + SEGMENT + SPAN - 1]
        if len(part) < SPAN:
            break
        sums = hasher.sums(part)
        starts = np.arange(len(part) - TOKEN + 1)
        hashes = hasher.ranges(sums, starts, starts + TOKEN)
        # 40 bits of the hash, then the place: the first of equals is the least.
        ranked = (hashes & ~U(0xFFFFFF)) | starts.astype(np.uint64)
        least = _least(ranked, WINDOW)[whole[begin : begin + len(part) - SPAN + 1]]
        found = np.unique((least & U(0xFFFFFF)).astype(np.int64))
        places.append(found + begin)
        tokens.append(hashes[found])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(tokens)[first]


def runs(ordered: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    if not len(ordered):
        return []
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(ordered)], strict=True))


def _tasks(df: DataFrame, size: int) -> int:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // GROUP_BYTES))


def shared_suffixes(texts: DataFrame, size: int) -> DataFrame:
    """(text_key, places) of the suffixes whose leading token is not alone; once per
    task and bucket, packed."""
    tasks = _tasks(texts, size // 2)
    bits = max(3, (tasks * 8 - 1).bit_length())
    names = ["kind", "bucket", "tokens", "keys", "places"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    schema = "kind int, bucket int, tokens binary, keys binary, places binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def group(tokens: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple:
        """Distinct suffixes in order of token, and how many have each token."""
        order = np.lexsort((places, keys, tokens))
        tokens, keys, places = tokens[order], keys[order], places[order]
        if not len(tokens):
            return tokens, keys, places, np.zeros(0, np.int64)
        other = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        other |= (places[1:] != places[:-1]) | (places[1:] < 0)
        fresh = np.append(True, other)
        tokens, keys, places = tokens[fresh], keys[fresh], places[fresh]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        return tokens, keys, places, np.diff(np.append(first, len(tokens)))

    def by_text(keys: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        for a, b in runs(keys):
            yield int(keys[a]), places[a:b].astype("<i4").tobytes()

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple] = []

        def send() -> pa.RecordBatch:
            tokens, keys, places, sizes = group(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            several = np.repeat(sizes, sizes)
            shared = several > 1
            # Known as shared here; one entry tells the bucket how many there are.
            rows = [(1, k & (2**bits - 1), None, np.int64(k).tobytes(), p) for k, p in by_text(keys[shared], places[shared])]
            first = np.cumsum(sizes) - sizes
            head = np.zeros(len(tokens), bool)
            head[first] = True
            places = np.where(shared, -several, places).astype(np.int32)
            keys = np.where(shared, 0, keys)
            stay = head | ~shared
            tokens, keys, places = tokens[stay], keys[stay], places[stay]
            bounds = np.searchsorted(tokens >> U(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
            for bucket in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[bucket], bounds[bucket + 1])
                packed = (tokens[part].tobytes(), keys[part].tobytes(), places[part].tobytes())
                rows.append((0, int(bucket), *packed))
            return batch_of(rows)

        count = 0
        for batch in steps(batches):
            data, offsets = text_bytes(batch.column("text"))
            place, tokens = chosen(data, offsets, hasher)
            text = np.searchsorted(offsets, place, side="right") - 1
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)[text]
            held.append((tokens, keys, (place - offsets[text]).astype(np.int32)))
            count += len(place)
            if count >= FLUSH:
                yield send()
                count = 0
        if held:
            yield send()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["text_key", "places"])

        for batch in batches:
            done = [
                (int.from_bytes(row["keys"], "little", signed=True), row["places"])
                for row in batch.filter(pc.equal(batch.column("kind"), 1)).select(["keys", "places"]).to_pylist()
            ]
            yield rows_of(done)
            for row in batch.filter(pc.equal(batch.column("kind"), 0)).to_pylist():
                kinds = (("tokens", "<u8"), ("keys", "<i8"), ("places", "<i4"))
                parts.append(tuple(np.frombuffer(row[name], kind) for name, kind in kinds))
        tokens, keys, places, sizes = group(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        known = np.where(places < 0, -places.astype(np.int64), 1)
        first = np.cumsum(sizes) - sizes
        # A count from a task means several already, even if it came alone.
        totals = np.add.reduceat(known, first) if len(first) else known
        shared = np.repeat(totals > 1, sizes) & (places >= 0)
        yield rows_of(list(by_text(keys[shared], places[shared])))

    packed = texts.mapInArrow(spread, schema).repartition(tasks, "bucket")
    return packed.mapInArrow(meet, "text_key long, places binary")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges' union as ranges that do not touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[1:] > ends[:-1])[: len(starts)]
    last = np.append(fresh[1:], True)[: len(starts)]
    return starts[fresh], ends[last]


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix by multikey quicksort: each segment is split in
    three by a pivot at its current column, and the middle part goes on to the next
    column.  All segments take a step at once."""
    count, width = words.shape
    order = np.arange(count)
    starts, sizes, depth = np.array([0]), np.array([count]), np.array([0])
    while True:
        open_ = (sizes > 1) & (depth < width)
        starts, sizes, depth = starts[open_], sizes[open_], depth[open_]
        if not len(starts):
            return order
        begin = np.cumsum(sizes) - sizes
        segment = np.repeat(np.arange(len(starts)), sizes)
        where = np.arange(len(segment)) + (starts - begin)[segment]
        rows = order[where]
        values = words[rows, depth[segment]]
        three = np.sort([values[begin], values[begin + sizes // 2], values[begin + sizes - 1]], axis=0)
        pivot = three[1][segment]
        part = (values > pivot).astype(np.int64) + (values >= pivot)
        split = np.bincount(segment * 3 + part, minlength=3 * len(starts)).reshape(-1, 3)
        offset = np.cumsum(split, axis=1) - split
        for side in range(3):
            at = np.flatnonzero(part == side)
            many = split[:, side]
            rank = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            order[np.repeat(starts + offset[:, side], many) + rank] = rows[at]
        starts, sizes = (starts[:, None] + offset).ravel(), split.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common bytes at the head of each row and the one before it in the order; 0
    before the first and behind the last."""
    common = np.zeros(len(order) + 1, np.int64)
    for a in range(0, len(order) - 1, ROWS):
        part = rows[order[a : a + ROWS + 1]]
        other = part[1:] != part[:-1]
        first = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
        common[a + 1 : a + 1 + len(first)] = first
    return common


class Bucket:
    """Suffixes in order, and what lies before them in order of reading backwards.

    ``around`` has ``AROUND`` bytes per suffix, ``BEHIND`` of them before it; bytes beyond the
    text are 0, and ``behind`` and ``ahead`` say how far the text goes."""

    def __init__(self, around: np.ndarray, behind: np.ndarray, ahead: np.ndarray) -> None:
        self.around, self.behind, self.ahead = around, behind, ahead
        sides = (np.ascontiguousarray(around[:, BEHIND:]), np.ascontiguousarray(around[:, BEHIND - 1 :: -1]))
        self.order, self.common, self.place, self.near = [], [], [], []
        for rows in sides:
            order = multikey_order(rows.view(">u8").astype(np.uint64))
            common = common_prefixes(rows, order)
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            self.order.append(order)
            self.common.append(common)
            self.place.append(place)
            self.near.append(np.maximum(common[place], common[place + 1]))
        # One of those with equal surroundings stands for all.
        size = len(around)
        everything = [self._classes(0, SPAN), self._classes(1, BEHIND), behind, ahead]
        line = np.lexsort(everything)
        other = np.any([c[line][1:] != c[line][:-1] for c in everything], axis=0)
        fresh = np.flatnonzero(np.append(True, other))
        sizes = np.diff(np.append(fresh, size))
        self.first, self.settled = np.zeros(size, bool), np.zeros(size, bool)
        self.first[line[fresh]] = True
        self.settled[line] = np.repeat(sizes > 1, sizes)

    def _classes(self, side: int, depth: int, of: np.ndarray | None = None) -> np.ndarray:
        """Numbers that are equal where the first ``depth`` bytes are."""
        number = np.cumsum(self.common[side][:-1] < depth)
        return number[self.place[side] if of is None else self.place[side][of]]

    def passages(self, x: int, of: np.ndarray) -> np.ndarray:
        """Numbers that are equal where the passages are that begin ``x`` bytes before
        the suffixes."""
        return self._classes(0, SPAN - x, of) * (len(self.around) + 1) + self._classes(1, x, of)

    def inside(self, x: int) -> np.ndarray:
        return self.first & (self.behind >= x) & (self.ahead >= SPAN - x)

    def reaches(self) -> tuple[np.ndarray, np.ndarray]:
        """How far back and ahead the repeated passages around each suffix go, 0 and 0
        without any."""
        back, forth = np.where(self.settled, self.behind, 0), np.where(self.settled, self.ahead, 0)
        for x in range(BEHIND + 1):
            near = (self.near[0] >= SPAN - x) & (self.near[1] >= x)
            of = np.flatnonzero(self.inside(x) & near)
            if not len(of):
                continue
            number = self.passages(x, of)
            ordered = np.sort(number)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                equal = of[twice[np.minimum(np.searchsorted(twice, number), len(twice) - 1)] == number]
                back[equal] = np.maximum(back[equal], x)
                forth[equal] = np.maximum(forth[equal], SPAN - x)
        return back, forth

    def edges(self) -> np.ndarray:
        """Whether another bucket may have the passage that begins x bytes before the suffix,
        by suffix and x: what of the passage lies ahead begins the first or the last
        suffix too.  One of those with equal passages stands for all."""
        inner = self.common[0][1:-1]
        bound = np.empty(len(self.around), np.int64)
        bound[self.order[0]] = np.maximum(
            np.minimum.accumulate(np.append(SPAN, inner)),
            np.minimum.accumulate(np.append(SPAN, inner[::-1]))[::-1],
        )
        found = np.zeros((len(bound), WINDOW), bool)
        for x in range(WINDOW):
            of = np.flatnonzero(self.inside(x) & (bound >= SPAN - x))
            if len(of):
                found[of[np.unique(self.passages(x, of), return_index=True)[1]], x] = True
        return found


RANGES = "text_id long, starts binary, ends binary"


def _ranges(rows: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> list[pa.Array]:
    packed = [(k, a.astype("<i8").tobytes(), b.astype("<i8").tobytes()) for k, a, b in rows]
    columns = list(zip(*packed, strict=True)) if packed else [()] * 3
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]


def surroundings(found: DataFrame) -> DataFrame:
    """One row per suffix with the bytes around it; and ranges of suffixes that have
    equal surroundings inside one text, of which one goes on."""
    names = ["text_id", "starts", "ends", "place", "behind", "ahead", "around"]
    empty_kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def suffixes(rows: list[tuple]) -> pa.RecordBatch:
        ids, place, behind, ahead, around = (np.concatenate(c) for c in zip(*rows, strict=True))
        offsets = np.arange(len(around) + 1, dtype=np.int32) * AROUND
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(around))]
        cells = pa.Array.from_buffers(pa.binary(), len(around), buffers)
        nothing = pa.nulls(len(ids), pa.binary())
        arrays = [pa.array(ids), nothing, nothing, pa.array(place), pa.array(behind), pa.array(ahead), cells]
        return pa.RecordBatch.from_arrays(arrays, names)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            for key, text, lists in zip(*(batch.column(c) for c in ("text_id", "text", "places")), strict=True):
                key, content = key.as_py(), np.frombuffer(text.as_buffer(), np.uint8)
                place = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in lists.as_py()])).astype(np.int64)
                place = place[place <= len(content) - TOKEN]
                padded = np.concatenate([np.zeros(BEHIND, np.uint8), content, np.zeros(SPAN, np.uint8)])
                windows = np.lib.stride_tricks.sliding_window_view(padded, AROUND)
                behind = np.minimum(place, BEHIND).astype(np.int32)
                ahead = np.minimum(len(content) - place, SPAN).astype(np.int32)
                if len(place) > 1:
                    digests = b"".join(hashlib.md5(padded[p : p + AROUND]).digest() for p in place.tolist())
                    low, high = np.frombuffer(digests, "<u8").reshape(-1, 2).T
                    low = low ^ mix((behind * (SPAN + 1) + ahead).astype(np.uint64))
                    line = np.lexsort((high, low))
                    other = (low[line][1:] != low[line][:-1]) | (high[line][1:] != high[line][:-1])
                    fresh = np.flatnonzero(np.append(True, other))
                    sizes = np.diff(np.append(fresh, len(line)))
                    again = line[np.repeat(sizes > 1, sizes)]
                    if len(again):
                        settled = _ranges([(key, *merged((place - behind)[again], (place + ahead)[again]))])
                        empty = [pa.nulls(1, k) for k in empty_kinds]
                        yield pa.RecordBatch.from_arrays([*settled, *empty], names)
                    one = np.sort(line[fresh])
                    place, behind, ahead = place[one], behind[one], ahead[one]
                for a in range(0, len(place), ROWS):
                    part = slice(a, a + ROWS)
                    ids = np.full(len(place[part]), key, np.int64)
                    held.append((ids, place[part], behind[part], ahead[part], windows[place[part]]))
                    count += len(ids)
                    if count >= ROWS:
                        yield suffixes(held)
                        held, count = [], 0
        if held:
            yield suffixes(held)

    return found.mapInArrow(spread, f"{RANGES}, place long, behind int, ahead int, around binary")


def sorted_buckets(suffixes: DataFrame, buckets: int) -> DataFrame:
    """Ranges to remove, from the order of suffixes in each bucket; and rows with a
    ``bucket``, the suffixes with ``passages`` that other buckets may have too: how many bytes
    before the suffix they begin."""
    names = ["text_id", "starts", "ends", "place", "around", "bucket", "back", "forth", "passages"]
    edge_kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        del parts
        ids, places, behind, ahead = (table.column(c).to_numpy() for c in ("text_id", "place", "behind", "ahead"))
        cells = table.column("around").chunk(0)
        offsets = np.frombuffer(cells.buffers()[1], np.int32)
        around = np.frombuffer(cells.buffers()[2], np.uint8)[offsets[cells.offset] :][: len(ids) * AROUND]
        # The same suffix comes again where rows repeat a text's representative.
        line = np.lexsort((places, ids))
        same = (ids[line][1:] == ids[line][:-1]) & (places[line][1:] == places[line][:-1])
        line = line[np.append(True, ~same)]
        around = around.reshape(-1, AROUND)[line]
        ids, places = ids[line], places[line]
        bucket = Bucket(around, behind[line].astype(np.int64), ahead[line].astype(np.int64))
        back, forth = bucket.reaches()
        hit = np.flatnonzero(forth > 0)
        key, start, end = ids[hit], (places - back)[hit], (places + forth)[hit]
        arrays = _ranges((int(key[i]), *merged(start[i:j], end[i:j])) for i, j in runs(key))
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(arrays[0]), k) for k in edge_kinds)], names)
        passages = bucket.edges()
        edge = np.flatnonzero(passages.any(axis=1))
        number = TaskContext.get().partitionId()
        for a in range(0, len(edge), ROWS):
            part = edge[a : a + ROWS]
            nothing = pa.nulls(len(part), pa.binary())
            values = (
                places[part], [row.tobytes() for row in around[part]], np.full(len(part), number, np.int32),
                back[part].astype(np.int32), forth[part].astype(np.int32),
                [np.flatnonzero(row) for row in passages[part]],
            )
            cells = (pa.array(v, k) for v, k in zip(values, edge_kinds, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), nothing, nothing, *cells], names)

    ahead_of = F.substring("around", BEHIND + 1, SPAN)
    dealt = suffixes.repartitionByRange(buckets, ahead_of, F.xxhash64("around"), "text_id")
    schema = f"{RANGES}, place long, around binary, bucket int, back int, forth int, passages array<int>"
    return dealt.mapInArrow(compare, schema)


def across_buckets(edges: DataFrame) -> DataFrame:
    """Ranges around the suffixes whose passages more than one bucket has.

    First the bytes that all passages of a band (those that begin ``low`` to ``low + width - 1`` bytes
    before the suffix) have in common are counted; only bands with bytes that another bucket has are
    resolved into narrower ones, the last of which are passages.  A suffix asks only for passages
    beyond the ``back`` and ``forth`` that its own bucket found, and a band that none asks for ends."""

    def band_of(width: int) -> Callable[[Column], Column]:
        return lambda x: x - x % width

    left = edges
    for width in BANDS:
        last = F.least(F.col("low") + width - 1, F.lit(BEHIND))
        part = F.substring("around", BEHIND + 1 - F.col("low"), F.col("low") + SPAN - last)
        band = band_of(width)
        lows = F.array_distinct(F.transform("passages", band))
        beyond = F.filter("passages", lambda x: (x > F.col("back")) | (x < SPAN - F.col("forth")))
        bands = left.withColumn("asked", F.transform(beyond, band)).withColumn("low", F.explode(lows)).select(
            "text_id", "place", "bucket", "low", F.array_contains("asked", F.col("low")).alias("asks"),
            F.xxhash64(part).alias("hash"), F.xxhash64(F.lit(1), part).alias("more"),
        )
        names = ["low", "hash", "more"]
        counted = bands.groupBy(*names).agg(
            F.min("bucket").alias("least"), F.max("bucket").alias("greatest"), F.max("asks").alias("asks")
        )
        # In wider bands those that answer go on beside those that ask.
        asking = bands if width > 1 else bands.where("asks")
        hits = asking.join(counted.where("least <> greatest and asks").select(*names), names, "left_semi")
        if width > 1:
            shared = hits.groupBy("text_id", "place").agg(F.collect_set("low").alias("lows"))
            inside = F.filter("passages", lambda x: F.array_contains("lows", band(x)))  # noqa: B023
            left = left.join(shared, ["text_id", "place"]).withColumn("passages", inside).drop("lows")
            left = stored(left, "shared_bands")
    hits = hits.groupBy("text_id", "place").agg(F.max("low").alias("back"), (SPAN - F.min("low")).alias("forth"))
    # As the packed ranges: little-endian longs, one range per row.
    little = lambda c: F.reverse(F.split(F.regexp_replace(F.lpad(F.hex(c), 16, "0"), "(..)(?!$)", "$1 "), " "))
    packed = lambda c: F.unhex(F.array_join(little(c), ""))
    start, end = F.col("place") - F.col("back"), F.col("place") + F.col("forth")
    return hits.select("text_id", packed(start).alias("starts"), packed(end).alias("ends"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    content = F.coalesce(F.col(text), F.lit(""))
    # The text's own hashes name it.
    read = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        content.alias("text"),
        F.xxhash64(content).alias("text_key"),
        F.xxhash64(F.lit(1), content).alias("more_key"),
        F.octet_length(content).cast("long").alias("n_bytes"),
    )
    long = read.where(F.col("n_bytes") >= SPAN)
    texts = stored(
        long.groupBy("text_key", "more_key")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n_bytes"))
        .withColumn("text_id", F.monotonically_increasing_id()),
        "texts",
    )
    size = int(texts.agg(F.sum("n_bytes")).first()[0] or 0)
    met = stored(shared_suffixes(long.select("text", "text_key"), size), "places")
    places = met.groupBy("text_key").agg(F.collect_list("places").alias("places"))
    held = places.join(texts.select("text_key", "more_key", "text_id", "rep"), "text_key")
    found = long.alias("l").join(
        held.alias("h"),
        (F.col("l.text_key") == F.col("h.text_key"))
        & (F.col("l.more_key") == F.col("h.more_key"))
        & F.col("l.doc_id").eqNullSafe(F.col("h.rep")),
    ).select("h.text_id", "l.text", "h.places")
    cut_out = stored(surroundings(found), "surroundings")
    discard(met)
    settled = cut_out.where("starts is not null").select("text_id", "starts", "ends")
    suffixes = cut_out.where("starts is null").select("text_id", "place", "behind", "ahead", "around")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = stored(sorted_buckets(suffixes, max(least, -(-suffixes.count() // BUCKET))), "ranges")
    ranges = sorted_.where("starts is not null").select("text_id", "starts", "ends").unionAll(settled)
    edges = sorted_.where("starts is null").drop("starts", "ends")
    removed = (
        ranges.unionAll(across_buckets(edges))
        .groupBy("text_id")
        .agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    )
    marked = texts.join(removed, "text_id", "left").where("copies > 1 or starts is not null").select(
        F.col("text_key").alias("m_key"), F.col("more_key").alias("m_more"),
        (F.col("copies") > 1).alias("whole"), "starts", "ends",
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            columns = ("text", "whole", "starts", "ends")
            for content, whole, starts, ends in zip(*(batch.column(c) for c in columns), strict=True):
                data = content.as_buffer()
                size = len(data)
                if whole.as_py():
                    a, b = np.array([0]), np.array([size])
                elif starts.is_valid:
                    a, b = merged(
                        *(np.concatenate([np.frombuffer(x, "<i8") for x in c.as_py()]) for c in (starts, ends))
                    )
                else:
                    a = b = np.zeros(0, np.int64)
                kept, done = hashlib.sha256(), 0
                view = memoryview(data)
                for start, end in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(view[done:start])
                    done = end
                kept.update(view[done:])
                values = (size, int((b - a).sum()), len(a), kept.hexdigest())
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = read.join(marked, (F.col("text_key") == F.col("m_key")) & (F.col("more_key") == F.col("m_more")), "left")
    return joined.select("doc_id", "text", "whole", "starts", "ends").mapInArrow(cut, schema)
