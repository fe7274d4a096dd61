"""Where two tokenizers cut the same text alike.

Both cover a space and the text, byte for byte.  Tokens of one and of the other
that share bytes belong together; the groups are the connected components of this
overlap.  Every token points to the farthest-right token of the other tokenizer
that shares a byte with it, which is the one that holds its last byte; a token of
the second that ends where one of the first ends points to itself.  Replacing
every pointer by its pointer's pointer doubles the way it jumps, so that after a
logarithm of the longest chain all tokens point to the last token of their group.

A link is a pair of tokens that end at one byte.  Of two byte ranges with one end
the shorter is a suffix of the longer, so the vocabularies alone tell which ids
can ever be linked: a list of some hundred thousand pairs at any size of the
corpus.  Links are stored as places in that list, counted over the corpus by a
grouping, and the counts, no longer than the list, go to all tasks.

Tokens are those of texts as they are: the strings of special tokens are plain
text.  A text that is null or empty, or whose tokens do not spell a space and the
text (a tokenizer changed it), has no tokens: counts 0 and an empty digest.
Repeated rows each count and each give their row; a null ``doc_id`` stays null.
Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
import os.path
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.store import stored
from curbside.llm.text import steps

#: Folder of the vocabulary files, read on the driver only; and the files.
FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text tokenized at once; a longer text goes alone.
STEP = 1 << 20
#: How byte-level vocabularies cut a text before merging (fixed by the vocabulary).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where
    it is printable Latin-1, else the next free code point from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Tokenizers:
    """Both vocabularies, as the contents of their files."""

    byte_level: bytes
    pieces: bytes

    @classmethod
    def read(cls, folder: str = FOLDER) -> Tokenizers:
        contents = []
        for name in (BYTE_LEVEL, PIECES):
            with open(os.path.join(folder, name), "rb") as file:
                contents.append(file.read())
        return cls(*contents)

    def __getstate__(self) -> tuple[bytes, bytes]:
        return self.byte_level, self.pieces

    def __setstate__(self, state: tuple[bytes, bytes]) -> None:
        self.byte_level, self.pieces = state

    @cached_property
    def first(self):
        """The byte-level vocabulary in the faster engine: merges go by id, as they
        do in the file.  Tokens are the same for every code point."""
        import tiktoken

        ranks = {token: number for number, token in enumerate(self.first_bytes)}
        return tiktoken.Encoding("first", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def second(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.pieces)

    @cached_property
    def first_bytes(self) -> list[bytes]:
        """Bytes of each id; those of added tokens are their text."""
        letters = byte_letters()
        vocabulary = json.loads(self.byte_level)["model"]["vocab"]
        found = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            plain = all(c in letters for c in token)
            found[number] = bytes(letters[c] for c in token) if plain else token.encode()
        return found

    @cached_property
    def second_bytes(self) -> list[bytes]:
        pieces = self.second
        return [
            bytes([int(pieces.id_to_piece(i)[3:5], 16)])
            if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(pieces.get_piece_size())
        ]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        first = [self.first.encode_ordinary(" " + text) for text in texts]
        return first, self.second.encode(texts, num_threads=1)


def possible_links(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """All pairs of ids, as ``a * len(second) + b`` in order, of which one's bytes
    end the other's: no text can link others."""
    by_bytes: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for known, tokens in zip(by_bytes, (first, second), strict=True):
        for number, token in enumerate(tokens):
            known[token].append(number)
    size, found = len(second), set()
    for number, token in enumerate(second):
        for k in range(len(token)):
            found.update(a * size + number for a in by_bytes[0].get(token[k:], ()))
    for number, token in enumerate(first):
        for k in range(len(token)):
            found.update(number * size + b for b in by_bytes[1].get(token[k:], ()))
    return np.array(sorted(found), np.int64)


def last_of_group(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of either tokenizer the number of the last token of the
    second in its group, from where the tokens end; both end with the text."""
    size = len(ends_a)
    over_a = size + np.searchsorted(ends_b, ends_a)
    over_b = np.searchsorted(ends_a, ends_b)
    itself = ends_a[over_b] == ends_b
    over_b[itself] = size + np.flatnonzero(itself)
    pointer = np.concatenate([over_a, over_b])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer[:size] - size, pointer[size:] - size
        pointer = further


@dataclass
class Aligned:
    """Groups of some texts end to end: for each token its group, and for each
    group its last tokens."""

    group_a: np.ndarray
    group_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    if not len(ends_a):
        none = np.zeros(0, np.int64)
        return Aligned(none, none, none, none)
    of_a, of_b = last_of_group(ends_a, ends_b)
    last_b = np.unique(of_b)
    return Aligned(
        np.searchsorted(last_b, of_a),
        np.searchsorted(last_b, of_b),
        np.searchsorted(ends_a, ends_b[last_b]),
        last_b,
    )


class Writer:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.size_a, self.size_b = size_a, size_b
        self.texts = [f"{i}{end}" for end in (",", "|") for i in range(size_a)]
        self.texts += [f"{i}{end}" for end in (",", ";") for i in range(size_b)]

    def entries(self, ids_a: np.ndarray, ids_b: np.ndarray, aligned: Aligned) -> np.ndarray:
        """Numbers of the texts in the order they are written."""
        codes_a, codes_b = ids_a.copy(), ids_b + 2 * self.size_a
        codes_a[aligned.last_a] += self.size_a
        codes_b[aligned.last_b] += self.size_b
        before = np.concatenate([[0], aligned.last_b + 1])
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + before[aligned.group_a]] = codes_a
        out[np.arange(len(ids_b)) + aligned.last_a[aligned.group_b] + 1] = codes_b
        return out

    def digest(self, entries: np.ndarray) -> str:
        if not len(entries):
            return ""
        written = "".join([self.texts[i] for i in entries.tolist()])
        return hashlib.sha256(written[:-1].encode()).hexdigest()


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"


def _aligned_rows(
    numbers: pa.Array, texts: list[str | None], tools: Tokenizers, possible: np.ndarray, writer: Writer
) -> pa.RecordBatch:
    """Rows of ``ALIGNED`` for some texts."""
    first_bytes, second_bytes = tools.first_bytes, tools.second_bytes
    given = [i for i, text in enumerate(texts) if text]
    found_a, found_b = tools.encode([texts[i] for i in given]) if given else ([], [])
    ids_a: list[list[int]] = [[] for _ in texts]
    ids_b: list[list[int]] = [[] for _ in texts]
    for i, own_a, own_b in zip(given, found_a, found_b, strict=True):
        whole = b" " + texts[i].encode()
        if b"".join([first_bytes[t] for t in own_a]) == whole == b"".join([second_bytes[t] for t in own_b]):
            ids_a[i], ids_b[i] = own_a, own_b
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    flat_a, flat_b = (
        np.fromiter((t for own in ids for t in own), np.int64, int(n.sum()))
        for ids, n in ((ids_a, n_a), (ids_b, n_b))
    )
    widths = [np.array([len(t) for t in tokens], np.int64) for tokens in (first_bytes, second_bytes)]
    aligned = align(np.cumsum(widths[0][flat_a]), np.cumsum(widths[1][flat_b]))
    upto_a, upto_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    entries = writer.entries(flat_a, flat_b, aligned)
    cuts = (upto_a + upto_b).tolist()
    links = np.searchsorted(
        possible, flat_a[aligned.last_a] * len(second_bytes) + flat_b[aligned.last_b]
    )
    # Groups end inside their text, so texts cut the groups as they cut the tokens.
    upto = np.searchsorted(aligned.last_b, upto_b)
    columns = [
        numbers,
        pa.array(n_a),
        pa.array(n_b),
        pa.array(np.diff(upto)),
        pa.array([writer.digest(entries[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()),
        pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(links.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(
        columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
    )


def align_documents(docs: DataFrame, tools: Tokenizers, possible: np.ndarray) -> DataFrame:
    """Per document its numbers of tokens and groups, the digest of the groups, and
    its links as places in ``possible``."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(len(tools.first_bytes), len(tools.second_bytes))
        for part in steps(batches, limit=STEP):
            texts = part.column("text").to_pylist()
            yield _aligned_rows(part.column("doc_id"), texts, tools, possible, writer)

    return read.mapInArrow(task, ALIGNED)


def link_counts(aligned: DataFrame, possible: np.ndarray) -> np.ndarray:
    """How many links of the corpus hold each possible pair."""
    counted = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    found = counted.toArrow()
    counts = np.zeros(len(possible), np.int64)
    counts[found["link"].to_numpy()] = found["n"].to_numpy()
    return counts


RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def digest_alignment(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Per document its groups and links, ``n_best`` (links that are the most
    frequent one of their second token over the corpus) and ``count_sum`` (counts
    over the corpus, summed over the document's links)."""
    tools = Tokenizers.read(folder)
    possible = possible_links(tools.first_bytes, tools.second_bytes)
    aligned = stored(align_documents(docs, tools, possible), "aligned")
    counts = link_counts(aligned, possible)
    second = possible % len(tools.second_bytes)
    highest = np.zeros(len(tools.second_bytes), np.int64)
    np.maximum.at(highest, second, counts)
    best = counts == highest[second]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column("links")
            upto = links.offsets.to_numpy().astype(np.int64)
            held = links.values.to_numpy()[upto[0] : upto[-1]]
            upto = upto - upto[0]
            sums = [np.concatenate([[0], np.cumsum(x[held])])[upto] for x in (best, counts)]
            columns = [
                *[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")],
                *[pa.array(np.diff(x).astype(np.int64)) for x in (upto, *sums)],
                batch.column("groups_sha256"),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])

    return aligned.mapInArrow(task, RESULT)
