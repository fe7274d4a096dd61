"""Language identification by nearest centroid.

A text is the unit vector of its hashed byte trigrams, weighted by TF-IDF.  Each
language has several centroids, found by spherical k-means among its sampled
texts, since a language's texts (prose, lists, shouting) lie in several places.
A text gets the language of the centroid with the largest cosine.  It is
rejected (``accepted`` false) where the cosine is below what nearly all texts of
that centroid had; the nearest language is still told.

Null texts and texts without a letter are ``und`` with score 0.  Without a
learned language every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.samples import labelled_sample, texts_of
from curbside.llm.store import fold
from curbside.llm.text import LOWER, NOT_LETTER, steps, text_bytes

#: Documents that the centroids are fitted on, at most.
SAMPLE = 8_000
SLOTS = 2048
CENTROIDS, ROUNDS = 3, 10
#: Share of a centroid's own texts that would be rejected.
REJECTED = 0.005
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    langs: list[str]  # of each centroid
    least: np.ndarray  # cosine below which a text is rejected


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts of each text; anything but letters counts as one space."""
    size = len(offsets) - 1
    if not len(data):
        return np.zeros((size, SLOTS), np.float32)
    plain = LOWER[data].copy()
    blank = NOT_LETTER[data]
    plain[blank] = 32
    before, after = np.roll(plain, 1), np.roll(plain, -1)
    # A text's first and last bytes stand beside blanks, not beside other texts.
    before[offsets[:-1][offsets[:-1] < len(data)]] = 32
    after[offsets[1:][offsets[1:] > 0] - 1] = 32
    gram = (before.astype(np.uint32) << 16) | (plain.astype(np.uint32) << 8) | after
    slot = (((gram * np.uint32(0x9E3779B1)) >> np.uint32(7)) & np.uint32(SLOTS - 1)).astype(np.int32)
    # Trigrams around a blank tell nothing of their own.
    keep = ~blank
    found = np.zeros((size, SLOTS), np.float32)
    for text, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b > a:
            found[text] = np.bincount(slot[a:b][keep[a:b]], minlength=SLOTS)
    return found


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (rows / np.maximum(length, 1e-12)).astype(np.float32)


def learn(rows: np.ndarray, langs: np.ndarray) -> Model:
    """Centroids from trigram counts and languages."""
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
    vectors = unit(np.log1p(rows) * idf)
    centroids, names, least = [], [], []
    for lang in sorted(set(langs)):
        own = vectors[langs == lang]
        # Start from the mean and, one by one, the text farthest from all so far.
        places = [unit(own.mean(axis=0, keepdims=True))[0]]
        while len(places) < min(CENTROIDS, len(own)):
            near = (own @ np.stack(places).T).max(axis=1)
            places.append(own[near.argmin()])
        now = np.stack(places)
        for _ in range(ROUNDS):
            nearest = (own @ now.T).argmax(axis=1)
            now = np.stack(
                [
                    unit(own[nearest == k].mean(axis=0, keepdims=True))[0]
                    if (nearest == k).any()
                    else now[k]
                    for k in range(len(now))
                ]
            )
        cosine = own @ now.T
        nearest = cosine.argmax(axis=1)
        for k in range(len(now)):
            mine = cosine[nearest == k, k]
            if len(mine):
                centroids.append(now[k])
                names.append(lang)
                least.append(np.quantile(mine, REJECTED))
    return Model(idf, np.stack(centroids), names, np.array(least))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` documents outside the held-out fold whose
    language is known."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = counts(*text_bytes(batch.column("text")))
            # Sent as packed small counts; what is above stays at the top.
            packed = np.minimum(found, 65535).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("y"),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                ],
                ["doc_id", "y", "counts"],
            )

    known = docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).where("text is not null")
    chosen = labelled_sample(known, sample, F.col("lang").alias("y"))
    read = texts_of(chosen, docs).mapInArrow(task, "doc_id long, y string, counts binary")
    rows = sorted((r["doc_id"], r["y"], r["counts"]) for r in read.collect())
    if not rows:
        return None
    found = np.stack([np.frombuffer(r[2], "<u2") for r in rows]).astype(np.float32)
    return learn(found, np.array([r[1] for r in rows], object))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language of each document from its whole text."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            column = batch.column("text")
            found = counts(*text_bytes(column))
            spoken = found.sum(axis=1) > 0
            for i in np.flatnonzero(spoken):
                # ASCII letters settle it for nearly all texts.
                spoken[i] = has_letter(column[int(i)].as_py())
            if model is None:
                spoken[:] = False
            names = np.full(len(found), UNKNOWN, object)
            score, accepted = np.zeros(len(found)), np.zeros(len(found), bool)
            if spoken.any():
                cosine = unit(np.log1p(found[spoken]) * model.idf) @ model.centroids.T
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(len(best)), best].astype(np.float64)
                names[spoken] = np.array(model.langs, object)[best]
                score[spoken] = np.clip(top, 0, 1)
                accepted[spoken] = top >= model.least[best]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names.tolist(), pa.string()),
                    pa.array(score),
                    pa.array(accepted),
                ],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, lang_pred string, score double, accepted boolean"
    return read.mapInArrow(task, schema).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "lang_pred",
        "score",
        "accepted",
    )


def identify_languages(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
