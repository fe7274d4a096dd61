"""Toxicity: cumulative-link ordinal regression over sparse text features.

A document has the linear score ``z``, the sum of its words' weights, and

    P(grade >= k) = 1 / (1 + exp(threshold_k - z)),   threshold_1 < threshold_2 < ...

All thresholds share the weights, so the grades are ordered by construction.
The expected severity is the sum of these probabilities over k.  Weights are
fitted by proximal gradient steps with an L1 penalty on a bounded sample: words
that tell nothing get weight 0, so long clean documents gather no noise.  The
penalty also draws the probabilities of toxic texts down, so ``toxic`` is told by
a cut of its own: of the probabilities of the documents learned from, the one
where the shares of toxic ones below it and of others from it on sum up to least,
with at most ``FALSE_ALARMS`` of the others.

Where only toxic or not is known, grades 2 and 3 say how many telling words a
toxic document holds: they are a scale of word load, not a judgement by people.

Words are runs of ASCII letters and of bytes of longer code points, in lower
case for A-Z, hashed to ``SLOTS`` weights.  Null and empty texts score as a text
without words.  Grades missing from the sample leave their threshold at the end
of the scale.
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
from curbside.llm.text import LOWER, NOT_LETTER, Hasher, per_text, steps, text_bytes, words

#: Labelled documents that the weights are fitted on, at most.
SAMPLE = 6_000
SLOTS = 1 << 18
STEPS, PENALTY = 600, 1.5e-3
#: A word has to come in so many sampled documents, and in no larger share of
#: them, to get a weight.
LEAST, MOST_SHARE = 5, 0.3
FOLDS, HELD_OUT = 3, 1
#: Share of the other documents learned from that the cut may call toxic.
FALSE_ALARMS = 0.01
#: Telling words from which a toxic document is of the 2nd, 3rd grade.
GRADE_CUTS = (3, 6)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5  # P(grade >= 1) from which a document is toxic

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def slots(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each word, and the number of each text's first word."""
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets, NOT_LETTER)
    hashes = hasher.ranges(hasher.sums(data), starts, ends)
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64), firsts


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int) -> Model:
    """Weights and thresholds from slots (with repeats) and grade of each row."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    pairs, count = np.unique(doc * SLOTS + flat, return_counts=True)
    doc, slot = pairs // SLOTS, pairs % SLOTS
    held = np.bincount(slot, minlength=SLOTS)
    keep = ((held >= LEAST) & (held <= MOST_SHARE * len(rows)))[slot]
    doc, slot, value = doc[keep], slot[keep], np.log1p(count[keep])
    share = [(np.sum(grades >= k) + 0.5) / (len(grades) + 1) for k in range(1, levels)]
    thresholds = -np.log(np.array(share) / (1 - np.array(share)))
    weights = np.zeros(SLOTS)
    if not len(slot) or grades.min() == grades.max():
        return Model(weights, thresholds)
    # Words whose slope at weight 0 is below the penalty keep weight 0 (nearly
    # always); without them the steps are few and large.
    chances = np.append(np.append(1.0, share), 0.0)
    pull = chances[grades] + chances[grades + 1] - 1
    slope = np.abs(np.bincount(slot, value * pull[doc], SLOTS)) / len(rows)
    keep = (slope > PENALTY)[slot]
    doc, slot, value = doc[keep], slot[keep], value[keep]
    # The penalty chooses the words; what is chosen is fitted again with less of it.
    for penalty in (PENALTY, PENALTY / 20):
        used, column = np.unique(slot, return_inverse=True)
        if not len(used):
            return Model(weights, thresholds)
        w, b = _descend(doc, column, value, grades, thresholds, penalty)
        weights[:] = 0
        weights[used] = w
        keep = w[column] != 0
        doc, slot, value = doc[keep], slot[keep], value[keep]
    return Model(weights, b)


def _descend(
    doc: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray,
    thresholds: np.ndarray, penalty: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient on the cumulative-link loss."""
    n, levels = len(grades), len(thresholds) + 1
    w, b = np.zeros(column.max() + 1), thresholds.copy()
    ahead_w, ahead_b, momentum = w, b, 1.0
    step = 1.0 / (0.25 * n * max(np.bincount(doc, value * value, n).max(), 1.0))
    for _ in range(STEPS):
        z = np.bincount(doc, value * ahead_w[column], n)
        low, high = np.append(-40.0, ahead_b), np.append(ahead_b, 40.0)
        below = 1 / (1 + np.exp(np.clip(z - low[grades], -40, 40)))
        upto = 1 / (1 + np.exp(np.clip(z - high[grades], -40, 40)))
        chance = np.maximum(upto - below, 1e-9)
        d_low, d_high = below * (1 - below), upto * (1 - upto)
        slope = (d_high - d_low) / chance
        gradient = np.array(
            [
                np.sum((d_low / chance)[grades == k]) - np.sum((d_high / chance)[grades == k - 1])
                for k in range(1, levels)
            ]
        )
        new_w = ahead_w - step * np.bincount(column, value * slope[doc], len(w))
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty * n, 0)
        new_b = np.maximum.accumulate(ahead_b - step * gradient) + np.arange(levels - 1) * 1e-6
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead_w = new_w + (momentum - 1) / after * (new_w - w)
        ahead_b = np.maximum.accumulate(new_b + (momentum - 1) / after * (new_b - b))
        w, b, momentum = new_w, new_b, after
    return w, b


def linear_scores(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """z of each document from the slots of its words."""
    found = [np.unique(own, return_counts=True) for own in rows]
    return np.array([float(weights[slot] @ np.log1p(count)) for slot, count in found])


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades for documents of which only toxic or not is known: 0 if not, else
    1, 2 or 3 by how many telling words they hold.  A word tells if its share of
    the toxic documents is five times its share of the others."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pairs = np.unique(doc * SLOTS + np.concatenate(rows))
    doc, slot = pairs // SLOTS, pairs % SLOTS
    yes = np.bincount(slot[toxic[doc] == 1], minlength=SLOTS)
    no = np.bincount(slot[toxic[doc] == 0], minlength=SLOTS)
    share_yes, share_no = yes / max(toxic.sum(), 1), no / max((toxic == 0).sum(), 1)
    tells = (yes >= LEAST) & (share_yes > 5 * share_no) & (share_yes > 0.02)
    hits = np.array([tells[r].sum() for r in rows], np.int64)
    return np.where(toxic == 1, 1 + sum((hits >= cut).astype(np.int64) for cut in GRADE_CUTS), 0)


def toxic_cut(chances: np.ndarray, toxic: np.ndarray) -> float:
    """The cut, from P(grade >= 1) of the documents learned from; half way to the
    next lower probability.  0.5 where a side has no documents."""
    yes, no = np.sort(chances[toxic == 1]), np.sort(chances[toxic == 0])
    if not len(yes) or not len(no):
        return 0.5
    every = np.unique(chances)
    missed = np.searchsorted(yes, every) / len(yes)
    alarms = 1 - np.searchsorted(no, every) / len(no)
    error = np.where(alarms <= FALSE_ALARMS, missed + alarms, np.inf)
    best = int(np.argmin(error))
    if not np.isfinite(error[best]):
        return 0.5
    return float((every[best] + every[max(best - 1, 0)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in steps(batches):
            found, firsts = slots(*text_bytes(batch.column("text")), hasher)
            lists = pa.ListArray.from_arrays(
                pa.array(firsts, pa.int32()), pa.array(found, pa.int32())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), lists], ["doc_id", "y", "slots"]
            )

    known = labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).where("toxic in (0, 1)")
    chosen = labelled_sample(known, sample, F.col("toxic").cast("int").alias("y"))
    read = texts_of(chosen, docs).mapInArrow(task, "doc_id long, y int, slots array<int>")
    rows = sorted(read.collect(), key=lambda r: (r["doc_id"], r["y"], len(r["slots"])))
    features = [np.array(r["slots"], np.int64) for r in rows]
    toxic = np.array([r["y"] for r in rows], np.int64)
    if not len(rows):
        return Model(np.zeros(SLOTS), np.full(len(GRADE_CUTS) + 1, 40.0))
    model = fit_ordinal(features, severity_grades(features, toxic), len(GRADE_CUTS) + 2)
    model.cut = toxic_cut(model.at_least(linear_scores(features, model.weights))[:, 0], toxic)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Expected severity of each document from its whole text."""
    weights, thresholds = model.weights.astype(np.float32), model.thresholds
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), shared.value
        for batch in steps(batches):
            found, firsts = slots(*text_bytes(batch.column("text")), hasher)
            # Only words with a weight matter: their counts per text and slot.
            told = np.flatnonzero(table[found])
            size = len(firsts) - 1
            text = np.repeat(np.arange(size), per_text(table[found] != 0, firsts))
            pairs, count = np.unique(text * SLOTS + found[told], return_counts=True)
            part = table[pairs % SLOTS].astype(np.float64) * np.log1p(count)
            z = np.bincount(pairs // SLOTS, part, size)
            chances = Model(table, thresholds).at_least(z)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(chances.sum(axis=1)),
                    pa.array(chances[:, 0].copy()),
                    pa.array((chances >= 0.5).sum(axis=1).astype(np.int32)),
                ],
                ["doc_id", "severity", "p_toxic", "grade"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = read.mapInArrow(task, "doc_id long, severity double, p_toxic double, grade int")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "severity",
        "p_toxic",
        "grade",
        (F.col("p_toxic") >= model.cut).cast("int").alias("toxic"),
    )


def grade_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit(docs, labels))
