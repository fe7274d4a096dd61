"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a document come from its whole text (``quality_rules``'
measurements and ratios of them).  Trees are grown on a bounded sample of
labelled documents, level by level from histograms of binned statistics, and
flattened into arrays of split feature, threshold bin and leaf value.  Scoring
walks all documents of a batch down one tree at a time with numpy, without a
branch per document.

Null and empty texts have statistics 0 and a score like any other.  Without
labels (or with one class only) the score is the smoothed share of label 1.
Repeated and contradicting labels all count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.quality_rules import measure_texts
from curbside.llm.samples import labelled_sample, texts_of
from curbside.llm.store import fold
from curbside.llm.text import Hasher, per_text, steps, text_bytes

#: Labelled documents that the trees are grown on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, SMOOTH = 60, 4, 64, 0.15, 20, 1.0
#: Labels are learned from documents outside this fold.
FOLDS, HELD_OUT = 3, 1

STATISTICS = (
    "log_words", "word_length", "symbols", "duplicate_lines", "repeats", "line_words",
    "letters", "upper", "exclaims", "digits", "commas", "stops", "wide", "pipes",
)


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """One row of statistics per text."""
    m = {k: v.astype(np.float64) for k, v in measure_texts(data, offsets, hasher).items()}

    def count(*members: int) -> np.ndarray:
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        return per_text(table[data], offsets).astype(np.float64)

    n, chars = np.maximum(m["n_words"], 1), np.maximum(np.diff(offsets), 1)
    lines = np.maximum(m["n_lines"], 1)
    return np.stack(
        [
            np.log1p(m["n_words"]), m["word_chars"] / n, m["n_symbols"] / n, m["n_dup_lines"] / lines,
            m["n_repeat_words"] / n, m["n_words"] / lines, m["n_letters"] / chars,
            m["n_upper"] / np.maximum(m["n_letters"], 1), m["n_exclaims"] / n,
            count(*range(48, 58)) / chars, count(44) / n, count(46) / n,
            count(*range(0xC0, 0x100)) / chars, count(124) / n,
        ],
        axis=1,
    )


@dataclass
class Forest:
    """Trees as arrays: node ``i`` of a tree has the children ``2i+1``, ``2i+2``."""

    cuts: np.ndarray  # (features, bins - 1) upper bounds of the bins
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # (trees, inner nodes): bin up to which a row goes left
    value: np.ndarray  # (trees, leaves)
    start: float

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1
        ).astype(np.uint8)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        bins, every = self.binned(rows), np.arange(len(rows))
        total = np.full(len(rows), self.start)
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[every, feature[node]] > limit[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def grow(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Boosted trees for logistic loss; equal gains go to the first feature and
    bin, so reruns agree."""
    features = len(STATISTICS)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = (labels.sum() + 1) / (len(labels) + 2)
    forest = Forest(
        np.full((features, BINS - 1), np.inf),
        np.zeros((0, inner), np.int64),
        np.zeros((0, inner), np.int64),
        np.zeros((0, leaves)),
        float(np.log(share / (1 - share))),
    )
    if len(np.unique(labels)) < 2:
        return forest
    for f in range(features):
        points = np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        forest.cuts[f, : len(points)] = points
    bins = forest.binned(rows).astype(np.int64)
    cell = bins + np.arange(features) * BINS
    total = np.full(len(rows), forest.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = labels - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, BINS)
        node = np.zeros(len(rows), np.int64)
        for depth in range(DEPTH):
            first, nodes = 2**depth - 1, 2**depth
            where = ((node - first)[:, None] * (features * BINS) + cell).ravel()
            shape = (nodes, features, BINS)

            def histogram(values, where=where, shape=shape):
                spread = np.repeat(values, features)
                return np.bincount(where, spread, np.prod(shape)).reshape(shape).cumsum(axis=2)

            g, h, c = histogram(gradient), histogram(weight), histogram(np.ones(len(rows)))
            every = [x[:, :, -1:] for x in (g, h, c)]
            gain = (
                g**2 / (h + SMOOTH)
                + (every[0] - g) ** 2 / (every[1] - h + SMOOTH)
                - every[0] ** 2 / (every[1] + SMOOTH)
            )
            gain[(c < LEAST) | (every[2] - c < LEAST)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            feature[first : first + nodes] = best // BINS
            # Without a useful split all rows go left.
            limit[first : first + nodes] = np.where(useful, best % BINS, BINS)
            node = 2 * node + 1 + (bins[np.arange(len(rows)), feature[node]] > limit[node])
        leaf = node - inner
        g = np.bincount(leaf, gradient, leaves)
        value = RATE * g / (np.bincount(leaf, weight, leaves) + SMOOTH)
        total += value[leaf]
        forest.feature = np.vstack([forest.feature, feature])
        forest.limit = np.vstack([forest.limit, limit])
        forest.value = np.vstack([forest.value, value])
    return forest


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, y, features) of documents with a label."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in steps(batches):
            rows = statistics(*text_bytes(batch.column("text")), hasher)
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), values.cast(pa.list_(pa.float64()))],
                ["doc_id", "y", "features"],
            )

    return docs.mapInArrow(task, "doc_id long, y int, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Grow on at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).where("quality in (0, 1)")
    chosen = labelled_sample(known, sample, F.col("quality").cast("int").alias("y"))
    rows = sorted(_features(texts_of(chosen, docs)).collect())
    features = np.array([r["features"] for r in rows]).reshape(len(rows), len(STATISTICS))
    return grow(features, np.array([r["y"] for r in rows], np.float64))


def classify(docs: DataFrame, forest: Forest) -> DataFrame:
    """Score of each document from its whole text."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in steps(batches):
            scores = forest.score(statistics(*text_bytes(batch.column("text")), hasher))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"]
            )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "doc_id long, score double"
    )
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, fit(docs, labels))
