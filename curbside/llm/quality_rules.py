"""Quality rules as a ledger of bits: every rule is evaluated once, its failure
is one bit beside the measurements, and policies are masks over the bits.

A policy (a named, versioned set of rules) or an ablation (the policy without
one rule) then costs a bitwise test on the ledger, not another reading of the
texts.

Null or blank text: no words, every measurement 0, fails ``few_words``.  A null
``doc_id`` keeps its row.  Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.text import SPACE, Hasher, mix, per_text, runs_of_words, steps, text_bytes, words

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_letters",
    "n_upper",
    "n_exclaims",
)

#: Rule: SQL condition under which a document fails.  A rule's bit is its place
#: in this list, for ever: new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("shouting", "10 * n_upper > 6 * n_letters"),
    ("exclaims", "10 * n_exclaims > 3 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
)
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}

#: Policy: the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
    "v2-short-texts": tuple(name for name, _ in RULES if name != "few_words"),
}


def _table(members: Iterable[int]) -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[list(members)] = 1
    return found


def _later(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key comes earlier."""
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    return later


def _shared(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key comes anywhere else."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[place] == keys


def measure_texts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    starts, ends, firsts = words(data, offsets)
    sums = hasher.sums(data)
    point = ((data & 0xC0) != 0x80) & ~SPACE[data]

    # Lines: after each line feed and at each text a new one begins.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    text = np.searchsorted(offsets, begin, side="right") - 1
    finish = np.minimum(
        np.append(begin[1:], len(data)), offsets[text + 1] if len(begin) else begin
    )
    closed = (finish > begin) & (data[np.maximum(finish - 1, 0)] == 10) if len(begin) else begin
    finish = finish - closed
    spoken = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    begin, finish, text = begin[spoken], finish[spoken], text[spoken]
    salt = mix(text.astype(np.uint64) + np.uint64(1))
    earlier = _later(mix(hasher.ranges(sums, begin, finish) ^ salt))

    # Words in runs of three that the text holds more than once.
    runs, where = runs_of_words(hasher.ranges(sums, starts, ends), firsts, 3)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))[where]
    again = _shared(mix(runs ^ mix(owner.astype(np.uint64) + np.uint64(1))))
    repeated = np.zeros(len(starts), np.int64)
    for place in range(3):
        repeated[where[again] + place] = 1

    upper, lower = _table(range(65, 91)), _table(range(97, 123))
    size = len(offsets) - 1
    return {
        "n_words": np.diff(firsts),
        "word_chars": per_text(point, offsets),
        "n_symbols": per_text(_table(SYMBOLS)[data], offsets),
        "n_dup_lines": np.bincount(text[earlier], minlength=size),
        "n_repeat_words": per_text(repeated, firsts),
        "n_lines": np.bincount(text, minlength=size),
        "n_letters": per_text((upper + lower)[data], offsets),
        "n_upper": per_text(upper[data], offsets),
        "n_exclaims": per_text(_table(b"!")[data], offsets),
    }


def measurements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and measurements of each document, from its whole text."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in steps(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            found = measure_texts(data, offsets, hasher)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)],
                ["doc_id", *MEASURES],
            )

    schema = ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)])
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(task, schema)


def failure_bits(rules: Iterable[tuple[str, str]] = RULES, inside: str = "") -> Column:
    """Bits of the rules that the measurements fail; they are columns, or fields
    of the column ``inside``."""
    bits = F.lit(0).cast("long")
    for place, (_, fails) in enumerate(rules):
        if inside:
            fails = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{inside}`.\1", fails)
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << place)).otherwise(0).cast("long"))
    return bits


def measured(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """The documents, all columns, with their measurements as a struct beside them."""
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in steps(batches, text):
            found = measure_texts(*text_bytes(batch.column(text)), hasher)
            fields = [pa.array(found[m].astype(np.int64)) for m in MEASURES]
            struct = pa.StructArray.from_arrays(fields, fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    struct = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return docs.mapInArrow(task, T.StructType([*docs.schema, T.StructField(name, struct)]))


def keep_passing(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents, all columns, that the base rules and the policy keep.  They
    stay where they are: nothing is joined."""
    name = "measured"
    while name in docs.columns:
        name += "_"
    failed = failure_bits(inside=name)
    passing = failed.bitwiseAND(F.lit(mask("base") | mask(policy))) == 0
    return measured(docs, name).where(passing).drop(name)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and failure bits of each document."""
    return measurements(docs, key, text).withColumn("failed", failure_bits())


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether none of the policy's rules failed."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(kept: DataFrame) -> DataFrame:
    """Per policy and rule, from a ledger: documents that fail the rule, and
    those that would come back without it (no other rule of the policy fails).

    The ledger is first counted per distinct bits, at most 2^rules rows.
    """
    counts = kept.groupBy("failed").agg(F.count("*").alias("n"))
    rows = [(p, r, mask(p), BIT[r]) for p, names in POLICIES.items() for r in names]
    cases = kept.sparkSession.createDataFrame(rows, "policy string, rule string, mask long, bit long")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return (
        counts.join(F.broadcast(cases), F.col("failed").bitwiseAND(F.col("bit")) != 0)
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("fails"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        )
    )


def apply_policy(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """Digest columns of each document and the policy's verdict."""
    return ledger(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes("base")).alias("base_failed"),
        (passes("base") & passes(policy)).alias("kept"),
        "failed",
    )
