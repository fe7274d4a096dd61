from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from curbside.llm import quality_rules as qr
from curbside.llm.text import Hasher, text_bytes
from tests.llm import helpers as h

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(runs)
    covered = {i + k for i, run in enumerate(runs) if count[run] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n\t\r\x0b |#ßX!"), max_size=60)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_measurements_are_the_definition(texts):
    found = qr.measure_texts(*text_bytes(pa.array(texts, pa.string())), Hasher())
    got = list(zip(*(found[m].tolist() for m in qr.MEASURES[:5]), strict=True))
    assert got == [brute(t) for t in texts]


def test_verdicts(spark):
    rng = random.Random(1)
    clean = h.prose(rng, 120)
    texts = [
        clean, h.prose(rng, 49), "spam and eggs " * 40, " ".join(w + "%%%" for w in clean.split()),
        "\n".join(["one line of text again " + str(i % 2) for i in range(10)]) + "\n" + clean,
        clean.upper(), " ".join(w + "!!" for w in clean.split()), None, "",
    ]
    got = {r["doc_id"]: r for r in qr.apply_policy(h.documents(spark, texts)).collect()}
    assert [i for i in got if got[i]["base_failed"]] and {i for i in got if got[i]["base_failed"]} == {1, 2, 7, 8}
    assert {i for i in got if got[i]["kept"]} == {0}
    assert got[4]["failed"] == qr.BIT["duplicate_lines"] and got[4]["n_dup_lines"] == 8
    assert got[3]["failed"] == qr.BIT["symbols"] and got[5]["failed"] == qr.BIT["shouting"]
    assert qr.BIT["few_words"] & got[7]["failed"]
    kept = qr.keep_passing(h.documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0]


def test_policies_and_ablations_come_from_the_bits_alone(spark):
    bits = [0, 1, 1, 3, 4, 4, 4, 5]
    ledger = spark.createDataFrame([(b,) for b in bits], "failed long")
    got = {(r["policy"], r["rule"]): (r["fails"], r["only_this"]) for r in qr.ablations(ledger).collect()}
    assert got["base", "few_words"] == (4, 3) and got["base", "repeated_words"] == (1, 0)
    assert got["v1", "few_words"] == (4, 2) and got["v1", "symbols"] == (4, 3)
    assert ("v2-short-texts", "few_words") not in got
    assert ledger.where(qr.passes("v2-short-texts")).count() == 3


def test_awkward_rows(spark):
    df = h.awkward(spark)
    rows = qr.apply_policy(df).collect()
    assert len(rows) == df.count()
    long = next(r for r in rows if r["doc_id"] == 5)
    assert long["n_words"] == 60_000 and long["n_repeat_words"] == 60_000 and not long["kept"]
    kept = qr.keep_passing(df)
    assert kept.columns == df.columns and kept.count() == 0
    assert kept.schema == df.schema
    assert qr.apply_policy(h.empty(spark)).count() == 0 and qr.keep_passing(h.empty(spark)).count() == 0
    assert qr.ablations(qr.ledger(h.empty(spark)).select(F.col("failed"))).count() == 0
