from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from curbside.llm import mixing
from tests.llm import helpers as h


def targets(sizes):
    """Sharing out by hand: caps, the excess again by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            got |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            got[s] = 2.0 * sizes[s]
            left -= got[s]
        open_ -= full
    return got


def mixed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    return mixing.mix_sources(df)


def corpus(seed, n=600):
    rng = random.Random(seed)
    sources = [f"s{i}" for i in range(7)] + [None, "É", "z"]
    return [
        (i, "x " * int(rng.lognormvariate(4, 1)), "hot" if rng.random() < 0.35 else rng.choice(sources))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(2))
def test_targets_and_words_taken(spark, seed):
    docs = corpus(seed)
    rows = mixed(spark, docs).collect()
    assert len(rows) == len(docs)
    words = {i: len(t.split()) for i, t, _ in docs}
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, _, s in docs:
        sizes[s] += words[i]
        largest[s] = max(largest[s], words[i])
    want = targets(sizes)
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
        assert sum(r["rate"] * r["size"] for r in rows if r["source"] == s) == pytest.approx(want[s], rel=1e-6)


def test_rates_are_an_exponential_tilt_by_size(spark):
    """log(rate / (2 - rate)) is proportional to the size within a source."""
    ratio = defaultdict(set)
    for r in mixed(spark, corpus(5)).collect():
        if r["size"] and 0 < r["rate"] < 2 - 1e-9:
            ratio[r["source"]].add(round(math.log(r["rate"] / (2 - r["rate"])) / r["size"], 9))
    assert ratio and all(max(x) - min(x) < 1e-7 for x in ratio.values())


def test_reruns_agree_whatever_the_partitions(spark):
    docs = corpus(3, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    columns = ("doc_id", "taken")
    assert h.rows(mixing.mix_sources(df), *columns) == h.rows(mixing.mix_sources(df.repartition(7)), *columns)


def test_many_equal_sizes_are_taken_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    docs = [(i, "a b c", "copies") for i in range(500)] + [(1000 + i, "a " * (i + 1), "other") for i in range(40)]
    docs += [(2000 + i, "a " * 30, "third") for i in range(60)]
    rows = mixed(spark, docs).collect()
    for s in ("copies", "other", "third"):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_awkward_rows(spark):
    df = h.awkward(spark)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == df.count()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix_sources(h.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0)] * 2


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix_sources(h.documents(spark, ["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
