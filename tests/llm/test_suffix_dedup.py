from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from curbside.llm import suffix_dedup as sd
from curbside.llm.text import Hasher
from tests.llm import helpers as h


def brute(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    datas = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + 200] for d in datas for i in range(len(d) - 199))
    out = []
    for d in datas:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(d, gone, strict=False) if not g)
        spans = int((np.diff(np.append(False, gone[:-1]).astype(int)) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.choice([20, 40, 41, 60, 120]))) for _ in range(8)]
    texts = []
    for _ in range(60):
        text = ""
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                passage = rng.choice(passages)
                text += passage[rng.randint(0, 40) : len(passage) - rng.randint(0, 40)]
            elif kind < 0.45:
                text += "ab" * rng.randint(50, 300)
            elif kind < 0.5:
                text += "x" * rng.randint(100, 500)
            else:
                text += " ".join(rng.choices(words, k=rng.randint(1, 80)))
        texts.append(text)
    return [*texts, *texts[:8], None, ""]


def removed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return [tuple(r)[1:] for r in sorted(sd.remove_repeats(df).collect())]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    texts = corpus(seed)
    assert removed(spark, texts) == brute(texts)


@pytest.mark.parametrize("bucket", [1, 3, 20])
def test_runs_cross_bucket_boundaries(spark, monkeypatch, bucket):
    monkeypatch.setattr(sd, "BUCKET", bucket)
    texts = corpus(7)
    assert removed(spark, texts) == brute(texts)


def test_hot_passage_fills_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sd, "BUCKET", 10)
    rng = random.Random(3)
    letters = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    hot, line = letters(230), letters(90)
    texts = [letters(rng.randint(0, 300)) + hot + letters(rng.randint(0, 300)) for _ in range(60)]
    # A line too short to be a passage, whose tokens all of these share.
    texts += [letters(150) + line + letters(150) for _ in range(60)]
    texts += [t[40:-40] for t in texts[60:75]]
    assert removed(spark, texts) == brute(texts)


def test_multikey_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2, (700, 16)).astype(np.uint8)
    rows[:, :6] = 7
    rows[100:200] = rows[0]
    order = sd.multikey_order(rows.view(">u8").astype(np.uint64))
    got = [bytes(rows[i]) for i in order]
    assert sorted(order.tolist()) == list(range(700)) and got == sorted(map(bytes, rows))
    common = sd.common_prefixes(rows, order)
    want = [next((k for k in range(16) if a[k] != b[k]), 16) for a, b in zip(got, got[1:], strict=False)]
    assert common.tolist() == [0, *want, 0]


def test_bytes_beyond_a_text_are_not_zeros_of_another(spark):
    rng = random.Random(4)
    body = "".join(rng.choices("abcdef", k=180))
    texts = [body + "\0" * 30, body + "\0" * 25 + "x", "\0" * 30 + body, "\0" * 10 + body + "y" * 10, body]
    assert removed(spark, texts) == brute(texts)


def test_two_texts_with_one_short_hash(spark, monkeypatch):
    """Texts are told apart by more than the hash that names them for the count."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(sd.F, "xxhash64", lambda *c: F.lit(5).cast("long") if len(c) == 1 else real(*c))
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdef", k=k)) for k in (300, 400, 250)]
    texts += [texts[0][:250] + "z" * 90, texts[1]]
    got, want = removed(spark, texts), brute(texts)
    assert [got[i] for i in (1, 2, 4)] == [want[i] for i in (1, 2, 4)]


def test_at_the_length(spark):
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh", k=200))
    for cut, gone in ((0, 200), (1, 0)):
        texts = [f"1{passage}2", f"3{passage[cut:]}4"]
        assert [r[1] for r in removed(spark, texts)] == [gone, gone]
    assert [r[1] for r in removed(spark, [passage[:199]] * 3)] == [0, 0, 0]
    # Overlapping repeats inside one text.
    assert removed(spark, ["z" * 201]) == brute(["z" * 201])


def test_segments_of_long_texts_choose_the_same_tokens(monkeypatch):
    data = np.frombuffer("".join(random.Random(2).choices("abc ", k=30_000)).encode(), np.uint8)
    offsets = np.array([0, 20_000, 20_050, 30_000])
    whole = sd.chosen(data, offsets, Hasher())
    monkeypatch.setattr(sd, "SEGMENT", 1000)
    parts = sd.chosen(data, offsets, Hasher())
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_awkward_rows(spark):
    df = h.awkward(spark)
    got = sd.remove_repeats(df).collect()
    assert len(got) == df.count()
    want = brute([r["text"] for r in df.collect()])
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert sd.remove_repeats(h.empty(spark)).count() == 0


def test_only_passages_that_reach_a_boundary_are_asked_for():
    """Of suffixes that share a hot token, those whose text goes on otherwise than that of the first and
    last suffix of the bucket ask other buckets for nothing, and equal passages are asked for once."""
    rng = np.random.default_rng(6)
    around = rng.integers(97, 123, (300, sd.AROUND)).astype(np.uint8)
    around[:, sd.BEHIND : sd.BEHIND + sd.TOKEN] = 97
    around[100:200, sd.BEHIND - 60 :] = around[100, sd.BEHIND - 60 :]
    full = np.full(300, sd.BEHIND), np.full(300, sd.SPAN)
    passages = sd.Bucket(around, *full).edges()
    ahead = [bytes(r[sd.BEHIND :]) for r in around]
    ends = min(ahead), max(ahead)
    common = lambda a, b: next((k for k in range(sd.SPAN) if a[k] != b[k]), sd.SPAN)
    want = set()
    for x in range(sd.WINDOW):
        of = [i for i in range(300) if max(common(ahead[i], e) for e in ends) >= sd.SPAN - x]
        want |= {(x, bytes(around[i, sd.BEHIND - x : sd.BEHIND - x + sd.SPAN])) for i in of}
    got = [(int(x), bytes(around[i, sd.BEHIND - x : sd.BEHIND - x + sd.SPAN])) for i, x in np.argwhere(passages)]
    assert set(got) == want and len(got) == len(want)
    assert len(got) < 10 * 300
