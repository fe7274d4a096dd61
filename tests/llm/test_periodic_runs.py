from __future__ import annotations

import hashlib
import random
from zlib import crc32

import numpy as np
from hypothesis import given, settings, strategies as st

from curbside.llm import periodic_runs as pr
from curbside.llm.queries import QUERIES
from curbside.session import fresh_path
from tests.llm import helpers as h


def brute(words, least=pr.LEAST):
    """Every period on its own, the smallest for each stretch."""
    found, size = {}, len(words)
    for q in range(1, size // 2 + 1):
        j = 0
        while j + q < size:
            start = j
            while j + q < size and words[j] == words[j + q]:
                j += 1
            if j + q - start >= max(least, 2 * q):
                found.setdefault((start, j + q), q)
            j += 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def with_loops(rng, size, kinds):
    words = [b"%d" % rng.randrange(kinds) for _ in range(size)]
    for _ in range(rng.randrange(3)):
        a = rng.randrange(size + 1)
        unit = words[a : a + 1 + rng.randrange(9)] or [b"x"]
        words[a:a] = (unit * 40)[: rng.randrange(50)]
    return words


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 70), st.sampled_from([1, 2, 3, 6, 50]))
def test_runs_are_those_of_brute_force(seed, size, kinds):
    words = with_loops(random.Random(seed), size, kinds)
    assert pr.runs_of(words) == brute(words)
    # Short runs come out of the automaton too; nothing is found by the filter alone.
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = [numbers[w] for w in words]
    assert pr.runs_in(codes, 2) == brute(words, 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_squares_are_those_of_brute_force(codes):
    """For each last word all periods of primitive roots."""
    found = {(i, q) for i, q in pr.squares(codes)}
    for i in range(len(codes)):
        for q in range(1, (i + 1) // 2 + 1):
            root = codes[i - q + 1 : i + 1]
            square = codes[i - 2 * q + 1 : i - q + 1] == root
            primitive = not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q))
            assert ((i, q) in found) >= (square and primitive) and square >= ((i, q) in found)


def test_the_link_cut_paths_carry_the_last_ends():
    rng = random.Random(4)
    codes = [rng.randrange(3) for _ in range(200)]
    link, longest, prefix = pr.automaton(codes)
    paths, last = pr.Paths(link), {}
    for i, state in enumerate(prefix):
        passed = dict(paths.access(state, i))
        at, seen = state, []
        while at:
            seen.append(last.get(at, -1))
            last[at] = i
            at = link[at]
        # Each colour once, upwards; states never passed before are paths of their own.
        coloured = [c for c in passed.values() if c >= 0]
        assert coloured == [c for c in dict.fromkeys(seen) if c >= 0]


def test_stretches_lose_no_run():
    rng = random.Random(8)
    for _ in range(200):
        words = with_loops(rng, rng.randrange(200), 400)
        codes = np.array([int(w) if w != b"x" else 999 for w in words], np.uint64)
        held = list(pr.stretches(pr.mix(codes)))
        assert all(any(a <= s and s + n <= b for a, b in held) for s, n, _ in brute(words))


def test_long_loops_are_found_whole():
    unit = [b"%d" % i for i in range(700)]
    words = [b"head", *unit * 30, *unit[:350], b"tail"]
    assert pr.runs_of(words) == [(1, 700 * 30 + 350, 700)]
    assert pr.runs_of([b"a"] * 30_000) == [(0, 30_000, 1)]
    assert pr.kept_words(words, pr.runs_of(words)) == [b"head", *unit, b"tail"]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    share = 1000 * best[1] // best[2] if runs else None
    digests = [
        hashlib.sha256(x).hexdigest()
        for x in ("".join("%d,%d,%d\n" % r for r in runs).encode(), b" ".join(kept))
    ]
    return doc_id, len(runs), *best, share, *digests, n, n - len(kept)


def test_the_query_on_a_small_table(spark):
    rng = random.Random(3)
    texts = [b" ".join(with_loops(rng, rng.randrange(60), 7)).decode() for _ in range(300)]
    texts += ["a b c d e f " * 3, "é\u00a0ü x " * 9, "one\n\ttwo \x0b" * 8, None, "", "  "]
    path = fresh_path(spark, "tables")
    h.documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    got = h.rows(QUERIES["op12_periodic_runs"](spark, path))
    assert got == sorted((expected(i, t) for i, t in enumerate(texts)), key=str)
    assert sum(r[1] > 0 for r in got) > 40


def test_awkward_rows(spark):
    df = h.awkward(spark)
    got = h.rows(pr.digest_runs(df))
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == df.count()
    assert [r for r in got if r[0] in (1, 2, 3)] == [(i, 0, None, None, None, None, empty, empty, 0, 0) for i in (1, 2, 3)]
    (long,) = [r for r in got if r[0] == 5]
    assert long[1:6] == (1, 0, 60_000, 977, 61_412) and long[9] == 60_000 - 977
    assert len({r for r in got if r[0] == 6}) == 2 and sum(r[0] is None for r in got) == 2
    assert pr.digest_runs(h.empty(spark)).count() == 0


def test_runs_and_texts_without_loops(spark):
    docs = h.documents(spark, ["x " + "a b c " * 5 + "y", "nothing\tto  do", None])
    assert h.rows(pr.find_runs(docs)) == [(0, 1, 15, 3)]
    assert h.rows(pr.without_loops(docs)) == [(0, "x a b c y"), (1, "nothing\tto  do"), (2, None)]
    assert h.rows(pr.find_runs(docs, 16)) == []
