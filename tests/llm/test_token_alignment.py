from __future__ import annotations

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from curbside.llm import token_alignment as ta
from curbside.llm.queries import QUERIES
from curbside.session import fresh_path
from tests.llm import helpers as h

pytestmark = pytest.mark.skipif(not os.path.isdir(ta.FOLDER), reason="no vocabularies")

TEXTS = [
    "hello world", " a  b\n\tc ", "é ü ß 日本語 x", "<|endoftext|> <s> <0x41> </s> <unk>", "nul \x00 here",
    "▁ stands for a space in one of them", "tab\tand  two\r\nlines 12345 don't", "x" * 300, "😀👩‍👩‍👧 ﬁ ½",
    "hello world", None, "", " ",
]


@pytest.fixture(scope="module")
def tools():
    return ta.Tokenizers.read()


def overlap_groups(ends_a, ends_b):
    """Connected components of tokens that share a byte, by all pairs."""
    tokens = [("a", i, s, e) for i, (s, e) in enumerate(zip([0, *ends_a], ends_a))]
    tokens += [("b", i, s, e) for i, (s, e) in enumerate(zip([0, *ends_b], ends_b))]
    pairs = [
        (x, y) for x in range(len(tokens)) for y in range(x)
        if tokens[x][0] != tokens[y][0] and tokens[x][2] < tokens[y][3] and tokens[y][2] < tokens[x][3]
    ]
    return tokens, h.components(pairs, range(len(tokens)))


cuts = st.lists(st.integers(1, 5), min_size=1, max_size=25)


@settings(max_examples=200, deadline=None)
@given(cuts, cuts)
def test_pointers_find_the_components_of_overlap(a, b):
    a[-1] += max(0, sum(b) - sum(a))
    b[-1] += max(0, sum(a) - sum(b))
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    tokens, component = overlap_groups(ends_a, ends_b)
    found = ta.align(ends_a, ends_b)
    label = [*found.group_a, *found.group_b]
    assert len(set(zip(label, component.values()))) == len(set(label)) == len(set(component.values()))
    # Groups end where both end.
    both = sorted(set(ends_a) & set(ends_b))
    assert [ends_a[i] for i in found.last_a] == both == [ends_b[i] for i in found.last_b]


def test_the_engine_gives_the_tokens_of_the_vocabulary_file(tools):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(tools.byte_level.decode())
    own.encode_special_tokens = True
    texts = [t or "" for t in TEXTS] + [f"a{chr(c)}b {chr(c)} 1{chr(c)}\n" for c in range(1, 0x3000, 7)]
    assert tools.encode(texts)[0] == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_every_token_has_bytes_and_every_link_is_possible(tools):
    assert all(tools.first_bytes) and all(tools.second_bytes)
    possible = set(ta.possible_links(tools.first_bytes, tools.second_bytes).tolist())
    for text in filter(None, TEXTS):
        a, b, links, _ = brute(tools, text)
        assert {x * len(tools.second_bytes) + y for x, y in links} <= possible
    assert len(possible) < 500_000


def brute(tools, text):
    (a,), (b,) = tools.encode([text or ""])
    whole = b" " + (text or "").encode()
    spelled = [b"".join(known[t] for t in ids) for known, ids in ((tools.first_bytes, a), (tools.second_bytes, b))]
    if not text or spelled != [whole, whole]:
        return [], [], [], []
    ends_a, ends_b = (np.cumsum([len(known[t]) for t in ids]).tolist() for known, ids in ((tools.first_bytes, a), (tools.second_bytes, b)))
    at = {}
    for y, f in zip(b, ends_b):
        at.setdefault(f, []).append(y)
    links = [(x, y) for x, e in zip(a, ends_a) for y in at.get(e, ())]
    both = sorted(set(ends_a) & set(ends_b))
    sides = [[[] for _ in both], [[] for _ in both]]
    for side, ids, ends in zip(sides, (a, b), (ends_a, ends_b)):
        k = 0
        for t, e in zip(ids, ends):
            k += e > both[k]
            side[k].append(t)
    groups = ["|".join(",".join(map(str, side[k])) for side in sides) for k in range(len(both))]
    return a, b, links, groups


def expected(tools, texts):
    parts = [brute(tools, t) for t in texts]
    counts = Counter(link for p in parts for link in p[2])
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [
        (
            i, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
        )
        for i, (a, b, links, groups) in enumerate(parts)
    ]


def test_the_query_on_a_small_table(spark, tools):
    path = fresh_path(spark, "tables")
    texts = TEXTS + [f"word{i} and token{i * i} of {chr(0x400 + i)}" for i in range(200)]
    h.documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    assert h.rows(QUERIES["op13_token_alignment"](spark, path)) == sorted(expected(tools, texts), key=str)


def test_awkward_rows(spark, tools):
    df = h.awkward(spark)
    got = h.rows(ta.digest_alignment(df))
    want = expected(tools, [r["text"] for r in df.select("text").collect()])
    ids = [r["doc_id"] for r in df.select("doc_id").collect()]
    assert got == sorted(((i, *w[1:]) for i, w in zip(ids, want, strict=True)), key=str)
    assert ta.digest_alignment(h.empty(spark)).count() == 0
