from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from curbside.llm import pii
from tests.llm import helpers as h

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checked(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    """The definition, word for word."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [
        (m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))
    ]
    found += [
        (m.start(), 2, m.end())
        for m in CARD.finditer(text)
        if 12 <= len(digits(m[0])) <= 19 and checked(digits(m[0]))
    ]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab1409.@+-() %é"), max_size=60))
def test_plain_forms_are_the_definition(text):
    assert pii.find_plain(text) == base(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("01245. "), max_size=80))
def test_plain_numbers_are_the_definition(text):
    assert pii.find_plain(text) == base(text)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("john.doe (at) example (dot) com", "email"),
        ("john[at]mail[dot]org", "email"),
        ("JOHN AT EXAMPLE DOT COM", "email"),
        ("jane at example dot co dot uk", "email"),
        ("jоhn@exаmple.com", "email"),  # Cyrillic o and a
        ("joe​@exa­mple.com", "email"),
        ("ｊｏｅ＠ｍａｉｌ．ｃｏｍ", "email"),
        ("＋１ (０１７) ５５５-７７１３", "phone"),
        ("plus four four two zero seven nine four six zero nine five eight", "phone"),
        ("four four one seven seven four four two eight zero three five one five four seven", "card"),
        ("10 dot 0 dot 0 dot 1", "ip"),
        ("+1 (017) 555‑7713", "phone"),  # non-breaking hyphen
    ],
)
def test_disguises_are_found_at_their_place(text, kind):
    around = f"Write to:  {text}  soon, é."
    spans = pii.find_all(around)[1]
    start = around.index(text)
    assert (start, pii.KINDS.index(kind), start + len(text)) in spans
    assert text not in pii.mask(around, spans) and pii.mask(around, spans).endswith("soon, é.")


@pytest.mark.parametrize(
    "text,kind",
    [
        ("+49 170 five 23 four 567", "phone"),
        ("+1 four 1 five 5 five 2 six 7 one 0", "phone"),
        ("plus 49 170 523 4567", "phone"),
        ("192 dot 168 dot 1 dot five", "ip"),
        ("192(dot)168(dot)1(dot)five", "ip"),
        ("one nine two dot one six eight dot one dot five", "ip"),
        ("4 four 1 seven 7442 8 zero 3 five 1 five 4 seven", "card"),
        ("jane at mail.example dot com", "email"),
    ],
)
def test_words_and_numerals_may_mix(text, kind):
    around = f"Write to:  {text}  soon, é."
    assert pii.find_all(around)[1] == [(11, pii.KINDS.index(kind), 11 + len(text))]


@pytest.mark.parametrize("text", ["in 2019 one of 12 came", "a plus 5 or two. 3 more", "look at mail.example and dot it"])
def test_clean_texts_with_numbers_are_left_alone(text):
    assert pii.find_all(text) == ([], [])


def test_an_article_after_a_number_is_none_of_it():
    assert pii.find_all("+1 (848) 555-1373 Un jour")[1] == [(0, 3, 17)]


@pytest.mark.parametrize(
    "text",
    [
        "look at example.com today", "meet at noon", "one two three four", "the dot is at the end",
        "un deux trois", "version 1.2.3", "in [at] out", "Здравствуйте, мир", "", "at dot at dot",
    ],
)
def test_clean_texts_are_left_alone(text):
    assert pii.find_all(text) == ([], []) and pii.mask(text, []) == text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "+1" * 100_000, "1." * 100_000, "@a" * 100_000, "a" * 10 + " dot " * 50_000):
        pii.find_all(run)


def test_query_rows(spark):
    texts = ["a@b.co and 1.2.3.4", None, "", "x (at) y (dot) com", "a@b.co and 1.2.3.4"]
    got = {r["doc_id"]: r for r in pii.find_personal_data(h.documents(spark, texts)).collect()}
    assert len(got) == 5
    first = "email:0:6,ip:11:18"
    assert got[0]["spans"] == first == got[4]["spans"]
    assert got[0]["base_sha256"] == hashlib.sha256(first.encode()).hexdigest()
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_added"]) == (1, 1, 0)
    for i in (1, 2):
        assert got[i]["spans"] == "" and got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["spans"] == "email:0:18" and (got[3]["n_email"], got[3]["n_added"]) == (0, 1)


def test_awkward_rows(spark):
    df = h.awkward(spark)
    assert pii.find_personal_data(df).count() == df.count()
    masked = pii.mask_column(df)
    assert masked.columns == df.columns and h.rows(masked) == h.rows(df)
    assert pii.find_personal_data(h.empty(spark)).count() == 0
    assert pii.mask_column(h.empty(spark)).count() == 0
