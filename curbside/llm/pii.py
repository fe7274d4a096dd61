"""Personal data in whole texts, disguises included, at offsets of the source.

The plain forms (``find_plain``) are found in the text as it stands.  Disguised
ones are found by transducers: look-alike characters, spelled digits and
written-out "at" and "dot" are rewritten, each output character remembers the
source characters it came from, the plain forms are searched in the rewritten
text, and what is found there is mapped back.  Plain spans always stay.  A
disguised span is added where it touches none, or holds all it touches and more
(the plain form had seen a part of it).

All searches are linear in the text: they start at the sign that every form must
hold ("@", a digit run, "+") and never go over the same characters again for
another start.

Null or empty text: no spans.  Equal texts give equal rows.  Offsets count code
points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = sum(map(int, digits[-1::-2]))
    total += sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find_plain(text: str) -> list[Span]:
    """Spans of the plain forms, leftmost and not overlapping within a kind."""
    found: list[Span] = []
    end = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        # The local part reaches left as far as its characters go, but not into
        # the address before it.
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            found.append((start, 0, end))
    for m in IP.finditer(text):
        parts = (part.lstrip("0") for part in m[0].split("."))
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other scripts that look like a Latin one.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J",
    "Ѕ": "S", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g",
    "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Blanks and dashes of any width.
BLANKS = "              　"
DASHES = "‐‑‒–—―−"

# Digits in words, by value.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}

#: A text without any of these words holds no spelled number.
DIGITS_SPELLED = frozenset(DIGIT_WORDS) | {"plus"}

#: May hide one: blanks and invisible characters, dotless i, script g, and the
#: scripts, dashes and wide forms that have look-alikes or digits.
ODD = re.compile(
    "[ ­ıɡͰ-᳿ -―․  ⁠−"
    "　。﹒﹫﻿！-｡\U0001d7ce-\U0001d7ff]"
)
DIGIT_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: A digit word beside a digit or another digit word, or a plus before a digit;
#: written-out dots are dots by then.
SPOKEN = re.compile(
    rf"(?i)\b{DIGIT_WORD}\b[ ,.()+-]++(?:(?:{DIGIT_WORD}|double|triple)\b|[0-9])"
    rf"|[0-9][ ,.()+-]++(?:(?:double|triple)[ -]+)?{DIGIT_WORD}\b|\bplus +[0-9]"
)
BRACKETED = re.compile(r"(?i)[(\[{<]\s*(?:at|@|arroba|dot|punkt|point|punto|\.)\s*[)\]}>]")
#: Marks that may stand beside spelled digits, to blanks.
GAPS = str.maketrans(",.-()+", "      ")

#: Written-out signs; a bare word counts between words only, and "at" only where
#: a written-out dot follows the next word, which may hold dots.
SIGNS = re.compile(
    r"(?i)(?P<at>\s*[(\[{<]\s*(?:at|@|arroba)\s*[)\]}>]\s*"
    r"|(?<=[a-z0-9]) +at +(?=[a-z0-9-]++(?:\.[a-z0-9-]++)*+(?: +dot +| *[(\[{<] *(?:dot|\.) *[)\]}>] *)[a-z]))"
    r"|(?P<dot>\s*[(\[{<]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}>]\s*|(?<=[a-z0-9]) +dot +(?=[a-z0-9]))"
)
SPELLED = re.compile(
    rf"(?i)\b(?:(?P<times>double|triple)[ -]+)?(?P<digit>{DIGIT_WORD})\b(?P<gap>[ ,.-]+(?=(?:double|triple|{DIGIT_WORD})\b|[0-9]))?"
    rf"|\bplus\b[ ]*(?=(?:{DIGIT_WORD})\b|[0-9])"
)


class Traced:
    """A text and, for each character, the source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start: Sequence[int] = range(len(text))
        self.end: Sequence[int] = range(1, len(text) + 1)

    def copy(self) -> Traced:
        other = Traced(self.text)
        other.start, other.end = self.start, self.end
        return other

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Put each text in place of its range; ranges in order, not empty."""
        text, start, end, done = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[done:a], new]
            start += [*self.start[done:a], *[self.start[a]] * len(new)]
            end += [*self.end[done:a], *[self.end[b - 1]] * len(new)]
            done = b
        self.text = "".join([*text, self.text[done:]])
        self.start = [*start, *self.start[done:]]
        self.end = [*end, *self.end[done:]]


def look_alike(char: str) -> str:
    """The plain character for one that looks like it."""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if char in INVISIBLE:
        return ""
    if char in BLANKS:
        return " "
    if char in DASHES:
        return "-"
    value = unicodedata.decimal(char, None)
    if value is not None:
        return str(value)
    return chr(ord(char) - 0xFEE0) if 0xFF01 <= ord(char) <= 0xFF5E else char


def spelled_edits(text: str, keep_dots: bool = False) -> Iterator[tuple[int, int, str]]:
    """Digits for their words; a gap between two goes, but with ``keep_dots`` not one
    that is a dot, which parts the numbers of an address.  A last "un" after a numeral
    and a blank is an article."""
    for m in SPELLED.finditer(text):
        if m["digit"]:
            lone = m["digit"].lower() == "un" and not (m["times"] or m["gap"])
            ahead = text[max(m.start() - 4, 0) : m.start()]
            if lone and ahead.endswith(" ") and ahead.rstrip(" ,.-")[-1:].isdigit():
                continue
            count = {"double": 2, "triple": 3}.get((m["times"] or "").lower(), 1)
            end = m.end("digit") if keep_dots and m["gap"] == "." else m.end()
            yield m.start(), end, DIGIT_WORDS[m["digit"].lower()] * count
        else:
            yield m.start(), m.end(), "+"


def find_disguised(text: str) -> list[Span]:
    """Spans found only in the rewritten text, at their source offsets."""
    odd = not text.isascii() and ODD.search(text)
    plain = Traced(text) if odd else None
    if plain:
        plain.rewrite((m.start(), m.end(), look_alike(m[0])) for m in ODD.finditer(text))
    traced = plain or Traced(text)
    found: set[Span] = set()

    def take(traced: Traced) -> None:
        for a, kind, b in find_plain(traced.text):
            found.add((traced.start[a], kind, traced.end[b - 1]))

    if odd:
        take(traced)
    if " dot " in traced.text.lower() or BRACKETED.search(traced.text):
        traced.rewrite(
            (m.start(), m.end(), "@" if m["at"] else ".") for m in SIGNS.finditer(traced.text)
        )
        take(traced)
    now = traced.text
    # The sets of words are cheaper than the search, and most texts end there.
    words = now.lower().translate(GAPS).split()
    if not DIGITS_SPELLED.isdisjoint(words) and SPOKEN.search(now):
        with_dots = list(spelled_edits(now, keep_dots=True))
        without = list(spelled_edits(now))
        if with_dots != without:
            copy = traced.copy()
            copy.rewrite(with_dots)
            take(copy)
        traced.rewrite(without)
        take(traced)
    return sorted(found)


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans."""
    base = find_plain(text)
    spans = list(base)
    for span in sorted(find_disguised(text), key=lambda s: (s[0] - s[2], s)):
        touched = [(a, b) for a, _, b in spans if a < span[2] and span[0] < b]
        if all(span[0] <= a and b <= span[2] and (a, b) != span[::2] for a, b in touched):
            spans.append(span)
    return base, sorted(spans)


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def mask(text: str, spans: Iterable[Span]) -> str:
    """The text with a tag in place of each span; overlapping spans are one, named
    after the first."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts and digest of the plain spans, and all spans.

    ``n_email`` to ``n_phone`` count plain spans, as the digest does; ``n_added``
    counts the disguised ones beside them.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for content in batch.column("text"):
                base, spans = find_all(content.as_py() or "")
                kinds = [kind for _, kind, _ in base]
                for place in range(4):
                    rows[place].append(kinds.count(place))
                rows[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                rows[5].append(written(spans))
                rows[6].append(len(spans) - len(base))
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(r, k) for r, k in zip(rows, kinds_of, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_added"]
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, n_added long"
    )
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(task, schema)


def mask_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data in the text replaced by tags; the other
    columns, and null texts, stay."""

    @F.pandas_udf("string")
    def masked(column):
        return column.map(lambda x: x if x is None else mask(x, find_all(x)[1]))

    return docs.withColumn(text, masked(F.col(text)))
