"""Small tables and brute-force versions."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0, schema=DOCUMENTS):
    rows = [
        (first + i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, schema).repartition(3)


def awkward(spark):
    """Null, empty and blank texts, a very long one, repeats of rows and ids, null ids,
    and extra columns whose names operators use inside."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, "a b c d e"), (6, "a b c d e")]
    texts += [(7, "a b c d e"), (None, "a b c d e"), (None, None), (8, "é ü\nß\n\né ü"), (6, "other text altogether")]
    rows = [(i, t, "en", None if (i or 0) % 2 else "s", 5, 1.5, "x", 7, True) for i, t in texts]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, "
        "size double, component string, n_words int, measured boolean",
    )


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}
