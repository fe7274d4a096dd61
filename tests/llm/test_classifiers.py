"""Quality trees, toxicity and language: held-out accuracy and odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from curbside.llm import language, quality_trees as qt, toxicity as tox
from curbside.llm.store import fold
from curbside.llm.text import Hasher, text_bytes
from pyspark.sql import functions as F
from tests.llm import helpers as h

BAD = ["idiot", "scum", "moron", "loser", "trash", "pathetic"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents, and labels of three quarters of them."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        words = h.prose(rng, rng.randrange(30, 200), 2000).split()
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 9)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if poor:
            words = [w + rng.choice(["%%%", "###", "***"]) for w in words]
        docs.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(not poor), int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_folds_are_the_crc_of_the_id(spark):
    got = {r["id"]: r["f"] for r in spark.range(50).select("id", fold(F.col("id"), 3).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def test_quality_on_held_out_documents(spark, labelled):
    docs, labels = labelled
    rows = qt.score_quality(docs, labels).collect()
    assert len(rows) == 900
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97


def test_held_out_labels_are_not_learned(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn(
        "quality", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert h.rows(qt.score_quality(docs, flipped)) == h.rows(qt.score_quality(docs, labels))


def test_flattened_trees_score_like_walking_them():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, len(qt.STATISTICS)))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.5)).astype(float)
    forest = qt.grow(rows, labels)
    assert np.mean((forest.score(rows) >= 0.5) == labels) > 0.98
    bins = forest.binned(rows)
    for i in range(20):
        total = forest.start
        for feature, limit, value in zip(forest.feature, forest.limit, forest.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (1 if bins[i, feature[node]] <= limit[node] else 2)
            total += value[node - len(feature)]
        assert forest.score(rows[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    one_class = qt.grow(rows, np.ones(500))
    assert np.allclose(one_class.score(rows), 501 / 502)


def test_toxicity_on_held_out_documents(spark, labelled):
    docs, labels = labelled
    rows = tox.grade_toxicity(docs, labels).collect()
    assert len(rows) == 900
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["toxic"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a for a, b in held if b]) > 0.95 and np.mean([a for a, b in held if not b]) < 0.02
    text = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    hits = {r["doc_id"]: sum(w.strip("%#*") in BAD for w in text[r["doc_id"]]) for r in rows}
    mean = lambda low, high: np.mean([r["severity"] for r in rows if low <= hits[r["doc_id"]] <= high])
    assert mean(0, 0) < 0.2 < mean(1, 3) < mean(6, 9)


def test_thresholds_are_in_order_and_share_the_weights():
    rng = np.random.default_rng(1)
    rows = [rng.integers(10, 60, 30) for _ in range(600)]
    grades = rng.choice(4, 600, p=[0.75, 0.1, 0.1, 0.05])
    rows = [np.append(r, np.ones(int(g) * 2, np.int64)) for r, g in zip(rows, grades, strict=True)]
    model = tox.fit_ordinal(rows, grades, 4)
    assert np.all(np.diff(model.thresholds) > 0) and model.weights[1] == model.weights.max() > 0
    chances = model.at_least(np.linspace(-3, 9, 50))
    assert np.all(np.diff(chances, axis=0) >= 0) and np.all(np.diff(chances, axis=1) <= 0)


def test_ordinal_gradient_steps_lower_the_loss():
    """The fit is at least as likely as thresholds alone, by the formula written out."""
    rng = np.random.default_rng(2)
    grades = np.repeat([0, 1, 2, 3], 60)
    rows = [np.concatenate([np.full(g + 1, 5), rng.integers(100, 400, 8)]) for g in grades]

    def loss(model):
        z = np.array([sum(model.weights[s] * np.log1p(c) for s, c in zip(*np.unique(r, return_counts=True), strict=True)) for r in rows])
        upto = np.concatenate([np.ones((240, 1)), model.at_least(z), np.zeros((240, 1))], axis=1)
        every = np.arange(240)
        return -np.log(np.maximum(upto[every, grades] - upto[every, grades + 1], 1e-12)).mean()

    model = tox.fit_ordinal([r for r in rows], grades, 4)
    flat = tox.Model(np.zeros(tox.SLOTS), np.log(np.array([60 / 180, 120 / 120, 180 / 60])))
    assert loss(flat) == pytest.approx(np.log(4)) and loss(model) <= loss(flat)


SENTENCES = {
    "en": "the and of to in that is was for with this from have they which",
    "de": "der die und ist nicht ein eine mit von zu auf für über sich auch",
    "fr": "le la les des est une que pour dans avec sur pas être cette très",
}


def speech(rng, lang, n):
    own = SENTENCES[lang].split()
    return " ".join(rng.choice(own) + rng.choice(["", "", "s", "t"]) for _ in range(n))


def test_language_on_held_out_documents(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, lang, rng.randrange(4, 80)), lang) for i, lang in enumerate(list(SENTENCES) * 150)]
    rows += [(1000, None, "en"), (1001, "123 456 !?", "de"), (1002, "", None), (1003, "—…", "fr"), (1004, "zzzz qqqq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in language.identify_languages(docs).collect()}
    assert len(got) == len(rows)
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows[:450] if got[i]["held_out"]]
    assert len(held) > 60 and np.mean(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002, 1003))
    assert got[1004]["lang_pred"] in SENTENCES and not got[1004]["accepted"]
    assert np.mean([got[i]["accepted"] for i in range(450)]) > 0.95


def test_trigrams_do_not_depend_on_the_texts_beside(spark):
    alone = [language.counts(*text_bytes(pa.array([t]))) for t in ("abc", "", "Déf gh")]
    both = language.counts(*text_bytes(pa.array(["abc", "", "Déf gh"])))
    assert np.array_equal(np.concatenate(alone), both)
    assert np.array_equal(both[0], language.counts(*text_bytes(pa.array(["ABC"])))[0])


def test_several_centroids_per_language():
    rng = np.random.default_rng(3)
    rows = np.zeros((90, language.SLOTS), np.float32)
    for i in range(90):
        rows[i, (i % 3) * 20 : (i % 3) * 20 + 10] = rng.integers(5, 9, 10)
    model = language.learn(rows, np.array(["x"] * 90, object))
    assert model.langs == ["x"] * 3
    assert np.all((language.unit(np.log1p(rows) * model.idf) @ model.centroids.T).max(axis=1) > 0.9)


def test_without_anything_to_learn(spark):
    df = h.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame(
        [(5, 1, 1), (5, 0, None), (5, None, 0), (4, 7, 7), (None, 1, 1), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    for labels in (none, odd):
        assert qt.score_quality(df, labels).count() == df.count()
        assert tox.grade_toxicity(df, labels).count() == df.count()
        assert qt.score_quality(h.empty(spark), labels).count() == 0
        assert tox.grade_toxicity(h.empty(spark), labels).count() == 0
    assert language.identify_languages(df).count() == df.count()
    unknown = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_languages(unknown).collect()} == {"und"}
    assert language.identify_languages(h.empty(spark)).count() == 0


def test_slots_ignore_case_and_marks():
    found, firsts = tox.slots(*text_bytes(pa.array(["Idiot, IDIOT!", None, "idiot"])), Hasher())
    assert len(set(found)) == 1 and firsts.tolist() == [0, 2, 2, 3]


def test_the_cut_catches_most_with_few_false_alarms():
    toxic = np.array([1] * 50 + [0] * 950)
    chances = np.concatenate([np.linspace(0.2, 0.9, 50), np.linspace(0.0, 0.1, 950)])
    cut = tox.toxic_cut(chances, toxic)
    assert 0.1 < cut < 0.2 and ((chances >= cut) == toxic).all()
    mixed = np.concatenate([np.linspace(0.0, 0.9, 50), np.linspace(0.0, 0.5, 950)])
    cut = tox.toxic_cut(mixed, toxic)
    alarms = np.mean(mixed[50:] >= cut)
    assert alarms <= tox.FALSE_ALARMS and np.mean(mixed[:50] >= cut) > 0.4
    assert tox.toxic_cut(chances[:50], toxic[:50]) == 0.5 == tox.toxic_cut(np.zeros(0), np.zeros(0))


def test_toxicity_is_the_formula_over_the_words(spark, labelled):
    """Every probability written out from words, weights and thresholds."""
    docs, labels = labelled
    model = tox.fit(docs, labels)
    hasher = tox.Hasher()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < model.cut < 1 and (np.diff(model.thresholds) > 0).all()
    for r in tox.score_toxicity(docs, model).collect():
        data = np.frombuffer(text[r["doc_id"]].encode(), np.uint8)
        found, _ = tox.slots(data, np.array([0, len(data)]), hasher)
        slot, count = np.unique(found, return_counts=True)
        z = sum(float(model.weights[s]) * np.log(1 + c) for s, c in zip(slot, count))
        chances = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert r["severity"] == pytest.approx(sum(chances), abs=1e-4)
        assert r["p_toxic"] == pytest.approx(chances[0], abs=1e-4) and r["toxic"] == (r["p_toxic"] >= model.cut)


def test_language_scores_are_the_cosines_written_out(spark):
    from curbside.llm import language as la

    rng = np.random.default_rng(5)
    texts = ["the " + "".join(rng.choice(list("abcdet  "), 80)) for _ in range(40)] + ["der " + "".join(rng.choice(list("nuzwvk  "), 80)) for _ in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    rows = la.counts(data, np.cumsum([0, *map(len, texts)]))
    model = la.learn(rows, np.array(["en"] * 40 + ["de"] * 40))
    for row in rows[:5]:
        vector = np.log(1 + row) * model.idf
        vector = vector / np.sqrt((vector**2).sum())
        cosines = [float(vector @ c) / float(np.sqrt(c @ c)) for c in model.centroids]
        assert model.langs[int(np.argmax(cosines))] == "en"
        assert la.unit(np.log1p(row[None]) * model.idf)[0] @ model.centroids.T == pytest.approx(cosines, abs=1e-4)
