from __future__ import annotations

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from curbside.functions import lookups
from curbside.operators import classify as cl, evaluate as ev, split
from curbside.session import fresh_path
from curbside.sources import models


def test_requests_get_defaults_and_bad_ones_are_marked(spark):
    rows = [
        (1, "2.5", "15", "1", "ferrous"),
        (2, None, None, None, None),
        (3, "heavy", "15", "1", "ferrous"),
        (4, "1", "wet", "1", "ferrous"),
        (5, "1", "15", "1.5", "ferrous"),
        (6, " 1e1 ", "15", " 0 ", "granite"),
    ]
    raw = spark.createDataFrame(rows, "id int, weight_kg string, moisture_pct string, recyclable string, material_type string")
    cleaned = cl.clean_requests(raw)
    good, bad = cl.split_failed(cleaned)
    assert {r["id"] for r in bad.collect()} == {3, 4, 5}
    got = {r["id"]: tuple(r)[1:] for r in good.collect()}
    assert got == {
        1: (2.5, 15.0, 1, "ferrous"),
        2: (2.0, 20.0, 1, "synthetic_polymer"),
        6: (10.0, 15.0, 0, "granite"),
    }


def test_the_first_rule_wins(spark):
    rows = [
        (50.1, "ferrous"), (50.0, "ferrous"), (10.0, "synthetic_polymer"), (10.0, "cellulose"),
        (10.0, "silica"), (10.0, "biodegradable"), (10.0, "granite"), (10.0, None), (None, "ferrous"),
    ]
    df = spark.createDataFrame(rows, "moisture_pct double, material_type string").coalesce(1)
    got = [(r["predicted_type"], r["confidence"]) for r in cl.rule_classify(df).collect()]
    assert got == [
        ("Organic", 0.85), ("Metal", 0.88), ("Plastic", 0.82), ("Paper", 0.8), ("Glass", 0.78),
        ("Glass", 0.78), ("Plastic", 0.82), ("Plastic", 0.82), ("Metal", 0.88),
    ]


def test_unknown_types_get_the_plastic_advice_but_no_bin(spark):
    df = spark.createDataFrame([("Glass",), ("Mixed",), (None,)], "predicted_type string")
    got = {r["predicted_type"]: r for r in cl.with_bin(cl.recommend(df)).collect()}
    assert len(got) == 3
    assert got["Glass"]["color"] == "#06b6d4" and got["Glass"]["bin_color"] == "Teal"
    for unknown in ("Mixed", None):
        assert got[unknown]["segregation_tip"].startswith("Clean plastic items")
        assert got[unknown]["bin_color"] is None


def test_codes(spark):
    df = spark.createDataFrame([("silica",), ("granite",), (None,)], "m string")
    codes = lookups.codes(spark, lookups.MATERIALS, "m")
    coded = {r["m"]: r["code"] for r in cl.encode_category(df, "m", codes, "code", 4).collect()}
    assert coded == {"silica": 3, "granite": 4, None: 4}
    no_default = {r["m"]: r["code"] for r in cl.encode_category(df, "m", codes, "code").collect()}
    assert no_default == {"silica": 3, "granite": None, None: None}
    assert {tuple(r) for r in cl.label_codes(df, "m").collect()} == {("granite", 0), ("silica", 1)}
    many = spark.range(12_000).select(F.format_string("%05d", "id").alias("m"))
    for max_rows in (None, 10):
        codes = cl.label_codes(many, "m", max_rows)
        assert codes.filter("code <> cast(m AS bigint)").count() == 0 and codes.count() == 12_000


@pytest.mark.parametrize("kind,value,want", [
    ("double", 1.0, 1), ("double", 1.7, 1), ("bigint", 1, 1), ("int", 0, 0), ("string", "1", 1),
])
def test_numbers_are_taken_as_they_are(spark, kind, value, want):
    df = spark.createDataFrame(
        [(2.5, 10, value, "ferrous"), (None, None, None, None)],
        f"weight_kg double, moisture_pct int, recyclable {kind}, material_type string",
    )
    good, bad = cl.split_failed(cl.clean_requests(df))
    assert bad.count() == 0
    assert sorted(r["recyclable"] for r in good.collect()) == sorted([want, 1])


def test_text_that_is_no_whole_number_is_set_aside(spark):
    df = spark.createDataFrame(
        [("1", "2", x, "ferrous") for x in ("1.5", "yes", "", "1")],
        "weight_kg string, moisture_pct string, recyclable string, material_type string",
    )
    assert cl.clean_requests(df).filter("cast_failed = 1").count() == 3


def test_rows_without_a_label_are_left_out_of_training(sample):
    used = ["waste_type", "weight_kg", "moisture_pct", "recyclable", "material_type"]
    rows = sample.select(*used)
    blank = rows.limit(50).withColumn("waste_type", F.lit(None).cast("string"))
    model = cl.train_classifier(rows.unionByName(blank), cl.tree(4))
    assert "null" not in model.stages[0].labels and len(model.stages[0].labels) == 5


@pytest.fixture(scope="module")
def parted(sample):
    rows = split.stratified_split(sample, "waste_type", "id")
    rows = split.assign_folds(rows, "id")
    used = ["waste_type", "weight_kg", "moisture_pct", "recyclable", "material_type", "split", "fold"]
    return cl.collapse(rows, used)


@pytest.fixture(scope="module")
def forest_model(parted):
    return cl.train_classifier(parted.filter("split = 'train'"), cl.forest(10, 6))


def test_collapsing_keeps_every_row(sample, parted):
    assert parted.agg(F.sum(cl.WEIGHT)).first()[0] == sample.count()


def test_equal_rows_weigh_the_same_collapsed_or_not(sample):
    rows = sample.unionByName(sample).unionByName(sample)
    used = ["waste_type", "weight_kg", "moisture_pct", "recyclable", "material_type"]
    probe = sample.select("id", *used[1:])
    for classifier in (cl.tree(4), cl.logistic(rows.count(), max_iter=60)):
        plain = cl.score(probe, cl.train_classifier(rows, classifier))
        weighed = cl.score(probe, cl.train_classifier(cl.collapse(rows, used), classifier))
        same = plain.join(weighed.select("id", F.col("predicted_type").alias("other")), "id")
        assert same.filter("predicted_type <> other").count() == 0


def test_forest_beats_the_majority_and_matches_the_evaluator(parted, forest_model):
    test = parted.filter("split = 'test'")
    scored = cl.score(test, forest_model)
    confusion = ev.confusion_matrix(scored, "waste_type", "predicted_type", lookups.WASTE_TYPES, cl.WEIGHT)
    report = {r["name"]: r for r in ev.classification_report(confusion).collect()}
    assert report["accuracy"]["f1"] > 0.9
    assert report["accuracy"]["support"] == 80
    coded = forest_model.transform(test)
    for metric, name, column in (
        ("accuracy", "accuracy", "f1"),
        ("weightedPrecision", "weighted avg", "precision"),
        ("weightedRecall", "weighted avg", "recall"),
        ("f1", "weighted avg", "f1"),
    ):
        want = MulticlassClassificationEvaluator(
            labelCol="label_code", metricName=metric, weightCol=cl.WEIGHT
        ).evaluate(coded)
        assert report[name][column] == pytest.approx(want, abs=6e-5)


def test_probabilities_and_confidence(parted, forest_model):
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    total = forest_model.transform(parted).select(F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("t"))
    assert total.filter("abs(t - 1) > 1e-9").count() == 0
    assert cl.score(parted, forest_model).filter("confidence > 1 OR confidence < 0.2").count() == 0


def test_scoring_keeps_rows_with_an_unseen_label_or_material(spark, forest_model):
    df = spark.createDataFrame(
        [("Mixed", 2.0, 20.0, 1, "granite"), (None, 2.0, 20.0, 1, None)],
        "waste_type string, weight_kg double, moisture_pct double, recyclable int, material_type string",
    )
    assert cl.score(df, forest_model).count() == 2


def test_a_fixed_seed_repeats(parted, forest_model):
    again = cl.train_classifier(parted.filter("split = 'train'"), cl.forest(10, 6))
    a, b = (cl.score(parted, m).select("weight_kg", "moisture_pct", "predicted_type", "confidence") for m in (forest_model, again))
    assert a.exceptAll(b).count() == 0


def test_importance_is_a_share_per_feature(spark, forest_model):
    got = cl.feature_importance(spark, forest_model).collect()
    assert {r["feature"] for r in got} == {"weight_kg", "moisture_pct", "recyclable", "material_code"}
    assert sum(r["importance"] for r in got) == pytest.approx(1.0)
    assert [r["importance"] for r in got] == sorted((r["importance"] for r in got), reverse=True)


def test_model_is_stored_with_its_vocabulary(spark, parted, forest_model):
    path = fresh_path(spark, "model")
    calls = []

    def train():
        calls.append(1)
        return forest_model

    models.load_or_train(path, train)
    back = models.load_or_train(path, train)
    assert len(calls) == 1
    a, b = cl.score(parted, forest_model), cl.score(parted, back)
    assert a.exceptAll(b).count() == 0
    broken = fresh_path(spark, "broken")
    spark.range(1).write.parquet(broken)
    models.load_or_train(broken, train)
    assert len(calls) == 2
    assert models.load_model(broken).stages[0].labels == forest_model.stages[0].labels


def test_requests_are_classified_by_model_or_rules(spark, forest_model):
    raw = spark.createDataFrame(
        [(1, "2.5", "75", "0", "biodegradable"), (2, "x", "75", "0", "biodegradable")],
        "id int, weight_kg string, moisture_pct string, recyclable string, material_type string",
    )
    for model in (None, forest_model):
        good, bad = cl.classify_requests(raw, model)
        row = good.first()
        assert (row["predicted_type"], row["recommendation"], row["color"]) == ("Organic", "Compost", "#22c55e")
        assert [r["id"] for r in bad.collect()] == [2]


def test_models_are_compared(parted):
    n = parted.agg(F.sum(cl.WEIGHT)).first()[0]
    got = ev.compare_models(
        parted,
        {
            "tree": lambda df: cl.train_classifier(df, cl.tree(8)),
            "same tree": lambda df: cl.train_classifier(df, cl.tree(8)),
            "stump": lambda df: cl.train_classifier(df, cl.tree(1)),
            "logistic": lambda df: cl.train_classifier(df, cl.logistic(n, max_iter=100)),
        },
        k=3,
        weight=cl.WEIGHT,
    )
    rows = {r["model"]: r for r in got.collect()}
    assert len(rows) == 4
    assert rows["tree"]["cv_mean"] > 0.9 > rows["stump"]["cv_mean"]
    assert rows["tree"]["test_accuracy"] <= 1 and rows["tree"]["cv_std"] >= 0
    assert got.collect()[0]["model"] == "tree" == ev.best_model(got).first()["model"]
    # Equal models keep the order they were given in, also once the result was stored.
    assert rows["tree"]["cv_mean"] == rows["same tree"]["cv_mean"]
    assert [rows[m]["place"] for m in ("tree", "same tree")] == [1, 2]
    assert sorted(r["place"] for r in rows.values()) == [1, 2, 3, 4]


def test_scores_of_distinct_features_are_those_of_all_rows(parted):
    """Accuracies of the comparison against scoring every row."""
    train = {"tree": lambda df: cl.train_classifier(df, cl.tree(3))}
    (row,) = ev.compare_models(parted, train, k=3, weight=cl.WEIGHT).collect()

    def share(fitted, tested):
        right = F.when(F.col("waste_type") == F.col("predicted_type"), F.col(cl.WEIGHT)).otherwise(0.0)
        return cl.score(tested, train["tree"](fitted)).agg(F.sum(right) / F.sum(cl.WEIGHT)).first()[0]

    assert row["test_accuracy"] == pytest.approx(
        share(parted.filter("split = 'train'"), parted.filter("split = 'test'"))
    )
    folds = [share(parted.filter(F.col("fold") != i), parted.filter(F.col("fold") == i)) for i in range(3)]
    assert row["cv_mean"] == pytest.approx(sum(folds) / 3)


def test_parts_are_prepared_once_for_all_models(parted):
    calls = []

    def prepare(part):
        calls.append(1)
        return part

    train = {name: lambda df: cl.train_classifier(df, cl.tree(2)) for name in "abc"}
    assert ev.compare_models(parted, train, k=2, weight=cl.WEIGHT, prepare=prepare).count() == 3
    assert len(calls) == 3


def test_kept_models_are_not_fitted_again(parted):
    kept, calls = {}, []

    def prepare(part):
        calls.append(1)
        return part

    def keep(name, left_out, fit):
        if (name, left_out) not in kept:
            kept[name, left_out] = fit()
        return kept[name, left_out]

    train = {name: lambda df: cl.train_classifier(df, cl.tree(2)) for name in "ab"}
    found = [
        ev.compare_models(parted, train, k=2, weight=cl.WEIGHT, prepare=prepare, keep=keep).collect()
        for _ in range(2)
    ]
    assert found[0] == found[1] and len(calls) == 3
    assert set(kept) == {(name, run) for name in "ab" for run in ("test", "fold0", "fold1")}


def test_groups_hold_all_rows(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1, "m", "a"), (1.0, 2.0, 1, "m", "a"), (1.0, 2.0, 1, "m", "b"), (1.0, None, 1, None, "a")],
        "weight_kg double, moisture_pct double, recyclable int, material_type string, waste_type string",
    )
    groups = cl.feature_groups(df, ["waste_type"])
    got = {(r["moisture_pct"], c["waste_type"]): c[cl.WEIGHT] for r in groups.collect() for c in r["cells"]}
    assert got == {(2.0, "a"): 2.0, (2.0, "b"): 1.0, (None, "a"): 1.0} and groups.count() == 2


def tiny_model(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1, "m", "a"), (9.0, 2.0, 1, "m", "b")] * 5,
        "weight_kg double, moisture_pct double, recyclable int, material_type string, waste_type string",
    )
    return cl.train_classifier(df, cl.tree(2))


def test_a_model_is_found_by_what_it_was_made_from(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    store = models.ModelStore(spark, str(tmp_path / "store"))
    calls = []

    def train():
        calls.append(1)
        return tiny_model(spark)

    def get(**parameters):
        made_from = models.fingerprint([spark.read.parquet(path)], **parameters)
        return store.get("model", made_from, train)

    get(depth=2), get(depth=2)
    assert len(calls) == 1
    get(depth=3)
    assert len(calls) == 2
    spark.range(5).write.mode("append").parquet(path)
    get(depth=2)
    assert len(calls) == 3
    assert len(models.input_files([spark.read.parquet(path), spark.read.parquet(path)])) == len(
        spark.read.parquet(path).inputFiles()
    )


def test_a_half_written_model_is_never_read(spark, tmp_path):
    store = models.ModelStore(spark, str(tmp_path))

    def broken(folder):
        tiny_model(spark).stages[0].write().save(f"{folder}/stages/0")
        raise RuntimeError("the writer is lost")

    with pytest.raises(RuntimeError):
        store.publish("model", "x", broken)
    assert store.manifest("model", "x") is None and store.find("model", "x") is None
    # A manifest that is no manifest, or one whose folder is gone, counts as none.
    (tmp_path / "model" / "x.json").write_text("{")
    assert store.manifest("model", "x") is None
    model = store.get("model", "x", lambda: tiny_model(spark))
    assert model.stages[0].labels == ["a", "b"]
    import shutil

    shutil.rmtree(store.manifest("model", "x")["folder"])
    assert store.find("model", "x") is None
    assert store.get("model", "x", lambda: tiny_model(spark)).stages[0].labels == ["a", "b"]


def test_two_writers_of_one_model_do_no_harm(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    store, together, model = models.ModelStore(spark, str(tmp_path)), Barrier(2), tiny_model(spark)

    def write(_):
        def save(folder):
            models.save_model(model, folder)
            together.wait()

        return store.publish("model", "x", save)

    with ThreadPoolExecutor(2) as pool:
        folders = list(pool.map(write, range(2)))
    assert store.manifest("model", "x")["folder"] in folders
    assert store.find("model", "x").stages[0].labels == ["a", "b"]


def test_metrics_without_anything_to_go_by_are_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    confusion = ev.confusion_matrix(df, "y", "p", ["a", "b", "c", "d"])
    cells = {(r["label"], r["prediction"]): (r["n"], r["row_share"]) for r in confusion.collect()}
    assert len(cells) == 16
    assert cells["a", "a"] == (1, 0.5) and cells["d", "d"] == (0, 0.0)
    report = {r["name"]: tuple(r)[1:] for r in ev.classification_report(confusion).collect()}
    assert report["c"] == (0.0, 0.0, 0.0, 1)
    assert report["d"] == (0.0, 0.0, 0.0, 0)
    assert report["a"] == (0.5, 0.5, 0.5, 2)
    assert report["accuracy"][2] == 0.5


def test_labels_outside_the_declared_classes_are_counted(spark):
    df = spark.createDataFrame([("z", "a"), (None, "a")], "y string, p string")
    confusion = ev.confusion_matrix(df, "y", "p", ["a"])
    assert confusion.agg(F.sum("n")).first()[0] == 2
    assert ev.accuracy(df, "y", "p").first()["n"] == 2


def test_regression_metrics_match_the_evaluator(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.5, 4.0), (3.0, 1.0)], "y double, p double")
    r = ev.regression_metrics(df, "y", "p").first()
    for name in ("rmse", "r2"):
        want = RegressionEvaluator(labelCol="y", predictionCol="p", metricName=name).evaluate(df)
        assert r[name] == pytest.approx(want, abs=6e-5)
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0)], "y double, p double")
    assert ev.regression_metrics(flat, "y", "p").first()["r2"] is None


def test_first_errors(spark):
    df = spark.range(30).select("id", (F.col("id") * 1.0).alias("y"), F.lit(3.0).alias("p"))
    got = ev.prediction_errors(df, "id", "y", "p").collect()
    assert [r["id"] for r in got] == list(range(10))
    assert got[0]["abs_error"] == 3.0


def test_more_categories_than_bins(spark):
    i = F.col("id")
    df = spark.range(400).select(
        F.when(i % 2 == 0, "Glass").otherwise("Metal").alias("waste_type"),
        (i / 10).alias("weight_kg"), (i % 9 / 1).alias("moisture_pct"), (i % 2).cast("int").alias("recyclable"),
        F.concat(F.lit("m"), i % 80).alias("material_type"),
    )
    model = cl.train_classifier(df, cl.tree(3))
    assert cl.score(df, model).filter("predicted_type = waste_type").count() == 400


def test_requests_of_one_file_part_are_scored_on_all_cores(spark, monkeypatch):
    """A model takes far longer than reading; a file of one row group is one task."""
    raw = spark.range(400).select(
        "id", (F.col("id") % 9).cast("string").alias("weight_kg"), F.lit("15").alias("moisture_pct"),
        F.lit("1").alias("recyclable"), F.lit("ferrous").alias("material_type"),
    ).coalesce(1)
    seen = []

    def scored(df, model):
        seen.append(df.groupBy(F.spark_partition_id()).count().collect())
        return cl.rule_classify(df)

    monkeypatch.setattr(cl, "score", scored)
    good, _ = cl.classify_requests(raw, model=object())
    assert good.select("id").distinct().count() == 400
    counts = [r["count"] for r in seen[0]]
    assert len(counts) >= spark.sparkContext.defaultParallelism and max(counts) < 100
