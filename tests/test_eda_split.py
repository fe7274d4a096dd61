from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from curbside.operators import eda, split

NUMERIC = ["weight_kg", "moisture_pct", "volume_liters"]


def test_describe_is_what_pandas_says(sample):
    want = sample.toPandas()[NUMERIC].describe()
    for r in eda.describe(sample, NUMERIC).collect():
        d = want[r["column"]]
        got = [r[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert got == pytest.approx(list(d.values), abs=6e-5)


def test_exact_quantiles_with_nulls_ties_and_a_single_value(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([np.zeros(400), rng.normal(size=801)])
    df = spark.createDataFrame([(float(x), 5.0, None) for x in a] + [(None, 5.0, 2.0)], "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in eda.exact_quantiles(df, ["a", "b", "c"], probs).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(np.quantile(a, p), abs=1e-12)
        assert got["b", p] == 5.0
        assert got["c", p] == 2.0


def test_approximate_quartiles_are_near(sample):
    exact = {r["column"]: r for r in eda.describe(sample, NUMERIC).collect()}
    for r in eda.describe(sample, NUMERIC, approximate=True).collect():
        assert r["p50"] == pytest.approx(exact[r["column"]]["p50"], abs=0.5)


@pytest.mark.parametrize("bins", [20, 7])
def test_histogram_is_what_numpy_says(sample, bins):
    values = [r[0] for r in sample.select("volume_liters").collect()]
    counts, edges = np.histogram(values, bins=bins)
    got = eda.histogram(sample, "volume_liters", bins).orderBy("bin").collect()
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["bin_start"] for r in got] == pytest.approx(edges[:-1].tolist())
    assert got[-1]["bin_end"] == pytest.approx(edges[-1])


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(4.0,), (4.0,), (None,)], "v double")
    counts, edges = np.histogram([4.0, 4.0], bins=20)
    got = eda.histogram(df, "v").orderBy("bin").collect()
    assert [r["n"] for r in got] == counts.tolist()
    assert got[0]["bin_start"] == pytest.approx(edges[0])


def test_correlations(sample):
    columns = ["weight_kg", "moisture_pct", "recyclable", "volume_liters", "month"]
    want = sample.toPandas()[columns].corr()
    got = eda.correlation_pairs(sample, columns).collect()
    assert len(got) == 10
    for r in got:
        assert r["r"] == pytest.approx(want.loc[r["row_column"], r["col_column"]], abs=6e-5)


def test_column_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = [tuple(r) for r in eda.column_profile(df).orderBy("position").collect()]
    assert got == [(0, "a", "int", 2), (1, "b", "string", 1)]


def test_residuals_use_the_population_deviation(spark):
    y, p = [1.0, 2.0, 4.5, 3.0], [1.5, 2.0, 4.0, 1.0]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    r = eda.residual_stats(df, "y", "p").first()
    e = np.array(y) - np.array(p)
    assert (r["n"], r["mean"], r["std"]) == (4, round(e.mean(), 4), round(e.std(), 4))


@pytest.fixture(scope="module")
def labelled(spark):
    """A hot class with most rows, small ones, and one with a single row."""
    i = F.col("id")
    label = F.when(i < 700, "hot").when(i < 903, "b").when(i < 1000, "c").otherwise("one")
    return spark.range(1001).select(i, label.alias("y"))


def test_stratified_split_is_exact(labelled):
    got = split.stratified_split(labelled, "y", "id")
    assert got.count() == 1001
    assert got.select("id").distinct().count() == 1001
    sizes = {(r["y"], r["split"]): r["count"] for r in got.groupBy("y", "split").count().collect()}
    # 201 of 1001 in all: 140 + 40.6 + 19.4 + 0.2, the remainder going to b.
    assert sizes["hot", "test"] == 140
    assert sizes["b", "test"] == 41
    assert sizes["c", "test"] + sizes.get(("one", "test"), 0) == 20
    assert sum(n for (_, s), n in sizes.items() if s == "test") == 201


def test_split_with_more_classes_than_one_task_sorts(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, F.col("id").cast("string")).alias("y"))
    monkeypatch.setattr("curbside.operators.scale.ONE_TASK_ROWS", 100)
    got = split.stratified_split(rows, "y", "id")
    # 1000 rows have no label: a class of its own, 200 of it tested; 400 of the others.
    sizes = {(r["none"], r["split"]): r["count"] for r in got.groupBy(F.col("y").isNull().alias("none"), "split").count().collect()}
    assert sizes == {(True, "test"): 200, (True, "train"): 800, (False, "test"): 400, (False, "train"): 1600}
    folds = split.stratified_folds(rows, "y", "id")
    assert folds.count() == 3000 and folds.filter("y IS NULL").groupBy("fold").count().agg(F.max("count")).first()[0] == 200


@pytest.mark.parametrize("prefix", [1, 2, 8])
def test_the_cut_does_not_depend_on_the_stretches(labelled, prefix):
    a, b = split.stratified_split(labelled, "y", "id"), split.stratified_split(labelled, "y", "id", prefix=prefix)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_splits_do_not_depend_on_the_partitions(labelled):
    for f in (
        lambda df: split.stratified_split(df, "y", "id"),
        lambda df: split.hash_split(df, "id"),
        lambda df: split.stratified_folds(df, "y", "id"),
        lambda df: split.assign_folds(df, "id"),
    ):
        a, b = f(labelled), f(labelled.repartition(5))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hash_split_and_folds_are_near_their_shares(labelled):
    test = split.hash_split(labelled, "id").filter("split = 'test'").count()
    assert 150 < test < 250
    folds = split.assign_folds(labelled, "id").groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]
    assert all(150 < r["count"] < 250 for r in folds)


def test_stratified_folds_differ_by_at_most_one(labelled):
    folds = split.stratified_folds(labelled, "y", "id").groupBy("y", "fold").count()
    spread = folds.groupBy("y").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("k"))
    got = {r["y"]: (r["d"], r["k"]) for r in spread.collect()}
    assert got["hot"] == (0, 5) and got["b"][0] <= 1 and got["one"] == (0, 1)


def test_folds_are_the_places_by_digest_in_each_class(labelled):
    """Rows are dealt by digest once: no sampled sort of the whole."""
    got = split.stratified_folds(labelled, "y", "id", k=3, seed=9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()
    place = F.row_number().over(W.partitionBy("y").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("|9")))))
    wanted = labelled.select("id", ((place - 1) % 3).alias("fold"))
    assert sorted(map(tuple, got.select("id", "fold").collect())) == sorted(map(tuple, wanted.collect()))


def test_the_cut_is_found_without_moving_the_rows(labelled, monkeypatch):
    """One stretch per class is asked for, by a table of one row per class."""
    joined = []
    real = split.attach

    def watched(fact, dim, keys, *args, **kwargs):
        found = real(fact, dim, keys, *args, **kwargs)
        joined.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(split, "attach", watched)
    split.stratified_split(labelled, "y", "id").count()
    assert len(joined) == 2 and all("SortMergeJoin" not in plan for plan in joined)


def test_the_seed_matters(labelled):
    a, b = (split.hash_split(labelled, "id", seed=s).filter("split = 'test'").select("id") for s in (1, 2))
    assert a.exceptAll(b).count() > 0


@pytest.mark.parametrize("shift", [-1000.0, 0.0, 1000.0])
def test_a_bracket_that_missed_its_rank_is_opened(spark, monkeypatch, shift):
    """A sketch that is far off, to either side, still gives exact quartiles."""
    real = F.percentile_approx
    monkeypatch.setattr(eda.F, "percentile_approx", lambda c, shares, accuracy: real(F.col(c) + shift, shares, accuracy))
    df = spark.range(3000).select((F.col("id") / 10).alias("a"), F.lit(2.5).alias("b"))
    got = {(r["column"], r["p"]): r["value"] for r in eda.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.9], 100).collect()}
    assert got == {("a", p): pytest.approx(2999 * p / 10) for p in (0.25, 0.5, 0.9)} | {("b", p): 2.5 for p in (0.25, 0.5, 0.9)}
