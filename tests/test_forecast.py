from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbside.functions import lookups
from curbside.operators import evaluate as ev, forecast as fc, split
from tests import fixtures as fx

AS_OF = "2024-02-27"  # a Tuesday


@pytest.fixture(scope="module")
def grid(spark):
    areas = lookups.base_volumes(spark).select("area")
    return fc.forecast_grid(areas, AS_OF).cache()


@pytest.fixture(scope="module")
def fallback(spark, grid):
    return fc.fallback_forecast(grid, lookups.base_volumes(spark), lookups.day_multipliers(spark)).cache()


def test_grid_is_each_area_on_seven_days(grid):
    assert grid.count() == 35
    days = {tuple(r) for r in grid.select("day_no", "prediction_date", "day_of_week", "month", "label", "is_weekend").collect()}
    assert len(days) == 7
    assert (2, dt.date(2024, 2, 29), "Thursday", 2, "Feb 29", 0) in days
    assert (4, dt.date(2024, 3, 2), "Saturday", 3, "Mar 02", 1) in days


def test_fallback_is_base_times_factor(fallback):
    base, factor = dict(lookups.BASE_VOLUMES), dict(lookups.DAY_MULTIPLIERS)
    for r in fallback.collect():
        assert r["predicted_volume"] == round(base[r["area"]] * factor[r["day_of_week"]], 1)


def test_a_weekday_without_factor_counts_as_one(spark, grid):
    got = fc.fallback_forecast(grid, lookups.base_volumes(spark), lookups.day_multipliers(spark).limit(0))
    assert {r["predicted_volume"] for r in got.filter("area = 'ISBT'").collect()} == {55.0}


def test_both_join_ways_agree(spark, grid, fallback):
    large = fc.fallback_forecast(grid, lookups.base_volumes(spark), lookups.day_multipliers(spark), max_rows=0)
    assert large.select(fallback.columns).exceptAll(fallback).count() == 0


def test_noise_stays_within_its_bounds(spark, grid, fallback):
    noisy = fc.fallback_forecast(
        grid, lookups.base_volumes(spark), lookups.day_multipliers(spark), noise=0.05, seed=1
    ).withColumnRenamed("predicted_volume", "v")
    ratio = noisy.join(fallback, ["area", "prediction_date"]).select((F.col("v") / F.col("predicted_volume")).alias("r"))
    low, high = ratio.agg(F.min("r"), F.max("r")).first()
    assert 0.94 < low < high < 1.06


def test_base_and_factors_from_history(spark):
    rows = [
        ("a", dt.date(2024, 1, 1), 10.0), ("a", dt.date(2024, 1, 2), 20.0),
        ("b", dt.date(2024, 1, 1), 30.0), ("b", dt.date(2024, 1, 8), 60.0),
    ]
    daily = spark.createDataFrame(rows, "area string, collection_date date, total_volume double")
    assert {tuple(r) for r in fc.base_volumes(daily).collect()} == {("a", 15.0), ("b", 45.0)}
    # Mondays total 40 and 60, the Tuesday 20; the mean of all days is 40.
    assert {tuple(r) for r in fc.day_multipliers(daily).collect()} == {("Monday", 1.25), ("Tuesday", 0.5)}


def test_kpis_take_the_earliest_peak(spark):
    rows = [("a", i, dt.date(2024, 1, 1 + i), v) for i, v in enumerate([1.4, 5.0, 5.0, 2.0])]
    rows += [("b", i, dt.date(2024, 1, 1 + i), 1.1) for i in range(4)]
    df = spark.createDataFrame(rows, "area string, day_no int, prediction_date date, predicted_volume double")
    assert tuple(fc.forecast_kpis(df).first()) == (3.0, "2024-01-02", "Tuesday", 6.0)


def test_capacity_bands(spark):
    df = spark.createDataFrame([(36.0,), (36.1,), (56.0,), (56.1,), (200.0,)], "predicted_volume double")
    got = {r["predicted_volume"]: (r["capacity_pct"], r["band"]) for r in fc.capacity_use(df).collect()}
    assert [got[v][1] for v in (36.0, 36.1, 56.0, 56.1, 200.0)] == ["low", "mid", "mid", "high", "high"]
    assert got[200.0][0] == 100.0


def test_the_trees_of_the_forest_differ(sample):
    """Each tree draws its own records."""
    model = fc.train_volume(sample, 12, 5)
    trees = {}
    for r in model.by_tree.collect():
        trees.setdefault(r["tree"], []).append(tuple(r)[1:])
    assert len(trees) == 12 == len({tuple(sorted(cells)) for cells in trees.values()})


def test_the_model_tells_weekdays_apart_and_is_scored_on_rows_left_out(spark):
    i = F.col("id")
    day = F.element_at(F.array(*[F.lit(d) for d in fx.WEEK]), (i % 7 + 1).cast("int"))
    rows = spark.range(1400).select(
        F.lit("a").alias("area"), day.alias("day_of_week"), F.lit(1).alias("month"),
        (i % 7 * 10 + i % 3).cast("double").alias("volume_liters"), i.alias("key"),
    )
    parted = split.hash_split(rows, "key")
    model = fc.train_volume(parted.filter("split = 'train'"), 20, 6)
    tested = fc.predict_volume(parted.filter("split = 'test'"), model)
    r = ev.regression_metrics(tested, "volume_liters", "predicted").first()
    assert r["n"] == parted.filter("split = 'test'").count() and r["r2"] > 0.95 and r["rmse"] < 1.5


def test_no_model_and_null_features_take_the_fallback(spark, sample, grid, fallback):
    model = fc.train_volume(sample, 3, 4)
    same = ["area", "day_no", "predicted_volume"]
    without = fc.forecast_volumes(grid, None, fallback)
    assert sorted(without.select(same).collect()) == sorted(fallback.select(same).collect())
    unknown = grid.withColumn("month", F.when(F.col("day_no") > 2, F.col("month")))
    got = {(r["area"], r["day_no"]): r["predicted_volume"] for r in fc.forecast_volumes(unknown, model, fallback).collect()}
    want = {(r["area"], r["day_no"]): r["predicted_volume"] for r in fallback.collect()}
    by_model = {(r["area"], r["day_no"]): r["predicted_volume"] for r in fc.model_forecast(grid, model).collect()}
    assert len(got) == 35
    assert all(got[k] == (want if k[1] <= 2 else by_model)[k] for k in got)


def test_noise_is_the_same_on_every_run(spark, grid):
    base = spark.createDataFrame([(a, 100.0) for a in lookups.AREAS], "area string, base_volume double")
    factors = lookups.day_multipliers(spark)
    runs = [
        sorted(fc.fallback_forecast(g, base, factors, noise=0.05).select("area", "day_no", "predicted_volume").collect())
        for g in (grid, grid.repartition(5))
    ]
    plain = fc.fallback_forecast(grid, base, factors).select("area", "day_no", "predicted_volume")
    assert runs[0] == runs[1] != sorted(plain.collect())


def test_forest_forecast_with_fallback(spark, sample, grid, fallback):
    model = fc.train_volume(sample, 5, 6)
    forecast = fc.model_forecast(grid, model)
    low, high = sample.agg(F.min("volume_liters"), F.max("volume_liters")).first()
    got = forecast.collect()
    assert len(got) == 35
    assert all(low * 8.5 - 0.1 <= r["predicted_volume"] <= high * 8.5 + 0.1 for r in got)
    holes = forecast.withColumn("predicted_volume", F.when(F.col("area") != "ISBT", F.col("predicted_volume")))
    filled = {(r["area"], r["day_no"]): r["predicted_volume"] for r in fc.with_fallback(holes, fallback).collect()}
    want = {(r["area"], r["day_no"]): r["predicted_volume"] for r in fallback.collect()}
    assert filled["ISBT", 0] == want["ISBT", 0] and filled["Clock Tower", 0] != want["Clock Tower", 0]


def test_an_unknown_area_is_still_forecast(spark, sample):
    model = fc.train_volume(sample, 3, 4)
    grid = fc.forecast_grid(spark.createDataFrame([("elsewhere",)], "area string"), AS_OF)
    assert fc.model_forecast(grid, model).filter("predicted_volume > 0").count() == 7


def test_nested_form_and_prediction_rows(fallback):
    nested = fc.nested_forecast(fallback).collect()
    assert len(nested) == 5
    assert [d["day_no"] for d in nested[0]["days"]] == list(range(7))
    rows = fc.to_predictions(fallback, "2024-02-27 08:00:00")
    assert rows.filter("confidence = 0.87 AND created_at = '2024-02-27 08:00:00'").count() == 35
