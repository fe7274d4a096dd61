from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from curbside.operators import forecast as fc, forest
from curbside.session import fresh_path
from tests import fixtures as fx


@pytest.mark.parametrize("mean", [0.3, 4.0, 20.0, 21.0, 400.0])
def test_poisson_draws_have_the_right_distribution(spark, mean):
    draws = 20_000
    df = spark.range(draws).select(forest.poisson(F.lit(mean), F.col("id"), F.lit(7)).alias("k"))
    counts = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    found = sum(k * n for k, n in counts.items()) / draws
    spread = sum((k - found) ** 2 * n for k, n in counts.items()) / draws
    assert abs(found - mean) < 5 * math.sqrt(mean / draws)
    assert spread == pytest.approx(mean, rel=0.06)
    # Largest distance between the distribution functions (Kolmogorov).
    seen = chance = distance = 0.0
    for k in range(int(mean + 12 * math.sqrt(mean) + 12)):
        seen += counts.get(k, 0) / draws
        chance += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        distance = max(distance, abs(seen - chance))
    assert distance < 1.7 / math.sqrt(draws)


def cell(spark, values):
    rows = [(0, len(values), statistics.fmean(values), statistics.pvariance(values), min(values), max(values))]
    return spark.createDataFrame(rows, "f int, n long, mean double, variance double, low double, high double")


def test_counted_draws_are_distributed_like_draws_of_records(spark):
    rng = random.Random(5)
    values = [rng.choice([3.0, 5.0, 40.0]) + rng.random() for _ in range(60)]
    trees = 4000
    got = forest.bootstrap(cell(spark, values), ["f"], trees, 1).collect()

    def plain():
        # Each record a Poisson(1) number of times.
        taken = []
        for v in values:
            u, k, p = rng.random(), 0, math.exp(-1)
            total = p
            while u > total:
                k += 1
                p /= k
                total += p
            taken += [v] * k
        return len(taken), statistics.fmean(taken)

    want = [plain() for _ in range(trees)]
    for figures, wanted in (([r["w"] for r in got], [w for w, _ in want]), ([r["y"] for r in got], [y for _, y in want])):
        assert statistics.fmean(figures) == pytest.approx(statistics.fmean(wanted), rel=0.02)
        assert statistics.stdev(figures) == pytest.approx(statistics.stdev(wanted), rel=0.08)
        cuts = [sorted(wanted)[int(trees * q)] for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
        for q, cut in zip((0.1, 0.25, 0.5, 0.75, 0.9), cuts):
            assert sum(f <= cut for f in figures) / trees == pytest.approx(q, abs=0.06)


def test_one_record_is_drawn_as_itself(spark):
    got = forest.bootstrap(cell(spark, [4.5]), ["f"], 200, 3).collect()
    assert {r["y"] for r in got} == {None, 4.5}
    assert sum(r["w"] == 0 for r in got) / 200 == pytest.approx(math.exp(-1), abs=0.12)


def tree_of(points, features, depth):
    """Predictions of one tree by trying every split."""

    def error(rows):
        w = sum(r[1] for r in rows)
        return sum(r[1] * r[2] for r in rows) ** 2 / w if w else 0.0

    def leaf(rows, left, found):
        best = None
        if left:
            for i in range(features):
                for value in sorted({r[0][i] for r in rows if r[1] > 0}):
                    sides = [[r for r in rows if r[0][i] <= value], [r for r in rows if r[0][i] > value]]
                    if all(sum(r[1] for r in s) > 0 for s in sides):
                        gain = error(sides[0]) + error(sides[1]) - error(rows)
                        if gain > error(rows) * 1e-9 and (best is None or round(gain, 6) > best[0]):
                            best = round(gain, 6), sides
        if best is None:
            w = sum(r[1] for r in rows)
            for r in rows:
                found[r[0]] = sum(x[1] * x[2] for x in rows if x[1]) / w
        else:
            for side in best[1]:
                leaf(side, left - 1, found)
        return found

    return leaf(points, depth, {})


@pytest.mark.parametrize("depth", [0, 1, 3, 8])
def test_trees_are_those_of_trying_every_split(spark, depth):
    rng = random.Random(depth)
    names, rows = ["a", "b", "c"], []
    for tree in range(6):
        for a in range(4):
            for b in range(3):
                for c in range(3):
                    w = float(rng.choice([0, 1, 2, 5]))
                    rows.append((tree, a, b, c, w, rng.randrange(1000) / 8 if w else None))
    points = spark.createDataFrame(rows, "tree int, a int, b int, c int, w double, y double")
    got = {tuple(r)[:4]: r["prediction"] for r in forest.grow(points, names, depth).collect()}
    for tree in range(6):
        own = [((a, b, c), w, y or 0.0) for t, a, b, c, w, y in rows if t == tree]
        for features, value in tree_of(own, 3, depth).items():
            assert got[(tree, *features)] == pytest.approx(value)


def records(spark, n=6000):
    i = F.col("id")
    day = F.element_at(F.array(*[F.lit(d) for d in fx.WEEK]), (i % 7 + 1).cast("int"))
    noise = F.pmod(F.xxhash64(i), F.lit(100)) / 10
    return spark.range(n).select(
        F.concat(F.lit("area "), (i / 7).cast("long") % 5).alias("area"), day.alias("day_of_week"),
        ((i / 35).cast("long") % 12 + 1).cast("int").alias("month"),
        ((i % 7) * 10 + (i / 7).cast("long") % 5 * 100 + noise).alias("volume_liters"),
    )


def test_the_forest_agrees_with_one_grown_from_records(spark):
    rows = records(spark).cache()
    own = fc.train_volume(rows, 40, 8)
    coded = Pipeline(
        stages=[
            StringIndexer(inputCols=["area", "day_of_week"], outputCols=["a", "d"], stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=["a", "d", "month"], outputCol="features"),
            RandomForestRegressor(labelCol="volume_liters", numTrees=40, maxDepth=8, featureSubsetStrategy="all", seed=1),
        ]
    ).fit(rows)
    cells = rows.select(*fc.FEATURES).distinct()
    both = coded.transform(fc.predict_volume(cells, own))
    gap = F.abs(F.col("predicted") - F.col("prediction"))
    worst, mean = both.agg(F.max(gap), F.avg(gap)).first()
    assert both.count() == 420 and mean < 3 and worst < 15


def test_codes_follow_the_mean_and_unseen_values_get_the_mean(spark):
    rows = records(spark)
    model = fc.train_volume(rows, 10, 8)
    codes = {r["area"]: r["area_code"] for r in model.codes["area"].collect()}
    assert codes == {f"area {k}": k for k in range(5)}
    asked = spark.createDataFrame(
        [(a, "Monday", 3) for a in (*codes, "elsewhere")] + [(None, "Monday", 3), ("area 1", "Monday", None), ("area 1", "Noday", 3)],
        "area string, day_of_week string, month int",
    )
    got = {tuple(r)[:3]: r["predicted"] for r in fc.predict_volume(asked, model).collect()}
    seen = [got[f"area {k}", "Monday", 3] for k in range(5)]
    assert seen == sorted(seen) and seen[4] - seen[0] > 300
    assert min(seen) < got["elsewhere", "Monday", 3] < max(seen)
    assert got[None, "Monday", 3] is None and got["area 1", "Monday", None] is None
    assert got["area 1", "Noday", 3] > 0


def test_many_areas_need_no_list_on_the_driver(spark):
    i = F.col("id")
    rows = spark.range(200_000).select(
        F.concat(F.lit("area "), i).alias("area"), F.lit("Monday").alias("day_of_week"), F.lit(1).alias("month"),
        (i / 10).alias("volume_liters"),
    )
    model = fc.train_volume(rows, 3, 10)
    codes = model.codes["area"]
    sizes = [r["count"] for r in codes.groupBy("area_code").count().collect()]
    assert codes.count() == 200_000 and len(sizes) == 31 and max(sizes) < 1.2 * min(sizes)
    gap = F.abs(F.col("predicted") - F.col("volume_liters"))
    assert fc.predict_volume(rows, model).agg(F.max(gap)).first()[0] < 20_000 / 31 * 1.5


def test_the_model_is_stored_and_read_whole(spark):
    rows = records(spark, 700)
    model = fc.train_volume(rows, 4, 4)
    path = fresh_path(spark, "volume")
    model.save(path)
    back = fc.VolumeModel.load(spark, path)
    a, b = (fc.predict_volume(rows, m).select("predicted") for m in (model, back))
    assert a.exceptAll(b).count() == 0 and back.by_tree.count() == model.by_tree.count()
    again = fc.train_volume(rows.repartition(5), 4, 4)
    assert fc.predict_volume(rows, again).select(F.round("predicted", 6)).exceptAll(a.select(F.round("predicted", 6))).count() == 0


def test_records_without_a_feature_or_volume_teach_nothing(spark):
    rows = [("a", "Monday", 1, 5.0), (None, "Monday", 1, 99.0), ("a", None, 1, 99.0), ("a", "Monday", None, 99.0), ("a", "Monday", 1, None), ("a", "Monday", 1, float("nan"))]
    df = spark.createDataFrame(rows, "area string, day_of_week string, month int, volume_liters double")
    model = fc.train_volume(df, 30, 3)
    assert {r["predicted"] for r in fc.predict_volume(df.limit(1), model).collect()} == {5.0}
    empty = fc.train_volume(df.limit(0), 3, 3)
    assert [r["predicted"] for r in fc.predict_volume(df, empty).collect()] == [None] * 6
