from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from curbside.functions import numeric as num


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sum_is_exact_and_does_not_depend_on_the_partitions(spark):
    rng = random.Random(5)
    values = [round(rng.uniform(-1e6, 1e6), rng.choice([0, 1, 2, 6])) for _ in range(5000)] + [1e14, 0.01]
    want = sum(Decimal(repr(v)).quantize(Decimal("0.000001")) for v in values)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for parts in (1, 3, 16):
        total = df.repartition(parts).agg(num.exact_sum("v")).first()[0]
        # 1e14 has no room for millionths in a double; all others do.
        assert total == want


def test_partial_sums_merge_to_the_same_total(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") / 8 - 30).alias("v"))
    direct = df.agg(num.exact_sum("v")).first()[0]
    merged = df.groupBy("k").agg(*num.partial_sums("v", "v")).agg(num.merged_sum("v")).first()[0]
    assert merged == direct


def test_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    row = df.agg(num.rounded(num.exact_sum("v")), num.exact_mean("v")).first()
    assert tuple(row) == (None, None)


def test_a_total_is_rounded_after_summing(spark):
    df = spark.createDataFrame([(0.004,)] * 3, "v double")
    assert df.agg(num.rounded(num.exact_sum("v"))).first()[0] == 0.01


@pytest.mark.parametrize("x,digits", [(2.5, 0), (-2.5, 0), (0.25, 1), (1.35, 1), (7.0, 2)])
def test_half_away(spark, x, digits):
    want = Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    assert one(spark, num.half_away(F.lit(x), digits)) == float(want)


@pytest.mark.parametrize("x,digits", [(0.25, 1), (0.35, 1), (0.45, 1), (2.675, 2), (1.005, 2), (0.8235, 3), (2.5, 0), (3.5, 0), (-0.25, 1), (45.95, 1)])
def test_half_even_is_python_round(spark, x, digits):
    assert one(spark, num.half_even(F.lit(x), digits)) == round(x, digits)


@pytest.mark.parametrize("x,want", [(2.5, 3.0), (-2.5, -2.0), (80.49, 80.0)])
def test_half_up(spark, x, want):
    assert one(spark, num.half_up(F.lit(x))) == want


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert tuple(map(float, df.agg(num.exact_sum("v"), num.exact_mean("v")).first())) == (1.0, 1.0)
    assert df.filter("isnan(v)").agg(num.exact_sum("v")).first()[0] is None


def test_places_are_a_parameter(spark):
    df = spark.createDataFrame([(4e-7,), (4e-7,)], "v double")
    assert df.agg(num.exact_sum("v")).first()[0] == 0
    assert df.agg(num.exact_sum("v", 9)).first()[0] == Decimal("8e-7")
