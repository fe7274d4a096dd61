"""Descriptive statistics over tables of any size."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from curbside.functions.numeric import exact_mean, half_away, known
from curbside.operators.scale import running_total


def column_profile(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of each column, in one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"),
                F.col(name).alias("non_null"),
            )
            for i, (name, dtype) in enumerate(df.dtypes)
        ]
    )
    return counts.select(F.inline(rows))


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 10_000
) -> DataFrame:
    """Quantiles with linear interpolation, exact, without sorting a column.

    A sketch brackets each rank between two values.  The values below each bracket
    and inside it are counted, which says whether it holds the rank; only those
    inside, a few in ``accuracy``, are put in order.  A bracket that missed its rank
    is opened to all values on the side where the rank lies.
    """
    spark = df.sparkSession
    numeric = df.select(*[known(c).alias(c) for c in columns])
    # The sketch is off by one in ``accuracy`` ranks at most; as much again holds the
    # next rank, which interpolation needs, where a column has ``accuracy`` values.
    # A column of fewer values has no bracket: all of it is put in order.
    slack = 4.0 / accuracy
    lows, highs = [max(0.0, p - slack) for p in probs], [min(1.0, p + slack) for p in probs]
    sketched = numeric.agg(
        *[
            F.struct(F.count(c).alias("n"), F.percentile_approx(c, [*lows, *highs], accuracy).alias("at")).alias(c)
            for c in columns
        ]
    ).first()
    brackets = [
        (c, p, sketched[c]["n"], sketched[c]["at"][i], sketched[c]["at"][i + len(probs)])
        for c in columns
        if sketched[c]["n"]
        for i, p in enumerate(probs)
    ]
    if not brackets:
        return spark.createDataFrame([], "column string, p double, value double")
    # A sketch's ends need not be the least and largest value.
    ends = [
        (
            low if n >= accuracy and p > slack else -math.inf,
            high if n >= accuracy and p < 1 - slack else math.inf,
        )
        for _, p, n, low, high in brackets
    ]
    sides = [
        [
            F.count_if(F.col(c) < ends[i][0]).alias(f"b{i}"),
            F.count_if(F.col(c).between(*map(F.lit, ends[i]))).alias(f"i{i}"),
        ]
        for i, (c, *_) in enumerate(brackets)
    ]
    counted = numeric.agg(*[count for pair in sides for count in pair]).first().asDict()
    below = {}
    for i, (_, p, n, _, _) in enumerate(brackets):
        first, last = math.floor((n - 1) * p), math.ceil((n - 1) * p)
        low, high = ends[i]
        over = counted[f"b{i}"] + counted[f"i{i}"]
        ends[i] = (low if counted[f"b{i}"] <= first else -math.inf, high if last < over else math.inf)
        below[f"b{i}"] = counted[f"b{i}"] if ends[i][0] == low else 0
    inside = [
        F.when(
            F.col(c).between(*map(F.lit, ends[i])),
            F.struct(F.lit(i).alias("bracket"), F.col(c).alias("value")),
        )
        for i, (c, *_) in enumerate(brackets)
    ]
    hit = reduce(lambda x, y: x | y, [x.isNotNull() for x in inside])
    counts = (
        numeric.filter(hit)
        .select(F.inline(F.array_compact(F.array(*inside))))
        .groupBy("bracket", "value")
        .agg(F.count("*").alias("n"))
    )
    placed = running_total(counts, ["bracket", "value"], "n", "before")
    # Ranks inside a bracket start after all values of the brackets before it.
    spans = placed.groupBy("bracket").agg(F.min("before").alias("first"))
    ranks = []
    for i, (c, p, n, _, _) in enumerate(brackets):
        rank = (n - 1) * p
        down = math.floor(rank) - below[f"b{i}"]
        ranks.append((i, c, float(p), rank - math.floor(rank), down, math.ceil(rank) - below[f"b{i}"]))
    schema = "bracket int, column string, p double, part double, low_rank long, high_rank long"
    wanted = spark.createDataFrame(ranks, schema).join(spans, "bracket")
    place, upto = F.col("before") - F.col("first"), F.col("before") - F.col("first") + F.col("n")
    # One row per column and probability.
    hits = placed.join(F.broadcast(wanted), "bracket").select(
        "column",
        "p",
        "part",
        F.when((place <= F.col("low_rank")) & (F.col("low_rank") < upto), F.col("value")).alias("low"),
        F.when((place <= F.col("high_rank")) & (F.col("high_rank") < upto), F.col("value")).alias("high"),
    )
    found = (
        hits.filter("low IS NOT NULL OR high IS NOT NULL")
        .groupBy("column", "p", "part")
        .agg(F.max("low").alias("low"), F.max("high").alias("high"))
    )
    return found.select(
        "column", "p", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value")
    )


def describe(df: DataFrame, columns: list[str], approximate: bool = False, digits: int = 4) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per numeric column.

    ``approximate`` replaces the exact quartiles by a sketch: one pass, no sort.
    NaN counts as missing.
    """
    probs = [0.25, 0.5, 0.75]
    names = ["p25", "p50", "p75"]
    per_column = []
    for c in columns:
        x = known(c)
        per_column.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                half_away(exact_mean(x), digits).alias("mean"),
                half_away(F.stddev_samp(x), digits).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                (
                    F.percentile_approx(x, probs, 10_000)
                    if approximate
                    else F.lit(None).cast("array<double>")
                ).alias("sketch"),
            ).alias(c)
        )
    stats = df.agg(*per_column).select(F.inline(F.array(*[F.col(c) for c in columns])))
    if approximate:
        quartiles = [F.col("sketch")[i].alias(n) for i, n in enumerate(names)]
        return stats.select("column", "count", "mean", "std", "min", *quartiles, "max")
    spread = (
        exact_quantiles(df, columns, probs)
        .groupBy("column")
        .pivot("p", probs)
        .agg(half_away(F.first("value"), digits))
        .toDF("column", *names)
    )
    return stats.join(F.broadcast(spread), "column", "left").select(
        "column", "count", "mean", "std", "min", *names, "max"
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max; the last is closed, empty ones are kept."""
    x = F.col(column).cast("double")
    values = df.select(x.alias("v")).filter("v IS NOT NULL")
    bounds = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    place = F.when(hi > lo, F.floor((F.col("v") - lo) / (hi - lo) * bins)).otherwise(
        # One value only: the range is widened by half a unit on both sides.
        F.lit(bins // 2)
    )
    counted = values.groupBy(F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(
        F.count("*").alias("n")
    )
    left = F.when(hi > lo, lo).otherwise(lo - 0.5)
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0) / bins)
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return all_bins.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (left + F.col("bin") * width).alias("bin_start"),
        (left + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def correlation_pairs(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Pearson correlation of each pair below the diagonal, all in one pass."""
    pairs = list(combinations(columns, 2))
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = numeric.agg(*[F.corr(b, a).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(
            F.lit(b).alias("row_column"),
            F.lit(a).alias("col_column"),
            half_away(F.col(f"r{i}"), digits).alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))


def residual_stats(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    """Mean and population standard deviation of actual - predicted."""
    error = F.col(actual) - F.col(predicted)
    return df.agg(
        F.count(error).alias("n"),
        half_away(exact_mean(error), digits).alias("mean"),
        half_away(F.stddev_pop(error), digits).alias("std"),
    )
