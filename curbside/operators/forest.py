"""Random forests of regression trees, grown from counted cells.

A cell is a combination of whole-numbered features; all that a tree can know of
the records is how many lie in each cell, and their mean.  A bootstrap sample of
``n`` records takes each a Poisson(1) number of times, so it holds a Poisson(n)
number of a cell's records; their mean varies around the cell's by its variance
over that number.  Each tree draws these two figures per cell instead of every
record, so growing costs the same at any number of records.

All trees grow at once, a level per round: sums by (tree, node, feature, value)
give the split with the largest fall in squared error of every node.  Draws are
hashes of the seed, tree and cell, so reruns agree.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curbside.session import materialize

#: Up to this expected number a Poisson draw goes through its probabilities one by
#: one; beyond, a normal draw corrected for its skew is as good as whole numbers get.
EXACT_UP_TO = 20
#: Probabilities gone through; what lies beyond is below 10^-15.
_STEPS = 80


def uniform(*parts: Column) -> Column:
    """A number above 0, up to 1, from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 1) / float(1 << 53)


def normal(*parts: Column) -> Column:
    """A standard normal draw."""
    radius = F.sqrt(-2 * F.log(uniform(*parts, F.lit("r"))))
    return radius * F.cos(2 * math.pi * uniform(*parts, F.lit("a")))


def poisson(mean: Column, *parts: Column) -> Column:
    """A Poisson draw: the number of probabilities that a uniform draw exceeds."""
    u = uniform(*parts, F.lit("u"))

    def step(state: Column, k: Column) -> Column:
        p = F.when(k == 0, F.exp(-mean)).otherwise(state["p"] * mean / F.greatest(k, F.lit(1)))
        total = state["total"] + p
        return F.struct(
            p.alias("p"), total.alias("total"),
            (state["n"] + F.when(u > total, 1.0).otherwise(0.0)).alias("n"),
        )

    zero = F.lit(0.0)
    start = F.struct(zero.alias("p"), zero.alias("total"), zero.alias("n"))
    few = F.aggregate(F.sequence(F.lit(0), F.lit(_STEPS)), start, step, lambda s: s["n"])
    z = normal(*parts)
    many = F.round(mean + F.sqrt(mean) * z + (z * z - 1) / 6)
    return F.when(mean <= EXACT_UP_TO, few).otherwise(F.greatest(many, F.lit(0.0)))


def bootstrap(cells: DataFrame, features: list[str], trees: int, seed: int) -> DataFrame:
    """(tree, features, w, y): per tree and cell the number of records drawn and
    their mean.

    ``cells`` has the features, ``n``, ``mean``, ``variance``, ``low`` and ``high``; a cell
    with ``n`` of 0 only follows the splits.  A drawn mean stays inside the cell's
    range.
    """
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    each = cells.select("*", F.explode(numbers).alias("tree"))
    parts = [F.lit(seed), F.col("tree"), *map(F.col, features)]
    drawn = F.when(F.col("n") > 0, poisson(F.col("n").cast("double"), *parts)).otherwise(F.lit(0.0))
    around = F.sqrt(F.col("variance") / F.col("w")) * normal(*parts, F.lit("mean"))
    mean = F.greatest("low", F.least("high", F.col("mean") + around))
    return each.withColumn("w", drawn).select(
        "tree", *features, "w", F.when(F.col("w") > 0, mean).alias("y")
    )


def _best_splits(points: DataFrame, features: list[str]) -> DataFrame:
    """(tree, node, feature, value): the split of each node that lessens its squared
    error most; of equals the first feature, then the lowest value.  Values up to
    ``value`` go left."""
    sides = F.array(
        *[F.struct(F.lit(i).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)]
    )
    cores = points.sparkSession.sparkContext.defaultParallelism
    # All that follows groups by tree first, so this is the only shuffle.
    sums = (
        points.where("w > 0")
        .repartition(cores, "tree")
        .select("tree", "node", "w", (F.col("w") * F.col("y")).alias("wy"), F.inline(sides))
        .groupBy("tree", "node", "feature", "value")
        .agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    )
    whole = W.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = sums.select(
        "tree", "node", "feature", "value",
        F.sum("w").over(upto).alias("left_w"), F.sum("wy").over(upto).alias("left"),
        F.sum("w").over(whole).alias("all_w"), F.sum("wy").over(whole).alias("all"),
    )
    right, right_w = F.col("all") - F.col("left"), F.col("all_w") - F.col("left_w")
    square = lambda total, weight: total * total / weight
    gain = (
        square(F.col("left"), F.col("left_w"))
        + square(right, right_w)
        - square(F.col("all"), F.col("all_w"))
    )
    # Sums differ in their last digits with task order; what is below them is no gain.
    noise = square(F.col("all"), F.col("all_w")) * 1e-9
    order = F.struct(F.round(gain, 6), -F.col("feature"), -F.col("value"))
    return (
        both.where("left_w < all_w")
        .where(gain > noise)
        .groupBy("tree", "node")
        .agg(F.max_by(F.struct("feature", "value"), order).alias("split"))
        .select("tree", "node", "split.*")
    )


def grow(points: DataFrame, features: list[str], max_depth: int) -> DataFrame:
    """(tree, features, prediction) for each cell of ``bootstrap``: the mean of what
    the tree drew in the cell's leaf; null for a tree that drew nothing."""
    points = materialize(points.withColumn("node", F.lit(1).cast("bigint")))
    own = reduce(
        lambda c, i: c.when(F.col("feature") == i, F.col(features[i])),
        range(1, len(features)),
        F.when(F.col("feature") == 0, F.col(features[0])),
    )
    child = F.col("node") * 2 + F.when(own > F.col("value"), 1).otherwise(0)
    node = F.when(F.col("feature").isNull(), F.col("node")).otherwise(child).alias("node")
    for _ in range(max_depth):
        # One row per node, of which there are no more than cells.
        splits = F.broadcast(_best_splits(points, features))
        parted = points.join(splits, ["tree", "node"], "left")
        points = materialize(parted.select("tree", *features, "w", "y", node))
    leaves = points.groupBy("tree", "node").agg(
        (F.sum(F.col("w") * F.col("y")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("prediction")
    )
    return points.join(leaves, ["tree", "node"]).select("tree", *features, "prediction")
