"""Mixing sources to target weights by entropy balancing, with SQL functions only.

Each document gets a rate, the copies of it that the mix should take, between 0
and ``MOST_COPIES``.  Among all rates that meet the token target of a source the
ones wanted have the least relative entropy to one copy of everything.  The
convex dual of that problem has one multiplier ``m`` per source, and

    rate = MOST_COPIES / (1 + exp(-m * size / unit)),

an exponential tilt by size held between the bounds.  Newton's method finds all
multipliers together: a step reads the documents counted by (source, size), so
it is one aggregation with map-side partial sums whatever the number of
documents, and a hot source is split over tasks.

Rounding: within a source the documents are laid out from large to small and
copies are taken each time the running sum of rates passes a half, so sums of
copies differ from sums of rates by less than the largest document.  The running
sum is taken in two levels (blocks of sizes, then inside a block), so no task
holds a source.

Null text: size 0.  Null source: a source of its own, last.  Sources of size 0
take nothing.  Repeated rows are documents of their own; among rows equal in
all columns the copies differ by chance of order, which no result shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbside.llm.store import stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix in shares of all words.
SHARE = 1.5
#: No document is taken more often.
MOST_COPIES = 2
#: Newton stops when every source is this near its target, relatively.
CLOSE = 1e-9
MOST_STEPS = 60
#: Documents per block of the running sums, about.
BLOCK = 512

BLANKS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Words between blanks; null has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    found = F.size(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(found).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Target of each source, from (source, source_size): weights share out
    ``SHARE`` of all words, no source above ``MOST_COPIES`` times its size, what
    is above shared again by weight.

    With the sources in order of cap per weight the ones at their cap come first,
    and the level of the rest follows from two running sums: one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    caps = sizes.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size").cast("double") * MOST_COPIES
    )
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * SHARE
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    # The level only counts where the source is not full at it; the first such
    # source sets it for all that follow.
    leveled = caps.withColumn("level", level).withColumn(
        "open", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    )
    first = F.first("open", ignorenulls=True).over(
        filled.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return leveled.withColumn(
        "target",
        F.when(first.isNull(), F.col("cap")).otherwise(F.least("cap", first * F.col("weight"))),
    ).select("source", "source_size", "target")


def _rate(m: Column, size: Column, unit: Column) -> Column:
    return F.lit(float(MOST_COPIES)) / (1 + F.exp(-m * size / unit))


def multipliers(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """The dual multiplier of each source, from (source, size, n).

    Newton with a bracket: a step that would leave the bracket halves it, on the
    scale of asinh.  The state is one row per source and is written to the shared folder after every
    step, so a lost executor costs one step.
    """
    unit = F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(
        F.col("size").cast("double") * F.col("n")
    )
    units = (
        counts.where("size > 0")
        .groupBy(F.col("source").alias("of"))
        .agg(unit.alias("unit"))
    )
    full = F.col("target") >= F.col("source_size") * MOST_COPIES * (1 - 1e-12)
    state = stored(
        targets.join(units, F.col("source").eqNullSafe(F.col("of")))
        .select(
            "source",
            "target",
            "unit",
            full.alias("full"),
            F.lit(0.0).alias("m"),
            F.lit(-1e6).alias("low"),
            F.lit(1e6).alias("high"),
            F.lit(float("inf")).alias("gap"),
        ),
        "multipliers",
    )
    positive = counts.where("size > 0").withColumnRenamed("source", "of")
    for _ in range(MOST_STEPS):
        size = F.col("size").cast("double")
        rate = _rate(F.col("m"), size, F.col("unit"))
        sums = (
            positive.join(state.where("not full"), F.col("of").eqNullSafe(F.col("source")))
            .groupBy("of")
            .agg(
                F.sum(F.col("n") * size * rate).alias("got"),
                F.sum(
                    F.col("n") * size * size / F.col("unit") * rate * (1 - rate / MOST_COPIES)
                ).alias("slope"),
            )
        )
        over = F.col("got") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("m"))
        high = F.when(over, F.col("m")).otherwise(F.col("high"))
        reach = F.greatest(F.lit(4.0), F.abs("m"))
        move = (F.col("target") - F.col("got")) / F.col("slope")
        step = F.col("m") + F.greatest(-reach, F.least(reach, move))
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        middle = F.sinh((F.asinh(low) + F.asinh(high)) / 2)
        gap = F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        state = stored(
            state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select(
                "source",
                "target",
                "unit",
                "full",
                F.when(F.col("of").isNull() | (gap <= CLOSE), F.col("m"))
                .otherwise(F.when(inside, step).otherwise(middle))
                .alias("m"),
                F.when(F.col("of").isNull(), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("of").isNull(), F.col("high")).otherwise(high).alias("high"),
                F.when(F.col("of").isNull(), 0.0).otherwise(gap).alias("gap"),
            ),
            "multipliers",
        )
        if state.where(F.col("gap") > CLOSE).isEmpty():
            break
    return state.select("source", "m", "unit", "full")


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Size, target of the source and words taken of each document.

    A long row per document is all that the steps carry; the texts are read
    once.
    """
    sizes = stored(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    counts = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "size_counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(totals), "targets")
    duals = multipliers(counts, targets)

    # Rate and running sums by (source, size), then inside one size by block.
    rate = F.when(F.col("full"), float(MOST_COPIES)).otherwise(
        _rate(F.col("m"), F.col("size").cast("double"), F.col("unit"))
    )
    dual = duals.withColumnRenamed("source", "of")
    # Documents of one source and size have one rate, so the running sum before a
    # document is that of the larger sizes plus rate x its number in its size.
    # Numbers come from hash blocks: counts per block, then inside the block.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("block")), blocks)
    sized = (
        counts.withColumnRenamed("source", "of_source")
        .join(dual, F.col("of_source").eqNullSafe(F.col("of")), "left")
        .select(
            "of_source",
            F.col("size").alias("of_size"),
            "n",
            F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(0.0).alias("rate"),
        )
    )
    larger = (
        Window.partitionBy("of_source")
        .orderBy(F.col("of_size").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sized = stored(
        sized.withColumn(
            "before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(larger), F.lit(0.0))
        ),
        "rates",
    )
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    placed = sizes.join(sized, same).withColumn("block", spread)
    per_block = placed.groupBy("of_source", "of_size", "block").agg(F.count("*").alias("in_block"))
    earlier = (
        Window.partitionBy("of_source", "of_size")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_block = per_block.select(
        F.col("of_source").alias("b_source"),
        F.col("of_size").alias("b_size"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("skipped"),
    )
    inner = Window.partitionBy("of_source", "of_size", "block").orderBy(
        F.xxhash64("doc_id"), "doc_id"
    )
    numbered = placed.withColumn("inside", F.row_number().over(inner))
    numbered = numbered.join(
        per_block,
        F.col("of_source").eqNullSafe(F.col("b_source"))
        & (F.col("of_size") == F.col("b_size"))
        & (F.col("block") == F.col("b_block")),
    )
    place = F.col("skipped") + F.col("inside")
    upto = lambda number: F.floor(F.col("before") + F.col("rate") * number + 0.5 + 1e-9)
    copies = F.least(F.lit(MOST_COPIES), F.greatest(F.lit(0), upto(place) - upto(place - 1)))
    goal = targets.withColumnRenamed("source", "t_source")
    return numbered.join(goal, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).cast("long").alias("taken"),
        F.col("source"),
        F.col("rate"),
        copies.cast("long").alias("copies"),
    )
