"""Seven-day volume forecasts, their fallback and the figures shown with them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside.functions import calendar, lookups
from curbside.functions.hashing import hash_bucket
from curbside.functions.numeric import exact_sum, half_even, half_up, known, rounded
from curbside.operators import forest
from curbside.operators.scale import attach
from curbside.session import materialize

FEATURES = ["area", "day_of_week", "month"]


def forecast_grid(areas: DataFrame, as_of: Column | dt.date | str, days: int = 7) -> DataFrame:
    """Each area on each of the coming days, ``as_of`` being the first."""
    start = calendar.as_date(as_of)
    day = F.col("prediction_date")
    return areas.select(
        "area", F.posexplode(calendar.days_from(start, days)).alias("day_no", "prediction_date")
    ).select(
        "area",
        "day_no",
        "prediction_date",
        calendar.weekday_name(day).alias("day_of_week"),
        F.month(day).alias("month"),
        calendar.short_label(day).alias("label"),
        calendar.is_weekend(day).cast("int").alias("is_weekend"),
    )


def base_volumes(daily: DataFrame) -> DataFrame:
    """Mean volume per day and area, from ``(area, collection_date, total_volume)``."""
    mean = exact_sum("total_volume").cast("double") / F.count("*")
    return daily.groupBy("area").agg(mean.alias("base_volume"))


def day_multipliers(daily: DataFrame) -> DataFrame:
    """How a weekday's mean volume compares with the mean of all days."""
    days = daily.groupBy("collection_date").agg(rounded(exact_sum("total_volume"), 6).alias("v"))
    mean = exact_sum("v").cast("double") / F.count("*")
    overall = days.agg(mean.alias("m")).scalar()
    by_weekday = days.groupBy(calendar.weekday_name(F.col("collection_date")).alias("day_name"))
    return by_weekday.agg(mean.alias("m")).select("day_name", (F.col("m") / overall).alias("multiplier"))


def fallback_forecast(
    grid: DataFrame,
    base: DataFrame,
    multipliers: DataFrame,
    noise: float = 0.0,
    seed: int = 42,
    max_rows: int | None = None,
) -> DataFrame:
    """Base volume of the area x factor of the weekday.

    A weekday without a factor counts as 1.  ``noise`` of 0.05 varies the result by
    up to 5 % either way, the same for an area and day on every run.
    """
    factors = multipliers.select(F.col("day_name").alias("day_of_week"), "multiplier")
    volume = F.col("base_volume") * F.coalesce("multiplier", F.lit(1.0))
    if noise:
        drawn = hash_bucket(F.concat_ws("|", "area", "prediction_date"), 1_000_000, seed) / 999_999
        volume = volume * (1 + (drawn * 2 - 1) * noise)
    with_base = attach(grid, base, ["area"], "left", max_rows=max_rows)
    return (
        attach(with_base, factors, ["day_of_week"], "left", max_rows=max_rows)
        .withColumn("predicted_volume", half_even(volume, 1))
        .drop("base_volume", "multiplier")
    )


#: Categories of the volume model; each gets codes in the order of its mean volume.
CATEGORIES = {"area": "area_code", "day_of_week": "day_code"}
CELL = ["area_code", "day_code", "month"]
#: Code of a value that was not there in training.
UNSEEN = -1


@dataclass(frozen=True)
class VolumeModel:
    """A forest as what it says of each cell.

    ``codes`` has the code of each area and weekday, however many there are;
    ``by_tree`` each tree's prediction per cell, ``cells`` their mean, with the cells of
    unseen areas and weekdays.  Cells are bounded by the number of codes.
    """

    codes: dict[str, DataFrame]
    by_tree: DataFrame
    cells: DataFrame

    def save(self, path: str) -> None:
        for category, codes in self.codes.items():
            codes.write.parquet(f"{path}/codes/{category}")
        self.by_tree.write.parquet(f"{path}/by_tree")
        self.cells.coalesce(1).write.parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VolumeModel:
        codes = {c: spark.read.parquet(f"{path}/codes/{c}") for c in CATEGORIES}
        return cls(codes, *[spark.read.parquet(f"{path}/{part}") for part in ("by_tree", "cells")])


def category_codes(records: DataFrame, column: str, name: str, bins: int) -> DataFrame:
    """(value, code): codes 0, 1, 2... by mean volume, at most ``bins`` of them.

    Where there are more values, those of about equal means share a code.  The
    means are one distributed aggregate; only the bounds between codes are
    collected.
    """
    totals = records.groupBy(column).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    means = materialize(totals.select(column, (F.col("total").cast("double") / F.col("n")).alias("mean")))
    shares = [k / bins for k in range(1, bins)]
    bounds = means.agg(F.percentile_approx("mean", shares, 10 * bins * bins)).first()[0] or []
    below = F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col("mean"))
    return means.select(column, (F.size(below) if bounds else F.lit(0)).alias(name))


def _month(month: Column | str = "month") -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(12), month)).cast("int")


def _all_cells(counted: DataFrame) -> DataFrame:
    """Every combination of codes and months, with 0 records where there are none."""
    last = counted.agg(*[F.max(c).alias(c) for c in CATEGORIES.values()])
    grid = last.where("area_code IS NOT NULL")
    for name in CATEGORIES.values():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(name))))
    grid = grid.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return grid.join(counted, CELL, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _with_unseen(cells: DataFrame, counted: DataFrame) -> DataFrame:
    """Also the cells of unseen areas and weekdays: the mean of the seen ones, each
    as often as its records."""
    weighed = cells
    for name in CATEGORIES.values():
        share = counted.groupBy(name).agg(F.sum("n").alias(f"{name}_n"))
        weighed = weighed.join(share, name)
    parts = [cells]
    for unseen in ([*CATEGORIES.values()][:1], [*CATEGORIES.values()][1:], [*CATEGORIES.values()]):
        weight = reduce(lambda a, b: a * b, [F.col(f"{name}_n").cast("double") for name in unseen])
        mean = F.sum(F.col("prediction") * weight) / F.sum(F.when(F.col("prediction").isNotNull(), weight))
        kept = [c for c in CELL if c not in unseen]
        group = weighed.groupBy(*kept).agg(mean.alias("prediction"))
        parts.append(group.select(*[F.lit(UNSEEN).alias(c) if c in unseen else c for c in CELL], "prediction"))
    return reduce(DataFrame.unionByName, parts)


def train_volume(
    df: DataFrame,
    trees: int = 100,
    max_depth: int = 10,
    max_bins: int = 32,
    seed: int = 42,
) -> VolumeModel:
    """Area, weekday and month to volume per record, by a random forest.

    ``df`` has one row per record.  Records are counted once, by distinct features;
    areas and weekdays become at most ``max_bins - 1`` codes each; the trees are
    grown from the counted cells (see ``forest``).  Records with a null feature
    teach nothing.
    """
    features = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in FEATURES])
    known_rows = df.filter(features & known("volume_liters").isNotNull())
    volume = known("volume_liters")
    counted = known_rows.groupBy("area", "day_of_week", _month().alias("month")).agg(
        F.count("*").alias("n"),
        exact_sum(volume).alias("total"),
        F.sum(volume * volume).alias("squares"),
        F.min(volume).alias("low"),
        F.max(volume).alias("high"),
    )
    counted = materialize(counted)
    codes = {c: materialize(category_codes(counted, c, name, max_bins - 1)) for c, name in CATEGORIES.items()}
    coded = counted
    for category, table in codes.items():
        coded = attach(coded, table, [category])
    merged = coded.groupBy(*CELL).agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("low").alias("low"), F.max("high").alias("high")
    )
    mean = F.col("total").cast("double") / F.col("n")
    variance = F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean)
    cells = materialize(
        merged.select(*CELL, "n", mean.alias("mean"), variance.alias("variance"), "low", "high")
    )
    points = forest.bootstrap(_all_cells(cells), CELL, trees, seed)
    by_tree = materialize(forest.grow(points, CELL, max_depth))
    mean_of_trees = materialize(by_tree.groupBy(*CELL).agg(F.avg("prediction").alias("prediction")))
    return VolumeModel(codes, by_tree, materialize(_with_unseen(mean_of_trees, cells)))


def predict_volume(df: DataFrame, model: VolumeModel, name: str = "predicted") -> DataFrame:
    """Volume per record by the model; null where a feature is null.  An area or
    weekday the model has not seen counts as the mean of those it has.  The cells
    are bounded by the codes, so their table is broadcast."""
    coded = df.withColumn("__month", _month())
    for category, code in CATEGORIES.items():
        table = model.codes[category].select(category, F.col(code).alias(f"__{code}"))
        coded = attach(coded, table, [category], "left")
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in FEATURES])
    for code in CATEGORIES.values():
        seen = F.coalesce(f"__{code}", F.lit(UNSEEN))
        coded = coded.withColumn(f"__{code}", F.when(whole, seen))
    cells = model.cells.select(*[F.col(c).alias(f"__{c}") for c in CELL], F.col("prediction").alias("__volume"))
    scored = coded.join(F.broadcast(cells), [f"__{c}" for c in CELL], "left")
    return scored.select(*df.columns, F.col("__volume").alias(name))


def model_forecast(
    grid: DataFrame, model: VolumeModel, per_day: float = lookups.RECORDS_PER_DAY
) -> DataFrame:
    """Predicted volume per record, scaled to a day; null where a feature is null."""
    scored = predict_volume(grid, model, "__predicted")
    return scored.select(
        *grid.columns, half_even(F.col("__predicted") * per_day, 1).alias("predicted_volume")
    )


def with_fallback(model_based: DataFrame, fallback: DataFrame) -> DataFrame:
    """The model's value where it has one, else the fallback's."""
    keys = ["area", "prediction_date"]
    other = fallback.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("predicted_volume").alias("__fallback")
    )
    same = F.col("area").eqNullSafe(F.col("__area")) & (
        F.col("prediction_date") == F.col("__prediction_date")
    )
    return (
        model_based.join(other, same, "left")
        .withColumn("predicted_volume", F.coalesce("predicted_volume", "__fallback"))
        .drop("__fallback", "__area", "__prediction_date")
    )


def forecast_volumes(grid: DataFrame, model: VolumeModel | None, fallback: DataFrame) -> DataFrame:
    """The forecast: by the model, and by the fallback for rows the model has no
    value for.  Without a model (none stored, or not readable) all of it falls
    back."""
    if model is None:
        return fallback
    return with_fallback(model_forecast(grid, model), fallback)


def to_predictions(
    forecast: DataFrame,
    created_at: Column | str,
    confidence: float = lookups.FORECAST_CONFIDENCE,
) -> DataFrame:
    """Rows for the predictions table."""
    stamp = created_at if isinstance(created_at, Column) else F.lit(created_at)
    return forecast.select(
        "area",
        "predicted_volume",
        "prediction_date",
        F.lit(float(confidence)).alias("confidence"),
        stamp.cast("timestamp").alias("created_at"),
    )


def nested_forecast(forecast: DataFrame) -> DataFrame:
    """One row per area with its days as an array, in day order."""
    day = F.struct("day_no", "prediction_date", "predicted_volume")
    return forecast.groupBy("area").agg(F.sort_array(F.collect_list(day)).alias("days"))


def forecast_kpis(forecast: DataFrame) -> DataFrame:
    """Total of the first day, and the day with the largest total (earliest on ties)."""
    days = forecast.groupBy("day_no", "prediction_date").agg(
        rounded(exact_sum("predicted_volume"), 1).alias("total")
    )
    first = F.max(F.when(F.col("day_no") == 0, F.col("total")))
    peak = F.max(F.struct("total", (-F.col("day_no")).alias("order"), "prediction_date"))
    return days.agg(first.alias("day1_total"), peak.alias("peak")).select(
        half_up(F.col("day1_total")).alias("day1_total"),
        calendar.iso_date(F.col("peak.prediction_date")).alias("peak_date"),
        calendar.weekday_name(F.col("peak.prediction_date")).alias("peak_day"),
        half_up(F.col("peak.total")).alias("peak_total"),
    )


def capacity_use(
    forecast: DataFrame, capacity: Column | float = lookups.AREA_CAPACITY_LITERS
) -> DataFrame:
    """Share of the area's capacity, at most 100 %, and its band."""
    pct = F.least(F.lit(100.0), F.col("predicted_volume") / capacity * 100)
    return forecast.withColumn("capacity_pct", pct).withColumn(
        "band",
        F.when(F.col("capacity_pct") > 70, "high")
        .when(F.col("capacity_pct") > 45, "mid")
        .otherwise("low"),
    )
