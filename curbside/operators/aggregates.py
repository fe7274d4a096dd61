"""Totals, key figures, counts and area-by-type matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curbside.functions.numeric import (
    exact_mean,
    exact_sum,
    half_away,
    half_up,
    merged_sum,
    partial_sums,
    rounded,
)
from curbside.operators.scale import attach, fits_broadcast
from curbside.session import materialize

#: Output name -> measure column.
MEASURES = {"total_kg": "weight_kg", "total_volume": "volume_liters"}


def totals_by(
    df: DataFrame,
    group: list[str],
    measures: dict[str, str] = MEASURES,
    count_as: str | None = None,
    digits: int = 2,
) -> DataFrame:
    """Sum the measures per group; optionally count the rows."""
    sums = [rounded(exact_sum(c), digits).alias(name) for name, c in measures.items()]
    counts = [F.count("*").alias(count_as)] if count_as else []
    return df.groupBy(*group).agg(*sums, *counts)


def totals_through(
    fact: DataFrame,
    dim: DataFrame,
    link: str,
    group: list[str],
    measures: dict[str, str] = MEASURES,
    count_as: str | None = None,
    digits: int = 2,
    max_rows: int | None = None,
) -> DataFrame:
    """``totals_by`` when a group column sits in another table.

    ``dim`` has each ``link`` once.  If it is too large to broadcast, the
    measures are first summed per link, so that the join moves one row per
    link and a hot link weighs no more than any other.
    """
    if fits_broadcast(dim, max_rows):
        return totals_by(fact.join(F.broadcast(dim), link), group, measures, count_as, digits)
    own = [c for c in group if c in fact.columns]
    partials = [p for name, c in measures.items() for p in partial_sums(c, name)]
    per_link = fact.groupBy(link, *own).agg(*partials, F.count("*").alias("__rows"))
    sums = [rounded(merged_sum(name), digits).alias(name) for name in measures]
    counts = [F.sum("__rows").alias(count_as)] if count_as else []
    return per_link.join(dim, link).groupBy(*group).agg(*sums, *counts)


def largest_first(totals: DataFrame, measure: str, *ties: str) -> DataFrame:
    return totals.orderBy(F.desc(measure), *ties)


def with_scaled_count(totals: DataFrame, count: str = "collections", factor: int = 10) -> DataFrame:
    """The count stretched for a second chart axis."""
    return totals.withColumn(f"{count}_scaled", F.col(count) * factor)


def kpi_stats(
    df: DataFrame,
    weight: str = "weight_kg",
    volume: str = "volume_liters",
    moisture: str = "moisture_pct",
    recyclable: str = "recyclable",
) -> DataFrame:
    """One row of key figures; on an empty table the sums are null, the count 0."""
    return df.agg(
        rounded(exact_sum(weight)).alias("total_waste_kg"),
        rounded(exact_sum(volume)).alias("total_volume"),
        half_away(exact_mean(moisture), 1).alias("avg_moisture"),
        F.sum(F.when(F.col(recyclable) == 1, 1).otherwise(0)).alias("recyclable_count"),
        F.count("*").alias("total_records"),
    )


#: Sums beside the area totals from which the key figures follow.
KPI_MEASURES = {**MEASURES, "moisture_sum": "moisture_pct", "recyclable_count": "recyclable"}


def kpi_of_areas(areas: DataFrame) -> DataFrame:
    """``kpi_stats`` from area totals that carry ``moisture_sum``, ``moisture_count``
    and ``recyclable_count``."""
    mean = exact_sum("moisture_sum").cast("double") / F.sum("moisture_count")
    return areas.agg(
        rounded(exact_sum("total_kg")).alias("total_waste_kg"),
        rounded(exact_sum("total_volume")).alias("total_volume"),
        half_away(mean, 1).alias("avg_moisture"),
        F.sum("recyclable_count").cast("bigint").alias("recyclable_count"),
        F.coalesce(F.sum("collections"), F.lit(0)).alias("total_records"),
    )


def recyclable_share(count: Column, total: Column) -> Column:
    """Whole percent, 0 when there are no records."""
    return F.when(total > 0, half_up(count / total * 100)).otherwise(F.lit(0.0))


def kpi_cards(stats: DataFrame, total_reports: DataFrame | None = None) -> DataFrame:
    """The cards above the dashboard: tonnes, litres, recyclable share, reports."""
    cards = stats.select(
        half_up(F.col("total_waste_kg") / 1000, 1).alias("total_waste_tonnes"),
        half_up(F.col("total_volume")).alias("total_volume_liters"),
        recyclable_share(F.col("recyclable_count"), F.col("total_records")).alias(
            "recyclable_pct"
        ),
    )
    if total_reports is not None:
        cards = cards.withColumn("total_reports", total_reports.agg(F.count("*")).scalar())
    return cards


def recyclable_split(stats: DataFrame) -> DataFrame:
    """Two rows, recyclable and not; no rows when there are no records."""
    yes = F.coalesce("recyclable_count", F.lit(0))
    slices = F.array(
        F.struct(F.lit("Recyclable").alias("label"), yes.alias("records")),
        F.struct(
            F.lit("Non-Recyclable").alias("label"),
            (F.col("total_records") - yes).alias("records"),
        ),
    )
    return stats.filter("total_records > 0").select(F.inline(slices))


def counts_by(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share in percent of each value; nulls are left out."""
    counts = materialize(counts_by(df.filter(F.col(column).isNotNull()), column, "n"))
    total = counts.agg(F.sum("n")).scalar()
    share = half_up(F.col("n") / total * 100, 1)
    return counts.withColumn("share_pct", share).orderBy(F.desc("n"), column)


def declared_or_other(column: Column | str, values: list[str], other: str = "other") -> Column:
    """The value if it is declared, else ``other``; a missing value is other too."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value.isin(values), value).otherwise(F.lit(other))


def pivot_totals(
    cells: DataFrame, row: str, column: str, measure: str, values: list, other: str = "other"
) -> DataFrame:
    """Spread the totals of ``(row, column)`` cells; an empty cell is 0.

    What is not declared is summed up in a column ``other``, so that rows keep
    their totals.
    """
    shown = cells.withColumn(column, declared_or_other(column, values, other))
    names = [*values, other]
    return shown.groupBy(row).pivot(column, names).agg(F.sum(measure)).na.fill(0.0, subset=names)


def matrix_estimate(
    by_area: DataFrame,
    by_type: DataFrame,
    area: str = "area",
    total: str = "total_kg",
) -> DataFrame:
    """Area x type matrix guessed from the margins alone, with cell intensity.

    ``by_type`` has a row for each type in the data; they are carried to the areas
    as one array, so each area yields as many cells as there are types.
    """
    pair = F.struct(F.col("waste_type"), F.col(total).alias("type_kg"))
    types = by_type.agg(F.array_sort(F.collect_list(pair))).scalar()
    cells = by_area.select(area, F.col(total).alias("__area_kg"), F.inline(types))
    estimate = half_up(F.col("__area_kg") * F.col("type_kg") / 1000 * 0.1, 1)
    cells = cells.select(area, "waste_type", estimate.alias("estimate"))
    peak = cells.agg(F.max("estimate")).scalar()
    return cells.withColumn(
        "intensity", F.when(peak > 0, F.col("estimate") / peak).otherwise(F.lit(0.0))
    )


def group_total(
    df: DataFrame,
    keys: list[str],
    measure: str,
    name: str = "group_total",
    totals: DataFrame | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Give every row the total of its group.

    A window would gather each group in one task.  Here the totals are
    aggregated first and joined back.  ``totals`` hands them in where there is a
    shorter way to them than through all rows of ``df``.
    """
    if totals is None:
        totals = totals_by(df, keys, {name: measure})
    return attach(df, materialize(totals), keys, "left", max_rows=max_rows)
