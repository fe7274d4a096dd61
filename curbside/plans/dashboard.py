"""Nested JSON documents for the dashboard: totals, forecasts, latest reports.

Only aggregates, forecasts and top-k rows get here.  A document is one row; where
a section may have more rows than a row can hold, ``section_lines`` gives the same
items as lines of JSON, one row each, which many tasks write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from curbside.functions.calendar import iso_date
from curbside.operators.aggregates import counts_by, kpi_of_areas
from curbside.operators.forecast import nested_forecast
from curbside.operators.scale import number_aggregate
from curbside.operators.schedule import collection_schedule

def _json(document: Column) -> Column:
    return F.to_json(document, {"ignoreNullFields": "false"}).alias("snapshot")


def _amount(name: str) -> Column:
    """Two fixed decimals, so that the text does not switch to exponents."""
    return F.col(name).cast("decimal(28,2)").alias(name)


def _section(rows: DataFrame, order: str, fields: list[Column]) -> Column:
    """The rows of an aggregate as an ordered array."""
    item = F.struct(F.col(order).alias("at"), F.struct(*fields).alias("item"))
    ordered = F.sort_array(F.collect_list(item))
    return rows.agg(F.transform(ordered, lambda x: x["item"])).scalar()


def section_lines(rows: DataFrame, section: str, order: str, fields: list[Column]) -> DataFrame:
    """The rows of an aggregate as lines: section, position in it, JSON of the item."""
    item = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.select(
        F.lit(section).alias("section"), F.col(order).cast("bigint").alias("position"), item.alias("item")
    )


def dashboard_sections(
    by_type: DataFrame, by_area: DataFrame, reports: DataFrame
) -> dict[str, tuple[DataFrame, str, list[Column]]]:
    """Name of each section with its rows, their order and the fields shown.

    The schedule comes from the area totals, so the records are read once for
    both.
    """
    at = "__at"
    types = number_aggregate(by_type, [F.desc("total_kg"), "waste_type"], at)
    areas = number_aggregate(by_area, [F.desc("total_kg"), "area"], at)
    statuses = number_aggregate(counts_by(reports, "status"), ["status"], at)
    amounts = [_amount("total_kg"), _amount("total_volume")]
    run = [F.col("area"), F.col("time"), F.col("priority"), _amount("estimated_volume")]
    return {
        "waste_by_type": (types, at, [F.col("waste_type"), *amounts]),
        "waste_by_area": (areas, at, [F.col("area"), *amounts, F.col("collections")]),
        "reports_summary": (statuses, at, [F.col("status"), F.col("count")]),
        "collection_schedule": (collection_schedule(areas), "run_order", run),
    }


def dashboard_lines(by_type: DataFrame, by_area: DataFrame, reports: DataFrame) -> DataFrame:
    """All sections as lines of JSON, whatever their size."""
    sections = dashboard_sections(by_type, by_area, reports)
    lines = [section_lines(rows, name, order, f) for name, (rows, order, f) in sections.items()]
    return reduce(DataFrame.unionAll, lines)


def dashboard_snapshot(by_type: DataFrame, by_area: DataFrame, reports: DataFrame) -> DataFrame:
    """One row with the JSON text.

    ``by_area`` carries, besides the totals, the sum and number of the moistures
    and the recyclable records, so the key figures cost no reading of their own.
    """
    sections = dashboard_sections(by_type, by_area, reports)
    areas, statuses = sections["waste_by_area"][0], sections["reports_summary"][0]
    shown = {name: _section(*section).alias(name) for name, section in sections.items()}
    stats = F.struct(
        _amount("total_waste_kg"),
        _amount("total_volume"),
        F.col("avg_moisture").cast("decimal(28,1)").alias("avg_moisture"),
        "recyclable_count",
        "total_records",
    )
    document = F.struct(
        shown["waste_by_type"],
        shown["waste_by_area"],
        shown["reports_summary"],
        stats.alias("stats"),
        statuses.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar().alias("total_reports"),
        shown["collection_schedule"],
    )
    return kpi_of_areas(areas).select(_json(document))


def forecast_snapshot(forecast: DataFrame) -> DataFrame:
    """Dates, areas, and per area the volumes in the order of the dates."""
    days = number_aggregate(forecast.select("prediction_date").distinct(), ["prediction_date"], "at")
    areas = number_aggregate(nested_forecast(forecast), ["area"], "at")
    volume = lambda day: day["predicted_volume"].cast("decimal(28,1)")
    per_area = _section(areas, "at", [F.col("area"), F.transform("days", volume).alias("volumes")])
    dates = _section(days, "at", [iso_date(F.col("prediction_date")).alias("date")])
    sections = forecast.sparkSession.range(1).select(
        dates.alias("dates"), per_area.alias("per_area")
    )
    document = F.struct(
        F.transform("dates", lambda d: d["date"]).alias("dates"),
        F.map_from_entries("per_area").alias("predictions"),
        F.transform("per_area", lambda a: a["area"]).alias("areas"),
    )
    return sections.select(_json(document))


def forecast_lines(forecast: DataFrame) -> DataFrame:
    """The sections of ``forecast_snapshot`` as lines of JSON, whatever the number of
    areas: dates, and per area the volumes in the order of the dates."""
    days = number_aggregate(forecast.select("prediction_date").distinct(), ["prediction_date"], "at")
    areas = number_aggregate(nested_forecast(forecast), ["area"], "at")
    volumes = F.transform("days", lambda day: day["predicted_volume"].cast("decimal(28,1)"))
    return section_lines(days, "dates", "at", [iso_date(F.col("prediction_date")).alias("date")]).unionAll(
        section_lines(areas, "predictions", "at", [F.col("area"), volumes.alias("volumes")])
    )


def nested_lines(forecast: DataFrame) -> DataFrame:
    """``nested_forecast`` as lines of JSON, one per area, with the area's place."""
    areas = number_aggregate(nested_forecast(forecast), ["area"], "at")
    days = F.transform(
        "days",
        lambda day: F.struct(
            iso_date(day["prediction_date"]).alias("date"),
            day["predicted_volume"].cast("decimal(28,1)").alias("predicted_volume"),
        ),
    )
    return section_lines(areas, "forecast", "at", [F.col("area"), days.alias("days")])


def reports_snapshot(latest: DataFrame) -> DataFrame:
    """The latest reports, newest first, and how many they are."""
    rows = number_aggregate(latest, [F.desc("created_at"), F.desc("id")], "at")
    fields = [F.col(c) for c in latest.columns if c != "created_at"]
    time = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    document = F.struct(
        _section(rows, "at", [*fields, time]).alias("reports"),
        rows.agg(F.count("*")).scalar().alias("count"),
    )
    return latest.sparkSession.range(1).select(_json(document))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as JSON files, a folder per section, by as many tasks as hold them; a
    reader sorts by position where it needs the order."""
    lines.write.mode("overwrite").partitionBy("section").json(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("overwrite").text(path)
