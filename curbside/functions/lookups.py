"""Small fixed tables.  The largest has seven rows, so they are broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# They must stay as they are for the results to be right.

WASTE_TYPES = ["Glass", "Metal", "Organic", "Paper", "Plastic"]

AREAS = ["Clement Town", "Clock Tower", "ISBT", "Prem Nagar", "Rajpur Road"]

MATERIALS = ["biodegradable", "cellulose", "ferrous", "silica", "synthetic_polymer"]

DEFAULT_MATERIAL = "synthetic_polymer"
DEFAULT_WEIGHT_KG = 2.0
DEFAULT_MOISTURE_PCT = 20.0
DEFAULT_RECYCLABLE = 1

# waste_type, action, colour, tip
ADVICE = [
    ("Plastic", "Recycle", "#3b82f6", "Clean plastic items and deposit at blue recycling bin."),
    ("Organic", "Compost", "#22c55e", "Use green bin for wet waste. Can be composted at home."),
    ("Metal", "Recycle", "#f59e0b", "Metal is highly recyclable. Take to nearest scrap dealer."),
    ("Paper", "Recycle", "#8b5cf6", "Keep paper dry and bundle for recycling pickup."),
    ("Glass", "Recycle", "#06b6d4", "Handle carefully. Glass is 100% recyclable without quality loss."),
]
FALLBACK_ADVICE = "Plastic"

# waste_type, bin colour
BINS = [
    ("Plastic", "Blue"),
    ("Organic", "Green"),
    ("Metal", "Yellow"),
    ("Paper", "Purple"),
    ("Glass", "Teal"),
]

# area, litres a day
BASE_VOLUMES = [
    ("Clock Tower", 65.0),
    ("ISBT", 55.0),
    ("Rajpur Road", 45.0),
    ("Prem Nagar", 38.0),
    ("Clement Town", 32.0),
]

# weekday, factor
DAY_MULTIPLIERS = [
    ("Monday", 0.92),
    ("Tuesday", 0.97),
    ("Wednesday", 0.95),
    ("Thursday", 1.02),
    ("Friday", 1.05),
    ("Saturday", 1.18),
    ("Sunday", 0.85),
]

# area, latitude, longitude
ZONES = [
    ("Clock Tower", 30.3247, 78.0413),
    ("ISBT", 30.2921, 78.0492),
    ("Rajpur Road", 30.3559, 78.0637),
    ("Prem Nagar", 30.2875, 78.0161),
    ("Clement Town", 30.2701, 78.0213),
]

TIME_SLOTS = ["6:00 AM", "8:00 AM", "10:00 AM", "12:00 PM", "2:00 PM"]

# priority, next pickup, marker colour
PRIORITY_STYLE = [
    ("High", "6:00 AM", "#ef4444"),
    ("Medium", "8:00 AM", "#f59e0b"),
    ("Low", "10:00 AM", "#22c55e"),
]

HIGH_ABOVE_LITERS = 400.0
MEDIUM_ABOVE_LITERS = 200.0

RECORDS_PER_DAY = 8.5
FORECAST_CONFIDENCE = 0.87
AREA_CAPACITY_LITERS = 80.0

# The rules in order: label, confidence.
RULE_RESULTS = {
    "wet": ("Organic", 0.85),
    "synthetic_polymer": ("Plastic", 0.82),
    "ferrous": ("Metal", 0.88),
    "cellulose": ("Paper", 0.80),
    "other": ("Glass", 0.78),
}
WET_ABOVE_PCT = 50.0


def small_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A literal table as a local relation, without a Python job."""
    table = pa.table({name: [row[i] for row in rows] for i, name in enumerate(columns)})
    return spark.createDataFrame(table)


def advice(spark: SparkSession) -> DataFrame:
    return small_table(spark, ADVICE, ["waste_type", "action", "color", "tip"])


def bins(spark: SparkSession) -> DataFrame:
    return small_table(spark, BINS, ["waste_type", "bin_color"])


def base_volumes(spark: SparkSession) -> DataFrame:
    return small_table(spark, BASE_VOLUMES, ["area", "base_volume"])


def day_multipliers(spark: SparkSession) -> DataFrame:
    return small_table(spark, DAY_MULTIPLIERS, ["day_name", "multiplier"])


def zones(spark: SparkSession) -> DataFrame:
    return small_table(spark, ZONES, ["area", "lat", "lng"])


def codes(spark: SparkSession, values: list[str], column: str) -> DataFrame:
    """Codes 0, 1, 2... in alphabetical order of a declared vocabulary."""
    ordered = sorted(values)
    rows = [(value, code) for code, value in enumerate(ordered)]
    return small_table(spark, rows, [column, "code"])
