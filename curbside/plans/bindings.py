"""The given tables in the roles the operators expect.

``lineitem`` rows are collections; their area comes from ``orders`` and their
type and material from ``part``.  ``events`` are reports, requests, or records
with a unique id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside.functions import lookups
from curbside.operators.scale import attach, fits_broadcast, hot_keys_of

AREA_OF_PRIORITY = {
    "1-URGENT": "Clock Tower",
    "2-HIGH": "ISBT",
    "3-MEDIUM": "Rajpur Road",
    "4-NOT SPECIFIED": "Prem Nagar",
    "5-LOW": "Clement Town",
}

TYPE_OF_PART = {
    "ECONOMY": "Glass",
    "LARGE": "Metal",
    "MEDIUM": "Organic",
    "PROMO": "Paper",
    "SMALL": "Plastic",
    "STANDARD": "Mixed",
}

#: By brand number modulo six; the last is not among the known materials.
MATERIAL_OF_BRAND = [*lookups.MATERIALS, "composite"]

#: The types of collections and reports, in alphabetical order.
ALL_TYPES = sorted([*lookups.WASTE_TYPES, "Mixed"])

STATUS_OF_EVENT = {
    "click": "pending",
    "view": "in_progress",
    "purchase": "resolved",
    "signup": "waiting_for_crew",
    "error": "rejected",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, mapping: dict[str, str]) -> Column:
    first, *rest = mapping.items()
    start = F.when(F.col(column) == first[0], first[1])
    return reduce(lambda c, kv: c.when(F.col(column) == kv[0], kv[1]), rest, start)


def _picked(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def area_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        _mapped("o_orderpriority", AREA_OF_PRIORITY).alias("area"),
    )


def part_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        _mapped("p_type", TYPE_OF_PART).alias("waste_type"),
        _picked(brand % 6, MATERIAL_OF_BRAND).alias("material_type"),
    )


def collection_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collections without area, type and material, which other tables hold."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.col("l_quantity").alias("weight_kg"),
        F.col("l_extendedprice").alias("volume_liters"),
        (F.col("l_discount") * 1000).alias("moisture_pct"),
        (F.col("l_returnflag") != "R").cast("int").alias("recyclable"),
        day.alias("collection_date"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        F.month(day).alias("month"),
    )


MEASURES = ["weight_kg", "volume_liters", "moisture_pct", "recyclable"]
FROM_ORDERS = ["area"]
FROM_PART = ["waste_type", "material_type"]


def collections(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Collections with the columns asked for; only the tables behind them are joined."""
    facts = collection_facts(spark, sf_dir)
    sides = [
        ([link], dim(spark, sf_dir).select(link, *wanted))
        for names, dim, link in (
            (FROM_ORDERS, area_dim, "l_orderkey"),
            (FROM_PART, part_dim, "l_partkey"),
        )
        if (wanted := [c for c in names if c in columns])
    ]
    small = [fits_broadcast(dim) for _, dim in sides]
    # Hot keys of all large sides come from one reading, before any join.
    large = [keys for (keys, _), fits in zip(sides, small) if not fits]
    hot = dict(zip([keys[0] for keys in large], hot_keys_of(facts, large) if large else []))
    rows = facts.count() if large else None
    df = facts
    for (keys, dim), fits in zip(sides, small):
        df = attach(df, dim, keys, small=fits, hot=hot.get(keys[0]), rows=rows)
    return df.select(*columns)


def _event_number(column: str = "props") -> Column:
    return F.get_json_object(column, "$.k")


def reports(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as raw reports: some fields are missing or empty."""
    user = F.col("user_id")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(user % 10 != 0, F.concat(F.lit("citizen "), user.cast("string"))).alias("reporter_name"),
        F.when(user % 7 != 0, _picked(user % 5, lookups.AREAS)).alias("location"),
        F.when(user % 9 != 0, _picked(user % 6, ALL_TYPES)).alias("waste_type"),
        F.when(F.col("event_type") != "view", F.col("props")).otherwise(F.lit("")).alias("description"),
        F.when(
            F.col("event_type") == "purchase", F.concat(F.col("event_id").cast("string"), F.lit(".jpg"))
        ).alias("image_name"),
        _mapped("event_type", STATUS_OF_EVENT).alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def requests(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as raw requests, all text.

    An error event sends its payload instead of a number, so its cast fails;
    a view leaves the moisture out.
    """
    user = F.col("user_id")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(user % 10 != 0, F.col("value").cast("string")).alias("weight_kg"),
        F.when(kind == "error", F.col("props"))
        .when(kind == "view", F.lit(None).cast("string"))
        .otherwise(_event_number())
        .alias("moisture_pct"),
        F.when(user % 7 != 0, (user % 2).cast("string")).alias("recyclable"),
        F.when(user % 9 != 0, _picked(user % 6, MATERIAL_OF_BRAND)).alias("material_type"),
    )


def event_records(events: DataFrame) -> DataFrame:
    """Events as collection records with a unique, dense id from 1."""
    user = F.col("user_id")
    day = F.col("ts").cast("date")
    return events.select(
        (F.col("event_id") + 1).alias("id"),
        _picked(user % 5, lookups.AREAS).alias("area"),
        _picked(user % 6, ALL_TYPES).alias("waste_type"),
        F.col("value").alias("weight_kg"),
        _event_number().cast("double").alias("moisture_pct"),
        (F.col("event_type") != "error").cast("int").alias("recyclable"),
        _picked(user % 6, MATERIAL_OF_BRAND).alias("material_type"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        F.month(day).alias("month"),
        (F.col("value") * 2.5).alias("volume_liters"),
    )
