"""Pickup schedule and map layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curbside.functions import lookups
from curbside.operators.scale import attach, number_aggregate


def priority_band(
    volume: Column,
    high: Column | float = lookups.HIGH_ABOVE_LITERS,
    medium: Column | float = lookups.MEDIUM_ABOVE_LITERS,
) -> Column:
    """Strictly above a threshold; a value on it falls to the band below."""
    return F.when(volume > high, "High").when(volume > medium, "Medium").otherwise("Low")


def collection_schedule(
    volumes: DataFrame,
    area: str = "area",
    volume: str = "total_volume",
    slots: list[str] = lookups.TIME_SLOTS,
    high: Column | float = lookups.HIGH_ABOVE_LITERS,
    medium: Column | float = lookups.MEDIUM_ABOVE_LITERS,
    max_rows: int | None = None,
) -> DataFrame:
    """Areas from most to least volume, with run number, time slot and priority."""
    runs = number_aggregate(
        volumes.select(F.col(area).alias("area"), F.col(volume).alias("estimated_volume")),
        [F.desc("estimated_volume"), F.asc("area")],
        "run_order",
        max_rows,
    )
    slot = F.element_at(
        F.array(*[F.lit(s) for s in slots]),
        (((F.col("run_order") - 1) % len(slots)) + 1).cast("int"),
    )
    return runs.select(
        "run_order",
        "area",
        slot.alias("time"),
        priority_band(F.col("estimated_volume"), high, medium).alias("priority"),
        "estimated_volume",
    )


def first_runs(schedule: DataFrame, k: int = 3) -> DataFrame:
    return schedule.filter(F.col("run_order") <= k)


def zone_layer(
    volumes: DataFrame,
    zones: DataFrame,
    volume: str = "total_volume",
    high: Column | float = lookups.HIGH_ABOVE_LITERS,
    medium: Column | float = lookups.MEDIUM_ABOVE_LITERS,
) -> DataFrame:
    """Areas with coordinates, marker size, priority and next pickup time.  An area
    that is in no zone stays, without coordinates."""
    radius = F.lit(300) + F.col(volume) * 10
    layer = (
        attach(volumes, zones, ["area"], "left")
        .withColumn("priority", priority_band(F.col(volume), high, medium))
        .withColumn("radius", radius)
        .withColumn("halo_radius", radius * 1.5)
    )
    pickup = F.lit(None).cast("string")
    color = F.lit(None).cast("string")
    for name, time, hue in lookups.PRIORITY_STYLE:
        pickup = F.when(F.col("priority") == name, time).otherwise(pickup)
        color = F.when(F.col("priority") == name, hue).otherwise(color)
    return layer.select(
        "area",
        "lat",
        "lng",
        F.col(volume).alias("volume"),
        "radius",
        "halo_radius",
        "priority",
        pickup.alias("next_pickup"),
        color.alias("color"),
    )
