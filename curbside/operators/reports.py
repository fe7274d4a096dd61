"""Citizen reports: cleaning, status counts, the latest ones, display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curbside.functions import text


def clean_reports(
    df: DataFrame, default_type: str = "Unknown", keep_status: bool = False
) -> DataFrame:
    """Fill in what the sender left out.

    A new report is pending whatever was sent; ``keep_status`` is for stored ones.
    """
    status = F.coalesce("status", F.lit("pending")) if keep_status else F.lit("pending")
    return df.select(
        "id",
        F.coalesce("reporter_name", F.lit("Anonymous")).alias("reporter_name"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("waste_type", F.lit(default_type)).alias("waste_type"),
        F.coalesce("description", F.lit("")).alias("description"),
        text.upload_name(F.col("created_at"), F.col("image_name")).alias("image_path"),
        status.alias("status"),
        "created_at",
    )


def latest_reports(df: DataFrame, k: int = 50) -> DataFrame:
    """The k newest reports, as a top-k without a full sort."""
    return (
        df.select(
            "id", "reporter_name", "location", "waste_type", "description", "status", "created_at"
        )
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(k)
    )


def display_columns(
    waste_type: str = "waste_type",
    status: str = "status",
    description: str = "description",
    created_at: str = "created_at",
) -> list[Column]:
    return [
        F.lower(waste_type).alias("type_badge"),
        text.or_dash(F.col(description)).alias("description_text"),
        text.first_upper(F.col(status)).alias("status_label"),
        text.first_underscore_as_space(F.col(status)).alias("status_text"),
        text.display_time(F.col(created_at)).alias("created_text"),
    ]


def report_display(df: DataFrame) -> DataFrame:
    """Rows as the report table shows them."""
    return df.select("id", "reporter_name", "location", *display_columns())
