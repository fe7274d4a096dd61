"""Display text for reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DASH = "—"


def first_upper(c: Column) -> Column:
    """Only the first letter changes; ``initcap`` would change every word."""
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2)))


def first_underscore_as_space(c: Column) -> Column:
    return F.regexp_replace(c, "^([^_]*)_", "$1 ")


def or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(DASH))


def display_time(ts: Column) -> Column:
    """For example ``05 Jan 24, 12:07 am``."""
    text = F.concat(
        F.date_format(ts, "dd MMM yy, hh:mm "), F.lower(F.date_format(ts, "a"))
    )
    return F.coalesce(text, F.lit(DASH))


def upload_name(ts: Column, file_name: Column) -> Column:
    """Null when there is no file or its name is empty."""
    return F.concat(
        F.date_format(ts, "yyyyMMdd_HHmmss"),
        F.lit("_"),
        F.nullif(file_name, F.lit("")),
    )
