"""Collection records from CSV."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from curbside import schemas
from curbside.functions.calendar import as_date
from curbside.operators.scale import number_rows

_BAD = "_malformed"


def read_collections(
    spark: SparkSession, path: str, schema: T.StructType = schemas.COLLECTIONS_CSV
) -> DataFrame:
    """Rows of a CSV with header.  Values that do not fit the schema become null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def read_with_malformed(
    spark: SparkSession, path: str, schema: T.StructType = schemas.COLLECTIONS_CSV
) -> DataFrame:
    """As ``read_collections``, keeping the text of lines that do not fit."""
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType(), True)])
    return spark.read.schema(wide).csv(
        path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD
    )


def assign_dates(
    df: DataFrame,
    as_of: Column | dt.date | str,
    id_column: str = "id",
    name: str = "collection_date",
) -> DataFrame:
    """The n-th record (from 0) is dated n days before ``as_of``; ids are dense from 1.

    A record so far back that no date can say it has none.
    """
    back = (F.col(id_column).cast("bigint") - 1).try_cast("int")
    return df.withColumn(name, F.date_sub(as_date(as_of), back))


def assign_dates_in_order(
    df: DataFrame, as_of: Column | dt.date | str, order_by: list, name: str = "collection_date"
) -> DataFrame:
    """``assign_dates`` for records whose ids have gaps."""
    numbered = number_rows(df, order_by, "__row")
    return assign_dates(numbered, as_of, "__row", name).drop("__row")
