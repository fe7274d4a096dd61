"""Parquet tables: load if empty, append, insert if absent.

There is no transaction log, so each table has one writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from curbside.operators.quality import keep_first
from curbside.session import materialize


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None when nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_if_empty(df: DataFrame, path: str) -> bool:
    """Write ``df`` only when the table has no rows.  True if it was written."""
    present = read_or_none(df.sparkSession, path)
    if present is not None and not present.isEmpty():
        return False
    df.write.mode("append").parquet(path)
    return True


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows.  Rows of one partition go to few files; a hot one is split."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def only_absent(
    new: DataFrame,
    present: DataFrame,
    keys: list[str],
    day: str | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Rows of ``new`` whose key is not in ``present``; one row per key, the first
    in ``order_by`` (by default in the order of the other columns).

    Keys are compared with null as a value like others, so that a row with a null
    key is found again as well.  With ``day``, the partition column, only the days
    found in ``new`` are read.
    """
    new = materialize(first_of_key(new, keys, order_by))
    if day is not None:
        low, high, some = new.agg(F.min(day), F.max(day), F.count_if(F.col(day).isNull())).first()
        inside = F.col(day).between(F.lit(low), F.lit(high))
        present = present.filter(inside | F.col(day).isNull() if some else inside)
    old = present.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return new.join(old, same, "left_anti")


def first_of_key(new: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key."""
    rest = [c for c in new.columns if c not in keys]
    return keep_first(new, keys, rest if order_by is None else order_by) if rest else new.distinct()


def insert_if_absent(
    new: DataFrame,
    path: str,
    keys: list[str],
    partition_by: str | None = None,
    order_by: list[str] | None = None,
) -> None:
    """Append rows with a new key.  Rows already there stay as they are.

    Running it again with the same rows adds nothing.
    """
    present = read_or_none(new.sparkSession, path)
    if present is None:
        rows = first_of_key(new, keys, order_by)
    else:
        # The files of the table are listed here, so those added are not read.
        rows = only_absent(new, present, keys, partition_by, order_by)
    append(rows, path, [partition_by] if partition_by else None)
