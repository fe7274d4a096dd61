"""Checks of what the tables promise: no nulls, no repeats, defaults, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from curbside.operators.scale import number_rows


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of nulls, from a single pass."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return nulls.unpivot([], columns, "column", "nulls")


def split_not_null(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows and rows to set aside; each row is in exactly one of them."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.filter(~bad), df.filter(bad)


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found more than once.  Null keys do not clash, as in SQL."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def repeated_texts(df: DataFrame, column: str) -> DataFrame:
    """``unique_violations`` for long texts: only a digest is shuffled."""
    digest = F.sha2(F.col(column), 256).alias("digest")
    return unique_violations(df.select(digest), ["digest"])


def keep_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Repair: the first row of each key.

    An aggregate picks the row, so copies shrink before the shuffle; a ranking
    window would gather them all.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order_by], *[F.col(c) for c in rest if c not in order_by])
    first = df.groupBy(*keys).agg(F.min(ranked).alias("__row"))
    picked = [F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    return first.select(*picked)


def apply_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def assign_ids(df: DataFrame, order_by: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Dense ids from ``start`` in the given order, like an auto-increment key."""
    return number_rows(df, order_by, name, start)


def stable_key(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """An id which is the same on every retry: a digest of the natural key."""
    parts = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return df.withColumn(name, F.sha2(parts, 256))
