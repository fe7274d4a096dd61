"""Joins, numbering and running totals which hold up when one key is hot.

* A side is broadcast only after its rows were counted and their bytes summed.
* Beyond that size, the rows of keys found hot on a sample are joined where they
  are, and only the others are shuffled.  The sample decides how a row gets to
  its match, never which rows are in the result.
* Numbering and running totals over a whole table use the partitions of a
  distributed sort, so no task sees more than its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from curbside.session import fresh_path, materialize

#: Rows, and bytes by the widths below, that are safe to copy to every executor.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

#: Rows of an aggregate that one task may sort.
ONE_TASK_ROWS = 100_000

#: Rows of a large table that one task of a join or a numbering gets, about, so that a
#: task's memory stays what it is while the table grows.
ROWS_PER_TASK = 500_000

#: Keys a sketch of frequent items keeps count of.
_TRACKED_KEYS = 10_000

_POSITION = "__position"
_PART = "__part"
_POSITION_BITS = 33


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def task_count(df: DataFrame, rows: int) -> int:
    """Tasks for so many rows: no fewer than cores, no more rows in one than it can hold."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in memory, about: texts and collections by their content."""
    parts = [F.lit(16)]
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(field.name), F.lit(0)) + 16)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) * 2 + 16)
        else:
            parts.append(F.lit(16))
    return reduce(lambda a, b: a + b, parts).cast("bigint")


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether all rows together are few and small.

    For a stored table the count reads file footers only; bytes are summed where
    rows are few and some column has no fixed width.
    """
    rows = df.count()
    if rows > (BROADCAST_ROWS if max_rows is None else max_rows):
        return False
    if all(isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType)) for f in df.schema):
        return rows * 16 * (len(df.columns) + 1) <= BROADCAST_BYTES
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= BROADCAST_BYTES


def _one_key(keys: list[str]) -> Column:
    return F.col(keys[0]) if len(keys) == 1 else F.xxhash64(*keys)


def hot_keys_of(df: DataFrame, links: list[list[str]], fraction: float = 0.01) -> list[list]:
    """Per link (a list of key columns) the keys that fill more than one fair share
    of the partitions, all links in one reading.

    A frequent-items sketch over a sample finds them; what is merged and returned
    is bounded by the sketch, whatever the number of keys.  Several key columns
    are taken as one by their hash.
    """
    shares = _partitions(df)
    tracked = max(_TRACKED_KEYS, 10 * shares)
    columns = [_one_key(keys).alias(f"__key{i}") for i, keys in enumerate(links)]
    sketches = [
        F.struct(
            F.expr(f"approx_top_k(__key{i}, {shares}, {tracked}) FILTER (WHERE __key{i} IS NOT NULL)").alias("top"),
            F.count(f"__key{i}").alias("rows"),
        ).alias(f"s{i}")
        for i in range(len(links))
    ]
    found = df.select(*columns).sample(fraction, seed=11).agg(*sketches).first()
    return [
        [hit["item"] for hit in found[f"s{i}"]["top"] or [] if hit["count"] * shares > found[f"s{i}"]["rows"]]
        for i in range(len(links))
    ]


def hot_keys(df: DataFrame, keys: list[str], fraction: float = 0.01) -> list:
    return hot_keys_of(df, [keys], fraction)[0]


def attach(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    max_rows: int | None = None,
    small: bool | None = None,
    fraction: float = 0.01,
    hot: list | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join a large table with one that has each key once.

    A small ``dim`` is broadcast.  Of a large one only the rows of hot keys are,
    no more than there are partitions: the crowded rows, and those without a
    key, stay where they are and only the rest is shuffled.  ``small`` hands in
    a size check already made, ``hot`` hot keys already found, and ``rows`` a count
    of ``fact``, from which follow the tasks of the shuffled join.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if fits_broadcast(dim, max_rows) if small is None else small:
        return fact.join(F.broadcast(dim), keys, how)
    if hot is None:
        hot = hot_keys(fact, keys, fraction)

    def dealt(df: DataFrame) -> DataFrame:
        return df if rows is None else df.repartition(task_count(df, rows), *keys)

    if not hot:
        return dealt(fact).join(dim, keys, how)
    is_hot = F.coalesce(_one_key(keys).isin(hot), F.lit(True))
    crowded = fact.filter(is_hot).join(F.broadcast(dim.filter(_one_key(keys).isin(hot))), keys, how)
    return crowded.unionByName(dealt(fact.filter(~is_hot)).join(dim, keys, how))


def _by_part(ordered: DataFrame, weight: Column) -> DataFrame:
    """Per partition of a sorted table: the weight of all partitions before it."""
    sums = ordered.groupBy(_PART).agg(F.sum(weight).alias("__in_part"))
    # One row per partition of the sort, so this window is small.
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        _PART, F.coalesce(F.sum("__in_part").over(before), F.lit(0)).alias("__before_part")
    )


def _sorted_parts(df: DataFrame, order_by: list) -> DataFrame:
    """Sort, remember each row's partition and place in it, and store the result."""
    placed = df.orderBy(*order_by).withColumn(_POSITION, F.monotonically_increasing_id())
    stored = materialize(placed)
    return stored.withColumn(_PART, F.shiftright(_POSITION, _POSITION_BITS))


#: First characters of a digest by which rows are dealt: 4,096 stretches.
_STRETCH = 3


def stretch_of(digest: Column) -> Column:
    """Where a digest (hex text) lies among all, as a number; -1 for none."""
    return F.coalesce(F.conv(F.substring(digest, 1, _STRETCH), 16, 10).cast("int"), F.lit(-1))


def place_in_stretch(
    df: DataFrame, digest: Column, order_by: list, name: str, rows: int, within: list[str] | None = None
) -> DataFrame:
    """Row numbers from 1 inside each stretch of the digests (and each class ``within``),
    which is kept as ``__stretch``.

    Digests spread evenly whatever they are of, so one shuffle by stretch gives tasks
    of equal size: nothing is sampled, and no task sorts more than its stretches.
    """
    found = df.withColumn("__stretch", stretch_of(digest))
    dealt = found.repartition(task_count(df, rows), "__stretch")
    inside = W.partitionBy("__stretch", *(within or [])).orderBy(*order_by)
    return dealt.withColumn(name, F.row_number().over(inside).cast("bigint"))


def before_stretch(counts: DataFrame, name: str, within: list[str] | None = None) -> DataFrame:
    """Per stretch (and class ``within``) the rows of all stretches ahead of it, from
    their counts ``n``: a row per stretch, and a window as long as there are stretches."""
    ahead = W.partitionBy(*(within or [])).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")


def number_rows(
    df: DataFrame,
    order_by: list,
    name: str,
    start: int = 1,
    digest: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Dense row numbers of a table of any size.

    ``order_by`` must not tie, or the numbers of tied rows are arbitrary.  Where
    ``digest`` (hex text, shared by few rows) comes first in the order, rows are dealt
    by it instead of being sorted as a whole; ``rows`` is their count, if known.
    """
    if digest is not None:
        known = df.count() if rows is None else rows
        placed = place_in_stretch(df, digest, [digest, *order_by[1:]], _POSITION, known)
        path = fresh_path(df.sparkSession, "numbered")
        placed.write.parquet(path)
        stored = df.sparkSession.read.parquet(path)
        before = before_stretch(stored.groupBy("__stretch").agg(F.count("*").alias("n")), "__before_part")
        return (
            stored.join(F.broadcast(before), "__stretch")
            .withColumn(name, (F.col("__before_part") + F.col(_POSITION) + (start - 1)).cast("bigint"))
            .drop("__stretch", _POSITION, "__before_part")
        )
    parts = _sorted_parts(df, order_by)
    place = F.col(_POSITION) - F.shiftleft(F.col(_PART), _POSITION_BITS)
    return (
        parts.join(F.broadcast(_by_part(parts, F.lit(1))), _PART)
        .withColumn(name, (F.col("__before_part") + place + start).cast("bigint"))
        .drop(_PART, _POSITION, "__before_part")
    )


def running_total(df: DataFrame, order_by: list, weight: str, before: str) -> DataFrame:
    """For each row the sum of ``weight`` over all rows sorted ahead of it."""
    parts = _sorted_parts(df, order_by)
    ahead = W.partitionBy(_PART).orderBy(_POSITION).rowsBetween(W.unboundedPreceding, -1)
    return (
        parts.join(F.broadcast(_by_part(parts, F.col(weight))), _PART)
        .withColumn(
            before,
            F.col("__before_part") + F.coalesce(F.sum(weight).over(ahead), F.lit(0)),
        )
        .drop(_PART, _POSITION, "__before_part")
    )


def number_aggregate(
    df: DataFrame, order_by: list, name: str, max_rows: int | None = None
) -> DataFrame:
    """Row numbers of an aggregate: one task if it is small, else ``number_rows``."""
    stored = materialize(df)
    limit = ONE_TASK_ROWS if max_rows is None else max_rows
    if stored.count() <= limit:
        return stored.withColumn(name, F.row_number().over(W.orderBy(*order_by)).cast("bigint"))
    return number_rows(stored, order_by, name)
