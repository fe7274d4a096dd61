"""Train/test splits and folds which come out the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from curbside.functions.hashing import hash_bucket, seeded_digest
from curbside.operators.scale import attach, before_stretch, number_aggregate, place_in_stretch, stretch_of
from curbside.session import materialize


def hash_split(df: DataFrame, key: str, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """About ``test_pct`` percent of the rows, of each class too, without a shuffle."""
    bucket = hash_bucket(F.col(key), 100, seed)
    return df.withColumn("split", F.when(bucket < test_pct, "test").otherwise("train"))


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", hash_bucket(F.col(key), k, seed))


def _digested(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    return df.withColumns({"__digest": seeded_digest(F.col(key), seed), "__label": F.col(label)})


#: Columns that name a class; a null label is a class too.
CLASS = ["__name", "__none"]


def _by_class(df: DataFrame, label: str) -> DataFrame:
    """The columns ``CLASS`` in place of the label, for a plain join."""
    name = F.coalesce(F.col(label).cast("string"), F.lit(""))
    return df.withColumns({"__name": name, "__none": F.col(label).isNull()}).drop(label)


def test_quota(classes: DataFrame, test_pct: int = 20, max_rows: int | None = None) -> DataFrame:
    """Test rows per class, as whole numbers which add up to the overall share.

    Each class gets the whole part of its share; what is then missing goes to
    the classes with the largest remainders.  ``classes`` has one row per class.
    """
    share = F.col("size") * test_pct
    parts = classes.withColumn("whole", F.floor(share / 100)).withColumn("rest", share % 100)
    placed = number_aggregate(parts, [F.desc("rest"), "__label"], "place", max_rows)
    missing = placed.agg(F.ceil(F.sum("size") * test_pct / 100) - F.sum("whole")).scalar()
    extra = F.when(F.col("place") <= missing, 1).otherwise(0)
    return placed.select(*classes.columns, (F.col("whole") + extra).alias("quota"))


def _cuts(rows: DataFrame, counts: DataFrame, quotas: DataFrame, key: str, prefix: int) -> DataFrame:
    """Per class the (digest, key) of the last row inside its quota.

    ``counts`` by the first digits of the digest say in which stretch of the digests
    the quota ends; only the rows of that stretch are put in order.
    """
    stretch = F.substring("__digest", 1, prefix)
    upto = W.partitionBy("__label").orderBy("__stretch").rowsBetween(W.unboundedPreceding, W.currentRow)
    q = quotas.select(F.col("__label").alias("__of"), "quota")
    ends = (
        counts.withColumn("upto", F.sum("n").over(upto))
        .join(q, F.col("__label").eqNullSafe(F.col("__of")))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter("before < quota AND quota <= upto")
        .select("__of", F.col("__of").alias("__class"), "__stretch", (F.col("quota") - F.col("before")).alias("nth"))
    )
    # One stretch per class: few, so that the rows need not move to be found in them.
    own = rows.select("__label", stretch.alias("__stretch"), "__digest", F.col(key).alias("__key"))
    inside = attach(_by_class(own, "__label"), materialize(_by_class(ends, "__class")), ["__stretch", *CLASS])
    in_order = W.partitionBy("__of").orderBy("__digest", "__key")
    return (
        inside.withColumn("place", F.row_number().over(in_order))
        .filter("place = nth")
        .select("__of", F.struct("__digest", F.col("__key")).alias("__cut"))
    )


def stratified_split(
    df: DataFrame, label: str, key: str, test_pct: int = 20, seed: int = 42, prefix: int = 4
) -> DataFrame:
    """Exact split: each class gives its quota of test rows.

    Rows are told apart by where the digest of their key lies; they are counted
    and compared with the cut of their class, not sorted.  ``key`` must be unique.
    """
    rows = _digested(df, label, key, seed)
    stretch = F.substring("__digest", 1, prefix).alias("__stretch")
    counts = materialize(rows.groupBy("__label", stretch).agg(F.count("*").alias("n")))
    classes = counts.groupBy("__label").agg(F.sum("n").alias("size"))
    cuts = materialize(_cuts(rows, counts, test_quota(classes, test_pct), key, prefix))
    cuts, keyed = _by_class(cuts, "__of"), _by_class(rows, "__label")
    own = F.struct("__digest", F.col(key).alias("__key"))
    part = F.when(own <= F.col("__cut"), "test").otherwise("train")
    return attach(keyed, cuts, CLASS, "left").select(*df.columns, part.alias("split"))


def stratified_folds(
    df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Exact folds: the sizes of a class differ by at most one between folds.

    Rows are numbered in the order of their digests inside each class: counted by
    class and stretch of the digests, then dealt by stretch and put in order there,
    so a hot class spans many tasks.  ``key`` must be unique.
    """
    digest = seeded_digest(F.col(key), seed)
    rows = df.withColumn("__label", F.col(label))
    by_stretch = rows.groupBy("__label", stretch_of(digest).alias("__stretch"))
    counts = materialize(by_stretch.agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    placed = place_in_stretch(rows, digest, [digest, key], "__n", total, ["__label"])
    before = _by_class(before_stretch(counts, "__before", ["__label"]), "__label")
    numbered = attach(_by_class(placed, "__label"), before, ["__stretch", *CLASS], "left")
    fold = ((F.col("__before") + F.col("__n") - 1) % k).cast("int")
    return numbered.select(*df.columns, fold.alias("fold"))
