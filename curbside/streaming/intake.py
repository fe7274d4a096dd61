"""Report intake and live counts.

No report is lost, whatever the order in which files arrive: nothing is thrown
away for being old.  Repeats are recognised by an index of the ids seen, a table
in buckets by their hash: each batch reads the buckets its own ids fall into, and
adds to them, so no state grows with the table.

A batch writes its own folder of rows, or of partial counts, and its own folder of
ids.  A batch that is run again after a crash reads the ids of the batches before
it and replaces its own folders, so it counts once; no table is ever replaced as a
whole.  Counts are summed when they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside.operators.quality import keep_first
from curbside.operators.reports import clean_reports
from curbside.sources.tables import read_or_none
from curbside.streaming.run import drain

#: Buckets of the index; a batch reads those its ids fall into.
BUCKETS = 64


def _bucket(keys: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def new_ids(batch: DataFrame, batch_id: int, index: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows of the batch whose key no batch before has had, each key once; a row
    without a key is no repeat of another."""
    missing = F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys))
    keyed = keep_first(batch.filter(~missing), list(keys), batch.columns)
    stored = read_or_none(batch.sparkSession, index)
    if stored is not None:
        # As many numbers as there are buckets, at most.
        touched = [r[0] for r in keyed.select(_bucket(keys)).distinct().collect()]
        seen = stored.filter(F.col("bucket").isin(touched) & (F.col("batch") < batch_id))
        keyed = keyed.join(seen.select(*keys), list(keys), "left_anti")
    return keyed.select(batch.columns).unionByName(batch.filter(missing))


def _add_ids(fresh: DataFrame, batch_id: int, index: str, keys: tuple[str, ...]) -> None:
    known = fresh.select(*keys).dropna()
    bucketed = known.withColumn("bucket", _bucket(keys)).repartition("bucket")
    bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/batch={batch_id}")


def compact_ids(spark: SparkSession, index: str, before: int, target: str) -> None:
    """A copy of the index at ``target`` with one file per bucket for all batches before
    a number, and the later batches as they are.  For a stopped stream, whose next
    start is given the copy."""
    stored = spark.read.parquet(index)
    old = stored.filter(F.col("batch") < before).withColumn("batch", F.lit(before - 1))
    kept = old.repartition("bucket").unionByName(stored.filter(F.col("batch") >= before))
    kept.write.partitionBy("batch", "bucket").parquet(target)


def store_batches(
    reports: DataFrame,
    out: str,
    checkpoint: str,
    result: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = ("id",),
    index: str | None = None,
) -> None:
    """Each report once, as ``result`` of the batch it first came in, to folders
    ``batch=N`` of ``out``."""
    index = index or f"{checkpoint.rstrip('/')}-ids"

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = new_ids(batch, batch_id, index, keys).persist()
        result(fresh).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        _add_ids(fresh, batch_id, index, keys)
        fresh.unpersist()

    drain(reports.writeStream.outputMode("append").foreachBatch(add), checkpoint)


def store_intake(
    reports: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("id",)
) -> None:
    """Cleaned reports, each once, as a Parquet table by batch."""
    store_batches(reports, out, checkpoint, clean_reports, keys)


def daily_status_counts(
    reports: DataFrame, time: str = "created_at", status: str = "status"
) -> DataFrame:
    """Reports per day and status."""
    day = F.to_date(time).alias("day")
    return reports.groupBy(day, status).agg(F.count("*").alias("n"))


def status_counts(reports: DataFrame, status: str = "status") -> DataFrame:
    return reports.groupBy(status).agg(F.count("*").alias("n"))


def store_daily_counts(reports: DataFrame, out: str, checkpoint: str) -> None:
    """Counts of every day, the newest and late additions to old ones included."""
    store_batches(reports, out, checkpoint, daily_status_counts)


def store_running_counts(reports: DataFrame, out: str, checkpoint: str) -> None:
    """Totals since the start."""
    store_batches(reports, out, checkpoint, status_counts)


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The stored counts of all batches together."""
    parts = spark.read.parquet(out)
    groups = [c for c in parts.columns if c not in ("n", "batch")]
    return parts.groupBy(*groups).agg(F.sum("n").alias("n"))
