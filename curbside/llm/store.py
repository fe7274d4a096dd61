"""Intermediate tables in the shared folder, and columns every operator reads."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.session import fresh_path, work_dir


#: Spark's setting by which the shuffle files of an execution go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions begun inside leave no shuffle files.  Otherwise they lie on the
    executors' disks until the driver collects its garbage."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once: written as Parquet to the folder that all
    executors share, and read from there.  A lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with own_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``stored`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        ours = f"{work_dir(spark)}/curbside-".split(":", 1)[-1].lstrip("/")
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if ours in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(hadoop).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the key as text."""
    return F.crc32(key.cast("string").cast("binary")) % folds
