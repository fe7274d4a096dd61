"""Session settings for the jobs, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

#: Folders handed out by ``fresh_path``, by application.
_HANDED_OUT: dict[str, list[str]] = defaultdict(list)


def build_session(app: str = "curbside", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    On a cluster leave ``master`` out, and size ``spark.sql.shuffle.partitions``
    to the job; adaptive execution then merges small partitions and splits
    skewed ones.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Files of a checkpoint go when no frame refers to it any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session may go without that setting: it gets a temporary
    folder.  A cluster must name one which all executors can reach.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="curbside-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder which nothing else uses, until ``clean_up``."""
    folder = f"{work_dir(spark)}/curbside-{uuid.uuid4().hex}"
    _HANDED_OUT[spark.sparkContext.applicationId].append(folder)
    return f"{folder}/{name}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A path which all queries of this application share, as for a trained model."""
    return f"{work_dir(spark)}/curbside-kept-{spark.sparkContext.applicationId}/{name}"


def clean_up(spark: SparkSession, kept: bool = False) -> int:
    """Delete what this application wrote under ``fresh_path``: scratch tables,
    stream state, stored results; and with ``kept`` what is under ``kept_path``.
    To be called when the results that were read from there are no longer needed.
    Gives the number of folders."""
    folders = _HANDED_OUT.pop(spark.sparkContext.applicationId, [])
    folders += [kept_path(spark, "")] if kept else []
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
    return len(folders)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in storage that outlives executors."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)
