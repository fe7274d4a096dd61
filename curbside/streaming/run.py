"""Starting streams: sources, triggers, checkpoint folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def read_table_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """A Parquet table as a stream of its files, with the table's own schema."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream takes a plain path for a folder; as a pattern it may be one file.
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{folder}/{{{name}}}")


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there, then stop.  Restarting goes on where it ended."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
