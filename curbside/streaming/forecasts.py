"""Forecasts stored from a stream, each (area, day) once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from curbside.sources.tables import insert_if_absent
from curbside.streaming.run import drain

KEYS = ["area", "prediction_date"]


def store_forecasts(predictions: DataFrame, path: str, checkpoint: str) -> None:
    """Insert what is not there yet.  A replayed batch finds its rows and adds none."""

    def insert(batch: DataFrame, batch_id: int) -> None:
        insert_if_absent(batch, path, KEYS, partition_by="prediction_date")

    drain(predictions.writeStream.foreachBatch(insert), checkpoint)
