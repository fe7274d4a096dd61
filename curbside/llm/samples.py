"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, size: int, *keep: Column) -> DataFrame:
    """At most ``size`` rows of (doc_id, ...): those with the least hash of the
    id, so reruns agree and the choice does not depend on the labels."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *keep)
    return chosen.dropna().orderBy(F.xxhash64("doc_id"), *chosen.columns).limit(size)


def texts_of(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """The chosen rows with their whole texts.  The sample's bound holds for the
    broadcast: ids and labels only."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.join(F.broadcast(chosen), "doc_id")
