"""Classification of requests as they arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from curbside.operators.classify import REQUEST_FIELDS, clean_requests, recommend, rule_classify, score, spread
from curbside.streaming.run import drain

RESULT = ["predicted_type", "confidence", "recommendation", "color", "segregation_tip"]


def score_stream(requests: DataFrame, out: str, checkpoint: str, model: PipelineModel | None = None) -> None:
    """One table, partitioned by outcome: scored requests and those set aside.

    Both outcomes come from a single pass, and the file sink commits them
    together.  The request text is kept for the rows set aside.
    """
    raw = F.to_json(F.struct(*[c for c in requests.columns if c != "id"]))
    cleaned = clean_requests(requests.withColumn("request", raw))
    # A model takes no nulls.  What it says about rows set aside is not kept.
    complete = cleaned.na.fill({name: default for name, (_, default) in REQUEST_FIELDS.items()})
    labelled = rule_classify(complete) if model is None else score(spread(complete), model)
    failed = F.col("cast_failed") == 1
    advised = recommend(labelled)
    rows = advised.select(
        "id",
        F.when(failed, F.lit("quarantined")).otherwise(F.lit("scored")).alias("outcome"),
        F.when(failed, F.col("request")).alias("request"),
        *[F.when(~failed, F.col(c)).alias(c) for c in RESULT],
    )
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("outcome")
    drain(writer.option("path", out), checkpoint)
