"""Quality of classifiers and regressors, all from distributed counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cache, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curbside.functions.numeric import half_away
from curbside.operators.classify import WEIGHT, feature_groups, score


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    right = F.avg((F.col(label) == F.col(prediction)).cast("double"))
    return df.agg(F.count("*").alias("n"), right.alias("accuracy"))


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, classes: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Count of each (label, prediction) cell, and its share of the label's rows.

    Cells of the declared classes are there even when empty; rows with other
    labels are counted too.  ``weight`` names a column of row counts.
    """
    rows_in_cell = F.sum(weight).cast("bigint") if weight else F.count("*")
    names = F.array(*[F.lit(c) for c in classes])
    spark = df.sparkSession
    empty = (
        spark.range(1)
        .select(F.explode(names).alias("label"))
        .select("label", F.explode(names).alias("prediction"), F.lit(0).cast("bigint").alias("n"))
    )
    found = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        rows_in_cell.alias("n")
    )
    cells = found.unionByName(empty).groupBy("label", "prediction").agg(F.sum("n").alias("n"))
    rows = cells.groupBy(F.col("label").alias("__label")).agg(F.sum("n").alias("__rows"))
    share = F.when(F.col("__rows") > 0, F.col("n") / F.col("__rows")).otherwise(F.lit(0.0))
    return cells.join(rows, F.col("label").eqNullSafe(F.col("__label")), "left").select(
        "label", "prediction", "n", share.alias("row_share")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_report(confusion: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and averages.

    A measure without any rows to go by is 0.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("name"), F.col("n").alias("support"),
                         F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
                F.struct(F.col("prediction").alias("name"), F.lit(0).cast("bigint").alias("support"),
                         F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
            )
        )
    )
    per_class = (
        sides.groupBy("name")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
        .withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
    )
    measures = ["precision", "recall", "f1"]
    weighted = [_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")) for m in measures]
    right = _ratio(F.sum("hits"), F.sum("support"))
    overall = per_class.agg(
        F.sum("support").alias("support"),
        right.alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[w.alias(f"weighted_{m}") for w, m in zip(weighted, measures)],
    )

    def line(name: str, columns: list[str]) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            *[F.col(c).alias(m) for c, m in zip(columns, measures)],
            F.col("support"),
        )

    summary = overall.select(
        F.inline(
            F.array(
                line("accuracy", ["accuracy"] * 3),
                line("macro avg", [f"macro_{m}" for m in measures]),
                line("weighted avg", [f"weighted_{m}" for m in measures]),
            )
        )
    )
    report = per_class.select("name", *measures, "support").unionByName(summary)
    return report.select("name", *[half_away(F.col(m), digits).alias(m) for m in measures], "support")


def regression_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    """RMSE and R squared; R squared is null when the actual values are all equal."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    both = df.filter(y.isNotNull() & F.col(predicted).isNotNull())
    stats = both.agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("variance")
    )
    r2 = F.when(F.col("variance") > 0, 1 - F.col("mse") / F.col("variance"))
    return stats.select(
        "n", half_away(F.sqrt("mse"), digits).alias("rmse"), half_away(r2, digits).alias("r2")
    )


def prediction_errors(
    df: DataFrame, key: str, actual: str, predicted: str, k: int = 10, ties: list[str] | None = None
) -> DataFrame:
    """The first k rows with actual, predicted and absolute error; ``ties`` orders
    rows with one key."""
    error = F.abs(F.col(actual) - F.col(predicted))
    return (
        df.orderBy(key, *(ties or []))
        .limit(k)
        .select(key, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), error.alias("abs_error"))
    )


def score_groups(groups: DataFrame, model: PipelineModel) -> DataFrame:
    """The cells of ``feature_groups`` with the prediction for their features: a row
    per distinct features, columns ``by``, and ``n_rows``."""
    scored = score(groups, model)
    return scored.select("predicted_type", F.inline("cells"))


def compare_models(
    df: DataFrame,
    train: dict[str, Callable[[DataFrame], PipelineModel]],
    label: str = "waste_type",
    k: int = 5,
    weight: str | None = None,
    parallelism: int = 8,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    keep: Callable[[str, str, Callable[[], PipelineModel]], PipelineModel] | None = None,
) -> DataFrame:
    """Test accuracy, and mean and population std over the folds, per model.

    ``df`` has columns ``split`` and ``fold`` and should be stored already: each
    model is fitted k + 1 times, ``parallelism`` parts at once, on parts that
    ``prepare`` (shared features, say) readies once for all models.  ``keep`` gets a
    model's name, what its part leaves out ("test", "fold0"...) and how to fit it, and
    gives the model, from a store if it has it; a part is readied when a fit needs it.
    Distinct features are scored once per fit; all metrics come from one
    aggregation over these predictions.  ``place`` numbers the models from the best
    on; ties keep the given order.
    """
    ready = prepare or (lambda part: part)
    parts = {"test": df.filter("split = 'train'")}
    for i in range(k):
        parts[f"fold{i}"] = df.filter(F.col("fold") != i)
    groups = feature_groups(df, [label, "split", "fold"], weight)

    def fit_and_score(run: str) -> DataFrame:
        prepared = cache(lambda: ready(parts[run]))
        asked = F.col("split") == "test" if run == "test" else F.col("fold") == int(run[4:])
        right = (F.col(label) == F.col("predicted_type")).cast("double")
        scored = []
        for order, name in enumerate(train):
            fit = lambda name=name: train[name](prepared())
            model = keep(name, run, fit) if keep else fit()
            scored.append(score_groups(groups, model).filter(asked).select(
                F.lit(order).alias("__order"), F.lit(name).alias("model"), F.lit(run).alias("run"),
                (right * F.col(WEIGHT)).alias("right"), F.col(WEIGHT).alias("rows"),
            ))
        return reduce(DataFrame.unionByName, scored)

    with ThreadPoolExecutor(parallelism) as pool:
        scored = reduce(DataFrame.unionByName, pool.map(fit_and_score, parts))
    runs = scored.groupBy("__order", "model", "run").agg(
        (F.sum("right") / F.sum("rows")).alias("accuracy")
    )
    test = F.max(F.when(F.col("run") == "test", F.col("accuracy")))
    fold = F.when(F.col("run") != "test", F.col("accuracy"))
    by_model = runs.groupBy("__order", "model").agg(
        test.alias("test_accuracy"), F.avg(fold).alias("cv_mean"), F.stddev_pop(fold).alias("cv_std")
    )
    # One row per model.
    best_first = W.orderBy(F.desc("cv_mean"), "__order")
    return by_model.select(
        "model", "test_accuracy", "cv_mean", "cv_std", F.row_number().over(best_first).alias("place")
    ).orderBy("place")


def best_model(comparison: DataFrame) -> DataFrame:
    """The model in the first place."""
    return comparison.filter("place = 1")
