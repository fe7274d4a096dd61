"""Classification requests: cleaning, rules, models, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from curbside.functions import lookups
from curbside.functions.numeric import half_even
from curbside.operators.scale import attach, number_aggregate
from curbside.session import materialize

#: Column which counts how many equal rows one training row stands for.
WEIGHT = "n_rows"

#: Request column -> type and value when it is left out.
REQUEST_FIELDS = {
    "weight_kg": ("double", lookups.DEFAULT_WEIGHT_KG),
    "moisture_pct": ("double", lookups.DEFAULT_MOISTURE_PCT),
    "recyclable": ("int", lookups.DEFAULT_RECYCLABLE),
    "material_type": ("string", lookups.DEFAULT_MATERIAL),
}


def _whole_number(text: Column) -> Column:
    """Text to int; ``1.5`` fails rather than being cut to 1."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def clean_requests(df: DataFrame) -> DataFrame:
    """Defaults for missing fields, casts for the rest.

    ``cast_failed`` is 1 where a field was given but is not a number.  A column of
    numbers is cast as it is (1.0 is 1, and what comes after the point is cut);
    only text has to look like a number of its kind.
    """
    cleaned, failures = {}, []
    for name, (dtype, default) in REQUEST_FIELDS.items():
        given = F.col(name)
        if dtype == "string":
            cleaned[name] = F.coalesce(given.cast("string"), F.lit(default))
            continue
        text = isinstance(df.schema[name].dataType, (T.StringType, T.NullType))
        if text and dtype == "int":
            value = _whole_number(given.cast("string"))
        else:
            value = given.try_cast(dtype)
        failures.append(given.isNotNull() & value.isNull())
        cleaned[name] = F.when(given.isNull(), F.lit(default)).otherwise(value)
    failed = failures[0]
    for f in failures[1:]:
        failed = failed | f
    return df.withColumns({"cast_failed": failed.cast("int"), **cleaned})


def split_failed(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable requests, and those to set aside."""
    good = cleaned.filter("cast_failed = 0").drop("cast_failed")
    return good, cleaned.filter("cast_failed = 1").drop("cast_failed")


def encode_category(
    df: DataFrame,
    column: str,
    codes: DataFrame,
    name: str,
    default: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Look up a code; an unknown or missing value gets ``default`` (or null)."""
    coded = attach(
        df, codes.select(F.col(codes.columns[0]).alias(column), F.col("code").alias(name)),
        [column], "left", max_rows=max_rows,
    )
    return coded if default is None else coded.withColumn(name, F.coalesce(name, F.lit(default)))


def label_codes(df: DataFrame, column: str, max_rows: int | None = None) -> DataFrame:
    """Codes 0, 1, 2... of the values found, in alphabetical order.

    The values are numbered where they are, however many there are.
    """
    found = df.select(column).filter(F.col(column).isNotNull()).distinct()
    numbered = number_aggregate(found, [column], "code", max_rows)
    return numbered.select(column, (F.col("code") - 1).alias("code"))


def rule_classify(
    df: DataFrame, moisture: str = "moisture_pct", material: str = "material_type"
) -> DataFrame:
    """Label and confidence by the first rule that holds.

    An unknown material counts as a synthetic polymer.
    """
    known = F.col(material).isin(lookups.MATERIALS)
    kind = F.when(known, F.col(material)).otherwise(F.lit(lookups.DEFAULT_MATERIAL))

    def result(rule: str) -> Column:
        label, confidence = lookups.RULE_RESULTS[rule]
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    ruled = F.when(F.col(moisture) > lookups.WET_ABOVE_PCT, result("wet"))
    for name in ("synthetic_polymer", "ferrous", "cellulose"):
        ruled = ruled.when(kind == name, result(name))
    return (
        df.withColumn("__ruled", ruled.otherwise(result("other")))
        .withColumn("predicted_type", F.col("__ruled.label"))
        .withColumn("confidence", half_even(F.col("__ruled.confidence"), 3))
        .drop("__ruled")
    )


def recommend(df: DataFrame, label: str = "predicted_type") -> DataFrame:
    """Advice for a waste type; an unknown type gets the plastic advice."""
    advice = lookups.advice(df.sparkSession).withColumnRenamed("waste_type", label)
    fallback = dict((row[0], row[1:]) for row in lookups.ADVICE)[lookups.FALLBACK_ADVICE]
    columns = {"action": "recommendation", "color": "color", "tip": "segregation_tip"}
    joined = df.join(F.broadcast(advice), label, "left")
    for (column, name), text in zip(columns.items(), fallback):
        joined = joined.withColumn(column, F.coalesce(column, F.lit(text))).withColumnRenamed(
            column, name
        )
    return joined


def with_bin(df: DataFrame, label: str = "predicted_type") -> DataFrame:
    """Bin colour of a waste type; an unknown type has none."""
    bins = lookups.bins(df.sparkSession).withColumnRenamed("waste_type", label)
    return df.join(F.broadcast(bins), label, "left")


def collapse(df: DataFrame, columns: list[str]) -> DataFrame:
    """One stored row per distinct row, with its count as training weight.

    Measurements have few digits, so at scale this is far smaller than the
    records, and a group of copies costs as much as a single row.  Impurities,
    losses and counts are those of the full table; a forest's random draws are
    not, so forests are trained on records.  Each fit reads the rows many times,
    so they are spread over all cores even where they are few.
    """
    counts = materialize(df.groupBy(*columns).agg(F.count("*").cast("double").alias(WEIGHT)))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if counts.rdd.getNumPartitions() >= cores:
        return counts
    return materialize(counts.repartition(cores, *columns))


def forest(trees: int = 100, max_depth: int = 30, max_bins: int = 32, seed: int = 42):
    """Random forest; 30 is the deepest tree Spark grows.  Rows remember their node,
    so that deep trees are not walked, nor sent to the tasks, at every level."""
    return RandomForestClassifier(
        labelCol="label_code", featuresCol="features", numTrees=trees, maxDepth=max_depth,
        maxBins=max_bins, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True,
    )


def tree(max_depth: int = 8, max_bins: int = 32, seed: int = 42):
    return DecisionTreeClassifier(
        labelCol="label_code", featuresCol="features", maxDepth=max_depth, maxBins=max_bins, seed=seed
    )


def logistic(rows: int, c: float = 1.0, max_iter: int = 500):
    """Multinomial, unscaled; the penalty is for a mean loss, hence 1 / (C n)."""
    return LogisticRegression(
        labelCol="label_code", featuresCol="features", family="multinomial",
        regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, maxIter=max_iter, standardization=False,
    )


def feature_stages(
    df: DataFrame,
    label: str = "waste_type",
    numeric: Sequence[str] = ("weight_kg", "moisture_pct", "recyclable"),
    category: str = "material_type",
) -> PipelineModel:
    """Codes of labels and materials and the assembled features, to be shared by
    several classifiers.  Rows must have a label."""
    labels = StringIndexer(
        inputCol=label, outputCol="label_code", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(df)
    material = StringIndexer(
        inputCol=category, outputCol="material_code", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(df)
    return PipelineModel(
        [labels, material, VectorAssembler(inputCols=[*numeric, "material_code"], outputCol="features")]
    )


def fit_prepared(prepared: DataFrame, stages: PipelineModel, classifier) -> PipelineModel:
    """A classifier fitted on rows that already went through ``feature_stages``; the
    whole pipeline from raw columns to a predicted label.  A column ``n_rows``, if
    there is one, weighs the rows."""
    labels, material, assemble = stages.stages
    classifier = classifier.copy()
    if WEIGHT in prepared.columns:
        classifier.setWeightCol(WEIGHT)
    if classifier.hasParam("maxBins"):
        # A tree needs a bin for each category, the one for unknown values included.
        classifier.setMaxBins(max(classifier.getMaxBins(), len(material.labels) + 1))
    name = IndexToString(inputCol="prediction", outputCol="predicted_type", labels=labels.labels)
    return PipelineModel([labels, material, assemble, classifier.fit(prepared), name])


def train_classifier(
    df: DataFrame,
    classifier,
    label: str = "waste_type",
    numeric: Sequence[str] = ("weight_kg", "moisture_pct", "recyclable"),
    category: str = "material_type",
) -> PipelineModel:
    """One pipeline from raw columns to a predicted label.

    The codes used in training are stored with it, so scoring cannot use others.
    A column ``n_rows``, if there is one, weighs the rows.  Rows without a label
    have nothing to learn from and are left out (count them with
    ``not_null_violations``).
    """
    df = df.filter(F.col(label).isNotNull())
    stages = feature_stages(df, label, numeric, category)
    return fit_prepared(stages.transform(df), stages, classifier)


#: Columns that classifiers learn from.
FEATURES = ["weight_kg", "moisture_pct", "recyclable", "material_type"]


def feature_groups(
    df: DataFrame, by: Sequence[str], weight: str | None = None, features: Sequence[str] = FEATURES
) -> DataFrame:
    """One row per distinct features, stored: ``cells`` holds the number of rows for
    each combination of the columns ``by`` (label, split, fold: few).

    A classifier says the same of equal features, so it is asked once; measures
    have few digits, and at scale rows are many times their distinct features.
    """
    rows = F.sum(weight).cast("double") if weight else F.count("*").cast("double")
    cells = df.groupBy(*features, *by).agg(rows.alias(WEIGHT))
    grouped = cells.groupBy(*features).agg(F.collect_list(F.struct(*by, WEIGHT)).alias("cells"))
    return materialize(grouped)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, a few tasks each.  A file is read by as many
    tasks as it has row groups, often one, and a model takes far longer than reading."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Predicted type and the largest class probability.

    The stage that codes the true label is left out: it would drop rows whose
    label was not seen in training.
    """
    confidence = half_even(F.array_max(vector_to_array("probability")), 3)
    return PipelineModel(model.stages[1:]).transform(df).select(*df.columns, "predicted_type", confidence.alias("confidence"))


def classify_requests(raw: DataFrame, model: PipelineModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean, classify and advise; the second frame holds requests set aside.

    Without a model the rules decide.
    """
    good, bad = split_failed(clean_requests(raw))
    labelled = rule_classify(good) if model is None else score(spread(good), model)
    return recommend(labelled), bad


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Features by importance.  The list has one entry per feature."""
    assembler, fitted = model.stages[2], model.stages[3]
    rows = [
        (name, float(weight))
        for name, weight in zip(assembler.getInputCols(), fitted.featureImportances.toArray())
    ]
    return lookups.small_table(spark, rows, ["feature", "importance"]).orderBy(
        F.desc("importance"), "feature"
    )
