"""Each operator as a query over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside import schemas
from curbside.functions import calendar, lookups
from curbside.functions.hashing import seeded_digest
from curbside.operators import (
    aggregates as agg,
    classify,
    eda,
    evaluate,
    forecast as fc,
    quality,
    reports as rep,
    schedule as sched,
    split,
)
from curbside.operators.scale import hot_keys, number_rows
from curbside.plans import bindings as b
from curbside.plans import dashboard
from curbside.session import fresh_path, kept_path, materialize
from curbside.sources import csv as csv_source, models, tables
from curbside.streaming import forecasts, intake, run, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Size of the forests; 30 is the deepest tree Spark grows.
TREES, DEPTH, VOLUME_DEPTH, BINS = 100, 30, 10, 32
#: Rows of one task of a classifier's fit; a forest keeps some 800 bytes of each.
TASK_ROWS = 100_000
FEATURES = ["weight_kg", "moisture_pct", "recyclable", "material_type"]


def query(f: Query) -> Query:
    """Register a query.  All stored times are UTC, so it runs in that zone."""

    @wraps(f)
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, sf_dir)

    QUERIES[f.__name__] = in_utc
    return in_utc


def iso(column: str) -> Column:
    return calendar.iso_date(F.col(column)).alias(column)


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return b.collection_facts(spark, sf_dir).select(*columns)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events")


def _area_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir, "l_orderkey", "weight_kg", "volume_liters")
    return agg.totals_through(
        facts, b.area_dim(spark, sf_dir), "l_orderkey", ["area"], count_as="collections"
    )


def _type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir, "l_partkey", "weight_kg", "volume_liters")
    return agg.totals_through(
        facts, b.part_dim(spark, sf_dir).select("l_partkey", "waste_type"), "l_partkey", ["waste_type"]
    )


def _area_type_cells(spark: SparkSession, sf_dir: str, declared: list[str] | None = None) -> DataFrame:
    """Kilograms by area and type; with ``declared`` the other types are one."""
    types = b.part_dim(spark, sf_dir).select("l_partkey", "waste_type")
    if declared is not None:
        types = types.withColumn("waste_type", agg.declared_or_other("waste_type", declared))
    return agg.totals_through(
        b.collections(spark, sf_dir, ["area", "l_partkey", "weight_kg"]),
        types,
        "l_partkey",
        ["area", "waste_type"],
        {"total_kg": "weight_kg"},
    )


def _daily_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and records per area and day: the input of every forecast, stored once."""
    facts = _facts(spark, sf_dir, "l_orderkey", "collection_date", "volume_liters")
    return materialize(
        agg.totals_through(
            facts.filter("volume_liters IS NOT NULL"), b.area_dim(spark, sf_dir), "l_orderkey",
            ["area", "collection_date"], {"total_volume": "volume_liters"},
            count_as="collections", digits=6,
        )
    )


# -- totals and key figures ---------------------------------------------------


@query
def waste_by_area(spark, sf_dir):
    totals = agg.with_scaled_count(_area_totals(spark, sf_dir))
    return agg.largest_first(totals, "total_kg", "area")


@query
def waste_by_type(spark, sf_dir):
    return agg.largest_first(_type_totals(spark, sf_dir), "total_kg", "waste_type")


@query
def reports_by_status(spark, sf_dir):
    return agg.counts_by(b.reports(_events(spark, sf_dir)), "status").orderBy("status")


@query
def kpi_stats(spark, sf_dir):
    return agg.kpi_stats(_facts(spark, sf_dir, *b.MEASURES))


@query
def kpi_cards(spark, sf_dir):
    return agg.kpi_cards(kpi_stats(spark, sf_dir), _events(spark, sf_dir))


@query
def recyclable_split(spark, sf_dir):
    return agg.recyclable_split(kpi_stats(spark, sf_dir))


@query
def value_counts(spark, sf_dir):
    return agg.value_counts(b.reports(_events(spark, sf_dir)), "waste_type")


@query
def area_type_pivot(spark, sf_dir):
    """A column for each declared type; ``Mixed`` is none of them and goes to ``other``."""
    declared = sorted(lookups.WASTE_TYPES)
    cells = _area_type_cells(spark, sf_dir, declared)
    return agg.pivot_totals(cells, "area", "waste_type", "total_kg", declared).orderBy("area")


@query
def area_type_matrix(spark, sf_dir):
    """The same in long form, with the types found in the data."""
    return _area_type_cells(spark, sf_dir)


@query
def heatmap_estimate(spark, sf_dir):
    return agg.matrix_estimate(
        materialize(_area_totals(spark, sf_dir)), materialize(_type_totals(spark, sf_dir))
    )


@query
def group_total(spark, sf_dir):
    rows = b.collections(
        spark, sf_dir, ["l_orderkey", "l_partkey", "area", "day_of_week", "volume_liters"]
    )
    keys = ["area", "day_of_week"]
    facts = _facts(spark, sf_dir, "l_orderkey", "day_of_week", "volume_liters")
    totals = agg.totals_through(
        facts, b.area_dim(spark, sf_dir), "l_orderkey", keys, {"group_total": "volume_liters"}
    )
    return agg.group_total(rows, keys, "volume_liters", totals=totals)


def _area_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area totals that carry what the key figures need."""
    facts = _facts(spark, sf_dir, "l_orderkey", *b.MEASURES).withColumns(
        {
            "has_moisture": F.when(F.col("moisture_pct").isNotNull(), 1.0).otherwise(0.0),
            "recyclable": F.when(F.col("recyclable") == 1, 1.0).otherwise(0.0),
        }
    )
    measures = {**agg.KPI_MEASURES, "moisture_count": "has_moisture"}
    return agg.totals_through(
        facts, b.area_dim(spark, sf_dir), "l_orderkey", ["area"], measures, count_as="collections", digits=6
    )


@query
def dashboard_snapshot(spark, sf_dir):
    return dashboard.dashboard_snapshot(
        _type_totals(spark, sf_dir),
        _area_key_figures(spark, sf_dir),
        b.reports(_events(spark, sf_dir)),
    )


@query
def dashboard_lines(spark, sf_dir):
    return dashboard.dashboard_lines(
        _type_totals(spark, sf_dir),
        _area_totals(spark, sf_dir),
        b.reports(_events(spark, sf_dir)),
    )


# -- schedule and map ---------------------------------------------------------


def _mean_total(totals: DataFrame, column: str = "total_volume") -> Column:
    return totals.agg(agg.exact_mean(column)).scalar()


@query
def collection_schedule(spark, sf_dir):
    totals = materialize(_area_totals(spark, sf_dir))
    mean = _mean_total(totals)
    return sched.collection_schedule(totals, high=mean, medium=mean * 0.99)


@query
def quick_schedule(spark, sf_dir):
    return sched.first_runs(collection_schedule(spark, sf_dir), 3)


@query
def zone_layer(spark, sf_dir):
    base = fc.base_volumes(_daily_volumes(spark, sf_dir))
    mean = base.agg(F.max("base_volume")).scalar()
    return sched.zone_layer(base, lookups.zones(spark), "base_volume", mean * 0.999, mean * 0.99)


# -- reports ------------------------------------------------------------------


@query
def clean_reports(spark, sf_dir):
    cleaned = rep.clean_reports(b.reports(_events(spark, sf_dir)))
    return cleaned.withColumn("created_at", stamp("created_at"))


@query
def latest_reports(spark, sf_dir):
    latest = rep.latest_reports(b.reports(_events(spark, sf_dir)))
    return latest.withColumn("created_at", stamp("created_at"))


@query
def reports_snapshot(spark, sf_dir):
    return dashboard.reports_snapshot(rep.latest_reports(b.reports(_events(spark, sf_dir))))


@query
def report_display(spark, sf_dir):
    stored = rep.clean_reports(b.reports(_events(spark, sf_dir)), keep_status=True)
    return rep.report_display(stored)


# -- checks, sources and sinks ------------------------------------------------


@query
def not_null_violations(spark, sf_dir):
    raw = b.reports(_events(spark, sf_dir))
    return quality.not_null_violations(raw, schemas.REQUIRED["reports"])


@query
def quarantined_reports(spark, sf_dir):
    raw = b.reports(_events(spark, sf_dir))
    bad = quality.split_not_null(raw, schemas.REQUIRED["reports"])[1]
    return bad.select("id", "reporter_name", "location", "waste_type")


@query
def unique_violations(spark, sf_dir):
    return quality.repeated_texts(b.table(spark, sf_dir, "documents"), "text")


@query
def keep_first(spark, sf_dir):
    names = b.table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand")
    return quality.keep_first(names, ["p_name"], ["p_partkey"])


@query
def column_defaults(spark, sf_dir):
    raw = b.reports(_events(spark, sf_dir)).select("id", "reporter_name", "location")
    return quality.apply_defaults(raw, {"reporter_name": "Anonymous", "location": ""})


@query
def surrogate_ids(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return quality.assign_ids(rows, ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")


@query
def assign_dates(spark, sf_dir):
    rows = b.event_records(_events(spark, sf_dir)).select("id", "area")
    return csv_source.assign_dates(rows, "2024-01-31").select(
        "id", "area", iso("collection_date")
    )


@query
def csv_scan(spark, sf_dir):
    path = fresh_path(spark, "collections.csv")
    rows = b.event_records(_events(spark, sf_dir)).select(*schemas.COLLECTIONS_CSV.names)
    rows.write.csv(path, header=True)
    return csv_source.read_collections(spark, path)


@query
def head_rows(spark, sf_dir):
    return b.event_records(_events(spark, sf_dir)).orderBy("id").limit(10)


@query
def load_if_empty(spark, sf_dir):
    path = fresh_path(spark, "records")
    rows = b.event_records(_events(spark, sf_dir)).select("id", "area", "weight_kg")
    for _ in range(2):
        tables.load_if_empty(rows, path)
    return tables.read_or_none(spark, path)


@query
def append_reports(spark, sf_dir):
    path = fresh_path(spark, "reports")
    cleaned = rep.clean_reports(b.reports(_events(spark, sf_dir)))
    tables.append(cleaned, path)
    stored = spark.read.parquet(path)
    return stored.select("id", "reporter_name", "location", "waste_type", "status")


# -- statistics ---------------------------------------------------------------


@query
def column_profile(spark, sf_dir):
    return eda.column_profile(b.reports(_events(spark, sf_dir)))


@query
def describe(spark, sf_dir):
    columns = ["weight_kg", "moisture_pct", "volume_liters"]
    return eda.describe(_facts(spark, sf_dir, *columns), columns)


@query
def histogram(spark, sf_dir):
    return eda.histogram(_facts(spark, sf_dir, "volume_liters"), "volume_liters")


@query
def histogram_weight(spark, sf_dir):
    """Weights as shown in the notebook: the bins, and the mean beside each."""
    return _histogram_with_mean(spark, sf_dir, "weight_kg")


@query
def histogram_moisture(spark, sf_dir):
    return _histogram_with_mean(spark, sf_dir, "moisture_pct")


def _histogram_with_mean(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    facts = _facts(spark, sf_dir, column)
    mean = facts.agg(fc.half_even(agg.exact_mean(column), 2)).scalar()
    return eda.histogram(facts, column).withColumn("mean", mean)


@query
def correlation_pairs(spark, sf_dir):
    columns = [*b.MEASURES, "month"]
    return eda.correlation_pairs(_facts(spark, sf_dir, *columns), columns)


# -- rules, codes and advice --------------------------------------------------


@query
def clean_requests(spark, sf_dir):
    return classify.clean_requests(b.requests(_events(spark, sf_dir)))


@query
def rule_classify(spark, sf_dir):
    rows = b.collections(
        spark, sf_dir, ["l_orderkey", "l_partkey", "moisture_pct", "material_type"]
    )
    return classify.rule_classify(rows)


@query
def recommend(spark, sf_dir):
    rows = b.event_records(_events(spark, sf_dir)).select("id", "waste_type")
    return classify.with_bin(classify.recommend(rows, "waste_type"), "waste_type")


@query
def classify_requests(spark, sf_dir):
    good, _ = classify.classify_requests(b.requests(_events(spark, sf_dir)))
    return good.select("id", *scoring.RESULT)


@query
def quarantined_requests(spark, sf_dir):
    bad = classify.split_failed(classify.clean_requests(b.requests(_events(spark, sf_dir))))[1]
    return bad.select("id", "material_type")


@query
def encode_category(spark, sf_dir):
    rows = b.event_records(_events(spark, sf_dir)).select("id", "material_type")
    codes = lookups.codes(spark, lookups.MATERIALS, "material_type")
    default = lookups.MATERIALS.index(lookups.DEFAULT_MATERIAL)
    return classify.encode_category(rows, "material_type", codes, "material_code", default)


@query
def label_encode(spark, sf_dir):
    brands = b.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    codes = classify.label_codes(brands, "p_brand")
    return classify.encode_category(brands, "p_brand", codes, "brand_code")


# -- splits and metrics -------------------------------------------------------


@query
def hash_split(spark, sf_dir):
    rows = b.event_records(_events(spark, sf_dir)).select("id", "waste_type")
    return split.hash_split(rows, "id")


@query
def assign_folds(spark, sf_dir):
    rows = b.event_records(_events(spark, sf_dir)).select("id", "waste_type")
    return split.assign_folds(rows, "id")


@query
def stratified_split(spark, sf_dir):
    rows = b.event_records(_events(spark, sf_dir)).select("id", "waste_type")
    return split.stratified_split(rows, "waste_type", "id")


@query
def stratified_folds(spark, sf_dir):
    rows = b.event_records(_events(spark, sf_dir)).select("id", "waste_type")
    return split.stratified_folds(rows, "waste_type", "id")


def _rule_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.collections(spark, sf_dir, ["waste_type", "moisture_pct", "material_type"])
    return evaluate.confusion_matrix(
        classify.rule_classify(rows), "waste_type", "predicted_type", b.ALL_TYPES
    )


@query
def rule_accuracy(spark, sf_dir):
    rows = b.collections(spark, sf_dir, ["waste_type", "moisture_pct", "material_type"])
    return evaluate.accuracy(classify.rule_classify(rows), "waste_type", "predicted_type")


@query
def confusion_matrix(spark, sf_dir):
    return _rule_confusion(spark, sf_dir)


@query
def classification_report(spark, sf_dir):
    return evaluate.classification_report(_rule_confusion(spark, sf_dir))


@query
def label_confusion(spark, sf_dir):
    labels = b.table(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")
    )
    return evaluate.confusion_matrix(labels, "quality", "toxic", ["0", "1"])


def _mean_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume predicted by the mean of the weekday, for metrics without a model."""
    facts = _facts(spark, sf_dir, "day_of_week", "volume_liters")
    means = facts.groupBy("day_of_week").agg(
        fc.half_even(agg.exact_mean("volume_liters"), 2).alias("predicted")
    )
    # One row per weekday.
    return facts.join(F.broadcast(means), "day_of_week")


@query
def regression_metrics(spark, sf_dir):
    return evaluate.regression_metrics(_mean_predictions(spark, sf_dir), "volume_liters", "predicted")


@query
def residual_stats(spark, sf_dir):
    return eda.residual_stats(_mean_predictions(spark, sf_dir), "volume_liters", "predicted")


@query
def prediction_errors(spark, sf_dir):
    rows = b.event_records(_events(spark, sf_dir)).select("id", "weight_kg", "volume_liters")
    return evaluate.prediction_errors(
        rows.withColumn("guess", F.col("weight_kg") * 3), "id", "volume_liters", "guess"
    )


# -- forecasts ----------------------------------------------------------------


def _as_of(daily: DataFrame) -> Column:
    return daily.agg(F.date_add(F.max("collection_date"), 1)).scalar()


def _grid(daily: DataFrame) -> DataFrame:
    return fc.forecast_grid(daily.select("area").distinct(), _as_of(daily))


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily_volumes(spark, sf_dir)
    return fc.fallback_forecast(_grid(daily), fc.base_volumes(daily), fc.day_multipliers(daily))


@query
def forecast_grid(spark, sf_dir):
    grid = _grid(_daily_volumes(spark, sf_dir))
    return grid.withColumn("prediction_date", iso("prediction_date"))


@query
def forecast_fallback(spark, sf_dir):
    return _fallback(spark, sf_dir).select(
        "area", iso("prediction_date"), "day_of_week", "predicted_volume"
    )


@query
def forecast_kpis(spark, sf_dir):
    return fc.forecast_kpis(_fallback(spark, sf_dir))


@query
def forecast_capacity(spark, sf_dir):
    forecast = _fallback(spark, sf_dir)
    capacity = forecast.agg(F.max("predicted_volume")).scalar() * 1.4
    return fc.capacity_use(forecast, capacity).select(
        "area", iso("prediction_date"), "capacity_pct", "band"
    )


def _stored_and_new(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: the first three days, without weekday factors.  New: all seven days."""
    grid, base = _grid(daily), fc.base_volumes(daily)
    factors = fc.day_multipliers(daily)
    flat = factors.withColumn("multiplier", F.lit(1.0))
    stored = fc.fallback_forecast(grid.filter("day_no < 3"), base, flat)
    new = fc.fallback_forecast(grid, base, factors)
    made = "2024-01-01 00:00:00"
    return fc.to_predictions(stored, made), fc.to_predictions(new, made)


def _stored_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(
        "area", iso("prediction_date"), "predicted_volume", "confidence"
    )


@query
def insert_if_absent(spark, sf_dir):
    stored, new = _stored_and_new(_daily_volumes(spark, sf_dir))
    path = fresh_path(spark, "predictions")
    for rows in (stored, new, new):
        tables.insert_if_absent(rows, path, forecasts.KEYS, partition_by="prediction_date")
    return _stored_predictions(spark, path)


# -- models ---------------------------------------------------------------------


#: Tables behind the collections.
INPUTS = ("lineitem", "orders", "part")


def _store(spark: SparkSession) -> models.ModelStore:
    """Where this application keeps models, and tables made for them, so that several
    queries share them."""
    return models.ModelStore(spark, kept_path(spark, "models"))


def _made_from(spark: SparkSession, sf_dir: str, **parameters) -> str:
    return models.fingerprint([b.table(spark, sf_dir, name) for name in INPUTS], **parameters)


def _labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled collections, with id in the order of their digests, exact split
    and exact folds."""

    def make() -> DataFrame:
        columns = ["waste_type", *FEATURES]
        keys = ["l_orderkey", "l_partkey"]
        facts = b.collection_facts(spark, sf_dir)
        labelled = b.collections(spark, sf_dir, [*keys, *columns]).filter("waste_type IS NOT NULL")
        digest = seeded_digest(F.concat_ws("-", *keys), 42)
        order = [digest, *FEATURES, "waste_type"]
        # Rows of a crowded pair of keys share a digest; those have to be sorted.
        dealt = {} if hot_keys(facts, keys) else {"digest": digest, "rows": facts.count()}
        numbered = number_rows(labelled, order, "id", **dealt).select("id", *columns)
        parted = split.stratified_split(numbered, "waste_type", "id")
        return split.stratified_folds(parted, "waste_type", "id", seed=7)

    write = lambda df, path: df.write.parquet(path)
    made_from = _made_from(spark, sf_dir)
    return _store(spark).get("labelled_rows", made_from, make, write, spark.read.parquet, reread=True)


def _prepared(part: DataFrame, stages: PipelineModel) -> DataFrame:
    """All rows a classifier may learn from, with its features, spread over the cores
    in tasks that hold a row's draws for all trees in memory."""
    tasks = max(part.sparkSession.sparkContext.defaultParallelism, part.count() // TASK_ROWS)
    return materialize(stages.transform(part).repartition(tasks, "id"))


def _kinds(stages: PipelineModel) -> dict[str, Callable[[DataFrame], PipelineModel]]:
    """The classifiers compared, each fitted on ``_prepared`` rows.  Equal rows are counted
    for the tree and the logistic regression, which learn the same from counts; a
    forest draws from the rows themselves."""
    columns = ["waste_type", *FEATURES]

    def forest(rows: DataFrame) -> PipelineModel:
        return classify.fit_prepared(rows, stages, classify.forest(TREES, DEPTH, BINS))

    def counted(make) -> Callable[[DataFrame], PipelineModel]:
        def fit(rows: DataFrame) -> PipelineModel:
            cells = stages.transform(classify.collapse(rows.select(*columns), columns))
            return classify.fit_prepared(cells, stages, make(rows))

        return fit

    return {
        "Random Forest": forest,
        "Decision Tree": counted(lambda _: classify.tree(8, BINS)),
        "Logistic Regression": counted(lambda rows: classify.logistic(rows.count())),
    }


def _stages(rows: DataFrame) -> PipelineModel:
    """Codes and features of all labelled collections; labels and materials are few."""
    return classify.feature_stages(materialize(rows.select("waste_type", "material_type").distinct()))


def _fitted(
    spark: SparkSession, sf_dir: str, kind: str, left_out: str, fit: Callable[[], PipelineModel]
) -> PipelineModel:
    """A classifier fitted on all labelled rows but ``left_out`` ("test", "fold0"...), by
    the first query that asks, then loaded while the tables stay the same."""
    parameters = {"kind": kind, "left_out": left_out, "trees": TREES, "depth": DEPTH, "bins": BINS}
    name = f"{kind.replace(' ', '_')}_{left_out}"
    return _store(spark).get(name, _made_from(spark, sf_dir, **parameters), fit)


def _classifier(spark: SparkSession, sf_dir: str, kind: str = "Random Forest") -> PipelineModel:
    """Trained on the training rows."""

    def train() -> PipelineModel:
        rows = _labelled_rows(spark, sf_dir)
        stages = _stages(rows)
        return _kinds(stages)[kind](_prepared(rows.filter("split = 'train'"), stages))

    return _fitted(spark, sf_dir, kind, "test", train)


def _test_confusion(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Predictions of a classifier for the test rows, against their labels; distinct
    features are scored once."""
    tested = _labelled_rows(spark, sf_dir).filter("split = 'test'")
    groups = classify.feature_groups(tested, ["waste_type"])
    scored = evaluate.score_groups(groups, _classifier(spark, sf_dir, kind))
    return evaluate.confusion_matrix(scored, "waste_type", "predicted_type", b.ALL_TYPES, classify.WEIGHT)


@query
def rf_classify(spark, sf_dir):
    return _test_confusion(spark, sf_dir, "Random Forest")


@query
def rf_classify_support(spark, sf_dir):
    """What SQL can know of ``rf_classify``: the test rows of each class."""
    cells = rf_classify(spark, sf_dir)
    return cells.groupBy("label").agg(F.sum("n").cast("bigint").alias("support"))


@query
def score_batch(spark, sf_dir):
    good, _ = classify.classify_requests(b.requests(_events(spark, sf_dir)), _classifier(spark, sf_dir))
    return good.select("id", *scoring.RESULT)


@query
def score_batch_ids(spark, sf_dir):
    """What SQL can know of ``score_batch``: who is scored, with a known type, a
    probability, and the advice of that type."""
    known = F.col("predicted_type").isin(b.ALL_TYPES) & F.col("confidence").between(0, 1)
    return score_batch(spark, sf_dir).select("id", (known & F.col("recommendation").isNotNull()).alias("valid"))


@query
def feature_importance(spark, sf_dir):
    return classify.feature_importance(spark, _classifier(spark, sf_dir))


@query
def feature_importance_sum(spark, sf_dir):
    shares = feature_importance(spark, sf_dir)
    return shares.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"))


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_rows(spark, sf_dir)
    stages = _stages(rows)
    # A fit on all rows fills the cores, and a forest the memory: two parts at once.
    return evaluate.compare_models(
        rows, _kinds(stages), parallelism=2, prepare=lambda part: _prepared(part, stages),
        keep=partial(_fitted, spark, sf_dir),
    )


@query
def model_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir)


@query
def model_comparison_rows(spark, sf_dir):
    """What SQL can know of ``model_comparison``: the models, with shares as scores."""
    shares = F.col("test_accuracy").between(0, 1) & F.col("cv_mean").between(0, 1) & (F.col("cv_std") >= 0)
    return model_comparison(spark, sf_dir).select("model", shares.alias("valid"))


def _best_kind(spark: SparkSession, sf_dir: str) -> str:
    return evaluate.best_model(_comparison(spark, sf_dir)).first()["model"]


@query
def best_model_confusion(spark, sf_dir):
    """The matrix of the best model's own predictions for the test rows."""
    return _test_confusion(spark, sf_dir, _best_kind(spark, sf_dir))


@query
def best_model_report(spark, sf_dir):
    return evaluate.classification_report(best_model_confusion(spark, sf_dir))


@query
def best_model_support(spark, sf_dir):
    """What SQL can know of ``best_model_report``: support of each line."""
    return best_model_report(spark, sf_dir).select("name", "support")


def _volume_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records with their key and an 80/20 split that SQL can repeat."""
    columns = ["l_orderkey", "l_partkey", *fc.FEATURES, "volume_liters"]
    rows = b.collections(spark, sf_dir, columns).filter("volume_liters IS NOT NULL")
    keyed = rows.withColumn("key", F.concat_ws("-", "l_orderkey", "l_partkey"))
    return split.hash_split(keyed, "key").drop("l_orderkey", "l_partkey")


def _volume_model(spark: SparkSession, sf_dir: str) -> fc.VolumeModel:
    def train() -> fc.VolumeModel:
        rows = _volume_records(spark, sf_dir).filter("split = 'train'")
        return fc.train_volume(rows.drop("key"), TREES, VOLUME_DEPTH, BINS)

    made_from = _made_from(spark, sf_dir, trees=TREES, depth=VOLUME_DEPTH, bins=BINS)
    load = lambda path: fc.VolumeModel.load(spark, path)
    return _store(spark).get("volume", made_from, train, fc.VolumeModel.save, load)


def _volume_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = _volume_records(spark, sf_dir).filter("split = 'test'")
    return fc.predict_volume(tested, _volume_model(spark, sf_dir))


@query
def volume_model_metrics(spark, sf_dir):
    return evaluate.regression_metrics(_volume_tested(spark, sf_dir), "volume_liters", "predicted")


@query
def volume_model_support(spark, sf_dir):
    """What SQL can know of the evaluation: test rows, all of them predicted."""
    return volume_model_metrics(spark, sf_dir).select("n")


@query
def volume_model_errors(spark, sf_dir):
    tested = _volume_tested(spark, sf_dir)
    return evaluate.prediction_errors(tested, "key", "volume_liters", "predicted", ties=["volume_liters"])


@query
def volume_model_samples(spark, sf_dir):
    """What SQL can know of ``volume_model_errors``: which rows are shown."""
    return volume_model_errors(spark, sf_dir).select("key", "actual")


def _volume_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("volume_liters") - F.col("predicted")
    return materialize(_volume_tested(spark, sf_dir).select(error.alias("error"), F.lit(0.0).alias("none")))


@query
def volume_residuals(spark, sf_dir):
    """The histogram of the model's residuals, their mean and spread beside it."""
    errors = _volume_errors(spark, sf_dir)
    stats = eda.residual_stats(errors, "error", "none").select(F.col("mean"), F.col("std"))
    return eda.histogram(errors, "error", 20).join(F.broadcast(stats))


@query
def volume_residual_rows(spark, sf_dir):
    """What SQL can know of the histogram: 20 bins that hold all test rows."""
    bins = eda.histogram(_volume_errors(spark, sf_dir), "error", 20)
    return bins.agg(F.count("*").alias("bins"), F.sum("n").cast("bigint").alias("n"))


def _forecast(spark: SparkSession, sf_dir: str, model: fc.VolumeModel | None) -> DataFrame:
    """Seven days for each area; an area without a name has no features, so the
    model has no value for it."""
    daily = _daily_volumes(spark, sf_dir)
    areas = daily.select("area").distinct()
    unnamed = areas.limit(1).select(F.lit(None).cast("string").alias("area"))
    grid = fc.forecast_grid(areas.unionAll(unnamed), _as_of(daily))
    base = fc.base_volumes(daily)
    usual = base.agg(F.avg("base_volume")).scalar()
    factors = fc.day_multipliers(daily)
    named = fc.fallback_forecast(grid.filter("area IS NOT NULL"), base, factors)
    other = grid.filter("area IS NULL").withColumn("predicted_volume", fc.half_even(usual, 1))
    return fc.forecast_volumes(grid, model, named.unionByName(other))


@query
def rf_forecast(spark, sf_dir):
    forecast = _forecast(spark, sf_dir, _volume_model(spark, sf_dir))
    return forecast.select("area", iso("prediction_date"), "predicted_volume")


@query
def rf_forecast_keys(spark, sf_dir):
    """What SQL can know of ``rf_forecast``: areas and days, each with a volume; the
    days of the area without features are the fallback's."""
    forecast = rf_forecast(spark, sf_dir)
    own = F.when(F.col("area").isNull(), F.col("predicted_volume"))
    return forecast.select(
        "area", "prediction_date", (F.col("predicted_volume") > 0).alias("valid"), own.alias("fallback_volume")
    )


@query
def forecast_without_model(spark, sf_dir):
    """No model is stored where this looks, so all of the grid falls back."""
    store = models.ModelStore(spark, fresh_path(spark, "no_models"))
    model = store.find("volume", _made_from(spark, sf_dir), lambda path: fc.VolumeModel.load(spark, path))
    forecast = _forecast(spark, sf_dir, model).filter("area IS NOT NULL")
    return forecast.select("area", iso("prediction_date"), "predicted_volume")


@query
def nested_forecast(spark, sf_dir):
    nested = fc.nested_forecast(_fallback(spark, sf_dir))
    day = calendar.iso_date(F.col("days")[6]["prediction_date"])
    return nested.select(
        "area",
        F.size("days").alias("days"),
        F.col("days")[0]["predicted_volume"].alias("first_volume"),
        day.alias("last_date"),
    )


@query
def forecast_snapshot(spark, sf_dir):
    return dashboard.forecast_snapshot(_fallback(spark, sf_dir))


@query
def forecast_lines(spark, sf_dir):
    return dashboard.forecast_lines(_fallback(spark, sf_dir))


@query
def nested_forecast_lines(spark, sf_dir):
    return dashboard.nested_lines(_fallback(spark, sf_dir))


# -- streams --------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.read_table_stream(spark, f"{sf_dir}/events.parquet")


def _scattered_events(spark: SparkSession, sf_dir: str, files: int = 8) -> DataFrame:
    """All events as a stream of files which each hold events of all times, a few
    files per batch: arrival has nothing to do with event time."""
    path = fresh_path(spark, "scattered")
    _events(spark, sf_dir).repartition(files, F.xxhash64("event_id")).write.parquet(path)
    return run.read_table_stream(spark, path, files_per_batch=3)


@query
def stream_report_intake(spark, sf_dir):
    out, state = fresh_path(spark, "reports"), fresh_path(spark, "state")
    intake.store_intake(b.reports(_scattered_events(spark, sf_dir)), out, state)
    return spark.read.parquet(out).drop("batch").withColumn("created_at", stamp("created_at"))


@query
def stream_daily_counts(spark, sf_dir):
    out, state = fresh_path(spark, "daily"), fresh_path(spark, "state")
    intake.store_daily_counts(b.reports(_scattered_events(spark, sf_dir)), out, state)
    return intake.read_counts(spark, out).withColumn("day", iso("day"))


@query
def stream_status_counts(spark, sf_dir):
    out, state = fresh_path(spark, "totals"), fresh_path(spark, "state")
    intake.store_running_counts(b.reports(_scattered_events(spark, sf_dir)), out, state)
    return intake.read_counts(spark, out)


@query
def stream_model_scoring(spark, sf_dir):
    """As ``stream_scoring``, by the stored classifier."""
    out, state = fresh_path(spark, "scored"), fresh_path(spark, "state")
    model = _classifier(spark, sf_dir)
    scoring.score_stream(b.requests(_event_stream(spark, sf_dir)), out, state, model)
    return spark.read.parquet(out).select("id", "outcome", *scoring.RESULT)


@query
def stream_model_scoring_rows(spark, sf_dir):
    """What SQL can know of it: the outcome of each request, and that scored ones
    have a known type."""
    rows = stream_model_scoring(spark, sf_dir)
    return rows.select("id", "outcome", F.col("predicted_type").isin(b.ALL_TYPES).alias("typed"))


@query
def stream_scoring(spark, sf_dir):
    out, state = fresh_path(spark, "scored"), fresh_path(spark, "state")
    scoring.score_stream(b.requests(_event_stream(spark, sf_dir)), out, state)
    return spark.read.parquet(out).select("id", "outcome", *scoring.RESULT)


@query
def stream_insert_if_absent(spark, sf_dir):
    stored, new = _stored_and_new(_daily_volumes(spark, sf_dir))
    path, arriving = fresh_path(spark, "predictions"), fresh_path(spark, "arriving")
    tables.insert_if_absent(stored, path, forecasts.KEYS, partition_by="prediction_date")
    tables.append(new, arriving)
    for state in ("first", "replay"):
        stream = run.read_table_stream(spark, arriving)
        forecasts.store_forecasts(stream, path, fresh_path(spark, state))
    return _stored_predictions(spark, path)
