from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from curbside import schemas
from curbside.operators import quality
from curbside.session import fresh_path
from curbside.sources import csv as csv_source, tables
from tests import fixtures as fx


def test_nulls_are_counted_and_set_aside(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), (None, None), ("", "x")], "p string, q string")
    got = {r["column"]: r["nulls"] for r in quality.not_null_violations(df, ["p", "q"]).collect()}
    assert got == {"p": 2, "q": 1}
    good, bad = quality.split_not_null(df, ["p", "q"])
    assert (good.count(), bad.count()) == (2, 2)


def test_repeats(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), (None, 6)], "k string, o int")
    assert [tuple(r) for r in quality.unique_violations(df, ["k"]).collect()] == [("a", 2)]
    assert quality.repeated_texts(df, "k").first()["copies"] == 2
    assert {tuple(r) for r in quality.keep_first(df, ["k"], ["o"]).collect()} == {("a", 1), ("b", 2), (None, 5)}


def test_defaults_and_ids(spark):
    df = spark.createDataFrame([("x", None), ("y", "admin")], "name string, role string")
    filled = quality.apply_defaults(df, schemas.DEFAULTS["users"])
    assert {tuple(r) for r in filled.collect()} == {("x", "citizen"), ("y", "admin")}
    assert [tuple(r) for r in quality.assign_ids(filled, ["name"]).orderBy("id").select("id", "name").collect()] == [
        (1, "x"), (2, "y"),
    ]
    keys = [r["id"] for r in quality.stable_key(df, ["name", "role"]).collect()]
    assert len(set(keys)) == 2
    assert keys == [r["id"] for r in quality.stable_key(df.repartition(3), ["name", "role"]).orderBy("name").collect()]


def test_csv_round_trip_and_bad_lines(spark, sample):
    path = fresh_path(spark, "csv")
    sample.write.csv(path, header=True)
    back = csv_source.read_collections(spark, path)
    assert back.schema == schemas.COLLECTIONS_CSV
    assert sorted(back.collect()) == sorted(sample.collect())
    bad = fresh_path(spark, "bad")
    header = ",".join(schemas.COLLECTIONS_CSV.names)
    lines = [header, "1,ISBT,Glass,heavy,2,1,silica,Monday,1,4.0", "2,ISBT,Glass,1.5,2,1,silica,Monday,1,4.0"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(bad)
    got = {r["id"]: r for r in csv_source.read_with_malformed(spark, bad).collect()}
    assert got[1]["weight_kg"] is None and "heavy" in got[1]["_malformed"]
    assert got[2]["weight_kg"] == 1.5 and got[2]["_malformed"] is None


def test_dates_go_back_from_the_load_day(spark):
    ids = spark.range(1, 4).toDF("id")
    got = csv_source.assign_dates(ids, "2024-03-01").orderBy("id").collect()
    assert [r["collection_date"] for r in got] == [dt.date(2024, 3, 1), dt.date(2024, 2, 29), dt.date(2024, 2, 28)]
    far = spark.createDataFrame([(2_147_483_650,), (None,)], "id long")
    assert [r["collection_date"] for r in csv_source.assign_dates(far, "2024-03-01").collect()] == [None, None]
    gaps = spark.createDataFrame([(10,), (70,), (35,)], "id long")
    got = csv_source.assign_dates_in_order(gaps, "2024-03-01", ["id"]).orderBy("id").collect()
    assert [r["collection_date"].day for r in got] == [1, 29, 28]


def test_load_if_empty_loads_once(spark, sample):
    path = fresh_path(spark, "table")
    assert tables.read_or_none(spark, path) is None
    assert tables.load_if_empty(sample.limit(0), path)
    assert tables.load_if_empty(sample, path)
    assert not tables.load_if_empty(sample, path)
    assert spark.read.parquet(path).count() == 400


def predictions(spark, rows):
    return spark.createDataFrame(
        [(a, v, dt.date.fromisoformat(d), 0.87, None) for a, v, d in rows], schemas.PREDICTIONS
    )


def test_insert_if_absent_keeps_what_is_there(spark):
    path = fresh_path(spark, "predictions")
    keys = ["area", "prediction_date"]

    def insert(rows):
        tables.insert_if_absent(predictions(spark, rows), path, keys, "prediction_date")

    insert([("a", 1.0, "2024-01-01"), ("b", 2.0, "2024-01-01")])
    insert([("a", 9.0, "2024-01-01"), ("a", 3.0, "2024-01-02")])
    insert([("a", 9.0, "2024-01-01"), ("a", 8.0, "2024-01-02")])
    insert([("c", 5.0, "2024-01-03"), ("c", 5.0, "2024-01-03")])
    got = {(r["area"], str(r["prediction_date"]), r["predicted_volume"]) for r in spark.read.parquet(path).collect()}
    assert got == {
        ("a", "2024-01-01", 1.0), ("b", "2024-01-01", 2.0), ("a", "2024-01-02", 3.0), ("c", "2024-01-03", 5.0),
    }
    assert spark.read.parquet(path).count() == 4


def test_a_null_key_is_found_again(spark):
    path = fresh_path(spark, "predictions")
    rows = [(None, 1.0, dt.date(2024, 1, 1)), ("a", 2.0, None), ("a", 3.0, dt.date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "area string, predicted_volume double, prediction_date date")
    for _ in range(3):
        tables.insert_if_absent(df, path, ["area", "prediction_date"], "prediction_date")
    assert spark.read.parquet(path).count() == 3


def test_the_first_row_of_a_key_is_kept(spark):
    path = fresh_path(spark, "predictions")
    rows = [("a", float(v), "2024-01-01") for v in (7, 3, 5)]
    for _ in range(2):
        tables.insert_if_absent(
            predictions(spark, rows).repartition(3), path, ["area", "prediction_date"], "prediction_date",
            ["predicted_volume"],
        )
    assert [r["predicted_volume"] for r in spark.read.parquet(path).collect()] == [3.0]


def test_only_the_days_at_hand_are_read(spark):
    path = fresh_path(spark, "predictions")
    rows = [("a", 1.0, f"2024-01-{d:02d}") for d in range(1, 29)]
    tables.append(predictions(spark, rows), path, ["prediction_date"])
    new = predictions(spark, [("a", 2.0, "2024-01-05")])
    plan = tables.only_absent(new, spark.read.parquet(path), ["area", "prediction_date"], "prediction_date")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prediction_date" in text and "2024-01-05" in text


def test_a_hot_key_is_inserted_once(spark):
    path = fresh_path(spark, "predictions")
    rows = spark.range(3000).select(
        F.lit("a").alias("area"), (F.col("id") / 1).alias("predicted_volume"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("date").alias("prediction_date"),
    )
    tables.insert_if_absent(rows, path, ["area", "prediction_date"], "prediction_date")
    assert spark.read.parquet(path).count() == 2


def test_fixture_covers_each_area_and_type(sample):
    assert sample.select("area", "waste_type").distinct().count() == 25
    assert fx.record(0)[0] == 1


def test_scratch_folders_are_deleted_when_asked(spark, tmp_path, monkeypatch):
    from curbside import session

    monkeypatch.setattr(session, "_HANDED_OUT", session.defaultdict(list))
    path = session.fresh_path(spark, "scratch")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert session.clean_up(spark) == 1 and session.clean_up(spark) == 0
    assert tables.read_or_none(spark, path) is None
