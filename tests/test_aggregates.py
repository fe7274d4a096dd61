from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from curbside.operators import aggregates as agg
from curbside.plans.dashboard import dashboard_lines, dashboard_snapshot
from tests import fixtures as fx


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_known_totals(spark):
    cells = fx.cells(spark)
    by_type = agg.largest_first(agg.totals_by(cells, ["waste_type"], {"total_kg": "weight_kg"}), "total_kg")
    assert [tuple(r) for r in by_type.collect()] == [
        ("Organic", 297.8), ("Glass", 151.4), ("Plastic", 118.2), ("Metal", 106.6), ("Paper", 93.1),
    ]
    by_area = agg.totals_by(cells, ["area"], {"total_kg": "weight_kg"}, count_as="n")
    assert as_dict(by_area, "area", "total_kg") == {
        "Clock Tower": 224.0, "ISBT": 176.3, "Rajpur Road": 142.3, "Prem Nagar": 127.3, "Clement Town": 97.2,
    }
    assert {r["n"] for r in by_area.collect()} == {5}
    assert agg.totals_by(cells, [], {"total_kg": "weight_kg"}).first()[0] == 767.1


def test_pivot_is_the_long_form(spark):
    cells = agg.totals_by(fx.cells(spark), ["area", "waste_type"], {"total_kg": "weight_kg"})
    for r in agg.pivot_totals(cells, "area", "waste_type", "total_kg", fx.TYPES).collect():
        assert [r[t] for t in fx.TYPES] == fx.KG[r["area"]]


def test_an_empty_cell_of_the_pivot_is_zero(spark):
    cells = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "area string, t string, kg double")
    got = agg.pivot_totals(cells, "area", "t", "kg", ["x", "y", "z"]).orderBy("area").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, 0.0, 0.0, 0.0), ("b", 0.0, 2.0, 0.0, 0.0)]


def test_what_is_not_declared_goes_to_other(spark):
    rows = [("a", "x", 1.0), ("a", "new", 5.0), ("a", "newer", 2.0), ("a", None, 0.5), ("b", "y", 2.0)]
    cells = spark.createDataFrame(rows, "area string, t string, kg double")
    got = agg.pivot_totals(cells, "area", "t", "kg", ["x", "y"]).orderBy("area").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, 0.0, 7.5), ("b", 0.0, 2.0, 0.0)]


def test_kpi_row(sample):
    r = agg.kpi_stats(sample).first()
    rows = [fx.record(i) for i in range(400)]
    assert r["total_waste_kg"] == pytest.approx(sum(x[3] for x in rows), abs=1e-9)
    assert r["recyclable_count"] == 320
    assert r["total_records"] == 400


def test_known_cards(spark):
    stats = spark.createDataFrame(
        [(767.1, 1944.1, 25.2, 160, 200)],
        "total_waste_kg double, total_volume double, avg_moisture double, recyclable_count bigint, total_records bigint",
    )
    assert tuple(agg.kpi_cards(stats, spark.range(3)).first()) == (0.8, 1944.0, 80.0, 3)
    assert {tuple(r) for r in agg.recyclable_split(stats).collect()} == {
        ("Recyclable", 160), ("Non-Recyclable", 40),
    }


def test_an_empty_table(sample):
    stats = agg.kpi_stats(sample.limit(0))
    r = stats.first()
    assert (r["total_waste_kg"], r["avg_moisture"], r["total_records"]) == (None, None, 0)
    assert agg.recyclable_split(stats).count() == 0
    assert agg.kpi_cards(stats).first()["recyclable_pct"] == 0.0


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in agg.value_counts(df, "v").collect()] == [("b", 2, 66.7), ("a", 1, 33.3)]


def test_matrix_from_the_margins(spark):
    cells = fx.cells(spark)
    by_area = agg.totals_by(cells, ["area"], {"total_kg": "weight_kg"})
    by_type = agg.totals_by(cells, ["waste_type"], {"total_kg": "weight_kg"})
    got = {(r["area"], r["waste_type"]): r for r in agg.matrix_estimate(by_area, by_type).collect()}
    assert len(got) == 25
    assert got["Clock Tower", "Organic"]["estimate"] == 6.7
    assert got["Clock Tower", "Organic"]["intensity"] == 1.0
    assert got["Clement Town", "Paper"]["estimate"] == 0.9


def test_group_total_repeats_the_total(sample):
    got = agg.group_total(sample, ["area", "day_of_week"], "volume_liters")
    assert got.count() == 400
    # Per group the total is there once per row.
    check = got.groupBy("area", "day_of_week").agg(
        F.count_distinct("group_total").alias("d"), F.max("group_total").alias("t"),
        F.sum("volume_liters").alias("s"),
    )
    for r in check.collect():
        assert r["d"] == 1 and r["t"] == pytest.approx(r["s"])


def area_key_figures(sample):
    facts = sample.withColumns({"has_moisture": F.lit(1.0), "recyclable": F.col("recyclable").cast("double")})
    measures = {**agg.KPI_MEASURES, "moisture_count": "has_moisture"}
    return agg.totals_by(facts, ["area"], measures, "collections", digits=6)


def test_lines_hold_the_items_of_the_document_however_many(spark, sample):
    many = spark.range(12_000).select(
        F.concat(F.lit("type "), F.col("id")).alias("waste_type"),
        F.col("id").cast("double").alias("total_kg"),
        F.lit(1.0).alias("total_volume"),
    )
    reports = spark.createDataFrame([("pending",)], "status string")
    areas = agg.totals_by(sample, ["area"], count_as="collections")
    lines = dashboard_lines(many, areas, reports)
    types = lines.filter("section = 'waste_by_type'")
    assert types.count() == 12_000
    first = json.loads(types.orderBy("position").first()["item"])
    assert first == {"waste_type": "type 11999", "total_kg": 11999.0, "total_volume": 1.0}
    doc = json.loads(dashboard_snapshot(many, area_key_figures(sample), reports).first()[0])
    assert len(doc["waste_by_type"]) == 12_000


def test_snapshot_is_one_json_document(spark, sample):
    by_type = agg.totals_by(sample, ["waste_type"])
    by_area = area_key_figures(sample)
    reports = spark.createDataFrame([("pending",), ("pending",), ("resolved",)], "status string")
    doc = json.loads(dashboard_snapshot(by_type, by_area, reports).first()[0])
    assert set(doc) == {
        "waste_by_type", "waste_by_area", "reports_summary", "stats", "total_reports", "collection_schedule",
    }
    kgs = [x["total_kg"] for x in doc["waste_by_type"]]
    assert kgs == sorted(kgs, reverse=True) and len(kgs) == 5
    assert sum(kgs) == pytest.approx(doc["stats"]["total_waste_kg"])
    assert doc["reports_summary"] == [{"status": "pending", "count": 2}, {"status": "resolved", "count": 1}]
    assert doc["total_reports"] == 3
    want = agg.kpi_stats(sample).first().asDict()
    assert doc["stats"] == pytest.approx(want)
    empty = json.loads(dashboard_snapshot(by_type.limit(0), by_area.limit(0), reports).first()[0])
    assert empty["stats"]["total_waste_kg"] is None and empty["collection_schedule"] == []
    assert [x["time"] for x in doc["collection_schedule"]] == ["6:00 AM", "8:00 AM", "10:00 AM", "12:00 PM", "2:00 PM"]
