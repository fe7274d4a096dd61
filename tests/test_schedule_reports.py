from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from curbside.functions import lookups, text
from curbside.operators import reports as rep, schedule as sched
from tests import fixtures as fx


def test_known_schedule(spark):
    volumes = spark.createDataFrame(list(fx.LITERS.items()), "area string, total_volume double")
    got = [tuple(r) for r in sched.collection_schedule(volumes).orderBy("run_order").collect()]
    assert got == [
        (1, "Clock Tower", "6:00 AM", "High", 573.1),
        (2, "ISBT", "8:00 AM", "High", 460.5),
        (3, "Rajpur Road", "10:00 AM", "Medium", 350.6),
        (4, "Prem Nagar", "12:00 PM", "Medium", 319.6),
        (5, "Clement Town", "2:00 PM", "Medium", 240.3),
    ]


def test_thresholds_are_strict_slots_repeat_and_ties_go_by_name(spark):
    rows = [("b", 400.0), ("a", 400.0), ("c", 200.0), ("d", 400.1), ("e", 1.0), ("f", 0.5)]
    volumes = spark.createDataFrame(rows, "area string, total_volume double")
    schedule = sched.collection_schedule(volumes)
    got = [(r["area"], r["priority"], r["time"]) for r in schedule.orderBy("run_order").collect()]
    assert got == [
        ("d", "High", "6:00 AM"), ("a", "Medium", "8:00 AM"), ("b", "Medium", "10:00 AM"),
        ("c", "Low", "12:00 PM"), ("e", "Low", "2:00 PM"), ("f", "Low", "6:00 AM"),
    ]
    assert [r["area"] for r in sched.first_runs(schedule, 3).orderBy("run_order").collect()] == ["d", "a", "b"]


def test_zone_layer(spark):
    rows = [("Clock Tower", 500.0), ("ISBT", 300.0), ("Prem Nagar", 65.0), ("nowhere", 9.0)]
    volumes = spark.createDataFrame(rows, "area string, total_volume double")
    got = {r["area"]: r for r in sched.zone_layer(volumes, lookups.zones(spark)).collect()}
    # An area that no zone knows stays, without a place on the map.
    assert set(got) == {"Clock Tower", "ISBT", "Prem Nagar", "nowhere"}
    assert (got["nowhere"]["lat"], got["nowhere"]["lng"], got["nowhere"]["radius"]) == (None, None, 390.0)
    assert got["Prem Nagar"]["radius"] == 950.0
    assert got["Prem Nagar"]["halo_radius"] == 1425.0
    assert [got[a]["next_pickup"] for a in ("Clock Tower", "ISBT", "Prem Nagar")] == ["6:00 AM", "8:00 AM", "10:00 AM"]
    assert (got["ISBT"]["lat"], got["ISBT"]["lng"]) == (30.2921, 78.0492)


RAW = "id long, reporter_name string, location string, waste_type string, description string, image_name string, status string, created_at timestamp"
AT = dt.datetime(2024, 1, 5, 0, 7, 9)


def test_missing_fields_are_filled(spark):
    rows = [
        (1, None, None, None, None, None, "resolved", AT),
        (2, "Ann", "", "Glass", "", "", None, AT),
        (3, "Bo", "x", "Mixed", "d", "a b.jpg", "in_progress", AT),
    ]
    df = spark.createDataFrame(rows, RAW)
    got = [tuple(r)[1:7] for r in rep.clean_reports(df).orderBy("id").collect()]
    assert got == [
        ("Anonymous", "", "Unknown", "", None, "pending"),
        ("Ann", "", "Glass", "", None, "pending"),
        ("Bo", "x", "Mixed", "d", "20240105_000709_a b.jpg", "pending"),
    ]
    kept = rep.clean_reports(df, keep_status=True).orderBy("id").collect()
    assert [r["status"] for r in kept] == ["resolved", "pending", "in_progress"]


def test_display_text(spark):
    df = spark.createDataFrame(
        [("in_progress_now", "", AT), ("pending", None, None), ("x", "text", dt.datetime(2024, 12, 31, 15, 4))],
        "s string, d string, t timestamp",
    )
    got = df.select(
        text.first_upper(F.col("s")), text.first_underscore_as_space(F.col("s")),
        text.or_dash(F.col("d")), text.display_time(F.col("t")),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("In_progress_now", "in progress_now", "—", "05 Jan 24, 12:07 am"),
        ("Pending", "pending", "—", "—"),
        ("X", "x", "text", "31 Dec 24, 03:04 pm"),
    ]


def test_latest_reports_break_ties_by_id(spark):
    rows = [(i, "n", "l", "t", "d", None, "pending", AT + dt.timedelta(hours=i // 2)) for i in range(120)]
    got = rep.latest_reports(spark.createDataFrame(rows, RAW), 50).collect()
    assert [r["id"] for r in got] == list(range(119, 69, -1))
