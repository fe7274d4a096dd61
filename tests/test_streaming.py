from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from curbside.operators import classify, reports as rep
from curbside.session import fresh_path
from curbside.streaming import forecasts, intake, run, scoring
from tests.test_schedule_reports import RAW

T0 = dt.datetime(2024, 1, 1)


def report(i, hours, status="pending"):
    return (i, "n", "l", "Glass", "d", None, status, T0 + dt.timedelta(hours=hours))


class Inbox:
    """A folder into which files arrive."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, fresh_path(spark, "inbox")

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self, **options):
        return run.read_table_stream(self.spark, self.path, **options)


def scattered(n=1000):
    """Reports of ten days, newest first."""
    return [report(n - i, (n - i) * 240 / n, ["pending", "resolved"][i % 2]) for i in range(n)]


def test_each_report_is_stored_once_in_any_order(spark):
    box, out, state = Inbox(spark, RAW), fresh_path(spark, "out"), fresh_path(spark, "state")
    rows = scattered()
    box.put(rows[:400])
    intake.store_intake(box.stream(), out, state)
    # A restart: older reports only, repeats of stored ones, repeats in the file.
    box.put(rows[400:] + rows[:50] + rows[990:])
    box.put(rows[100:120])
    intake.store_intake(box.stream(files_per_batch=1), out, state)
    want = rep.clean_reports(spark.createDataFrame(rows, RAW))
    got = spark.read.parquet(out).select(want.columns)
    assert got.count() == 1000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_reports_without_an_id_are_no_repeats(spark):
    box, out, state = Inbox(spark, RAW), fresh_path(spark, "out"), fresh_path(spark, "state")
    box.put([report(None, 1), report(None, 1), report(1, 1), report(1, 2)])
    intake.store_intake(box.stream(), out, state)
    assert sorted(str(r["id"]) for r in spark.read.parquet(out).collect()) == ["1", "None", "None"]


def test_daily_counts_take_in_late_reports_and_the_last_day(spark):
    box, out, state = Inbox(spark, RAW), fresh_path(spark, "out"), fresh_path(spark, "state")
    rows = scattered()
    for part in (rows[:300], rows[300:310], rows[310:] + rows[:7]):
        box.put(part)
        intake.store_daily_counts(box.stream(), out, state)
    batch = intake.daily_status_counts(spark.createDataFrame(rows, RAW))
    got = intake.read_counts(spark, out)
    key = lambda df: sorted(tuple(r) for r in df.select("day", "status", "n").collect())
    assert key(got) == key(batch) and sum(n for _, _, n in key(got)) == 1000


def test_a_batch_run_again_counts_once(spark):
    """As after a crash between the write and the commit."""
    box, out, state = Inbox(spark, RAW), fresh_path(spark, "out"), fresh_path(spark, "state")
    box.put([report(1, 1), report(2, 30)])
    intake.store_daily_counts(box.stream(), out, state)
    for name in os.listdir(f"{state}/commits"):
        os.remove(f"{state}/commits/{name}")
    intake.store_daily_counts(box.stream(), out, state)
    assert intake.read_counts(spark, out).agg(F.sum("n")).first()[0] == 2


def test_daily_counts_of_a_batch(spark):
    df = spark.createDataFrame([report(1, 1), report(2, 2), report(3, 30)], RAW)
    got = {(r["day"].day, r["n"]) for r in intake.daily_status_counts(df).collect()}
    assert got == {(1, 2), (2, 1)}


def test_running_totals_go_on_after_a_restart(spark):
    box, out, state = Inbox(spark, RAW), fresh_path(spark, "out"), fresh_path(spark, "state")
    box.put([report(1, 1), report(2, 2)])
    intake.store_running_counts(box.stream(), out, state)
    box.put([report(3, 1, "resolved"), report(4, 2)])
    intake.store_running_counts(box.stream(), out, state)
    assert {tuple(r) for r in intake.read_counts(spark, out).collect()} == {("pending", 3), ("resolved", 1)}


REQUEST = "id int, weight_kg string, moisture_pct string, recyclable string, material_type string"
REQUESTS = [(i, "2.5" if i % 4 else "heavy", str(i), "1", "ferrous" if i % 3 else None) for i in range(80)]


@pytest.mark.parametrize("with_model", [False, True])
def test_scores_are_the_batch_scores_and_nothing_is_lost(spark, sample, with_model):
    model = classify.train_classifier(sample, classify.forest(3, 4)) if with_model else None
    box, out = Inbox(spark, REQUEST), fresh_path(spark, "out")
    box.put(REQUESTS)
    scoring.score_stream(box.stream(), out, fresh_path(spark, "state"), model)
    got = spark.read.parquet(out)
    good, bad = classify.classify_requests(spark.createDataFrame(REQUESTS, REQUEST), model)
    columns = ["id", *scoring.RESULT]
    scored = got.filter("outcome = 'scored'").select(columns)
    assert scored.exceptAll(good.select(columns)).count() == 0
    assert scored.count() == good.count() == 60
    aside = {r["id"]: r["request"] for r in got.filter("outcome = 'quarantined'").collect()}
    assert set(aside) == {r["id"] for r in bad.collect()}
    assert '"weight_kg":"heavy"' in aside[4]


def test_forecasts_are_stored_once_even_on_replay(spark):
    schema = "area string, predicted_volume double, prediction_date date"
    box, path = Inbox(spark, schema), fresh_path(spark, "predictions")
    day = [dt.date(2024, 1, d) for d in range(1, 8)]
    box.put([("a", 1.0, d) for d in day] + [("a", 1.0, day[0])])
    forecasts.store_forecasts(box.stream(), path, fresh_path(spark, "s1"))
    box.put([("a", 9.0, d) for d in day] + [("b", 2.0, day[0])])
    # A new checkpoint folder replays everything.
    forecasts.store_forecasts(box.stream(files_per_batch=1), path, fresh_path(spark, "s2"))
    got = spark.read.parquet(path)
    assert got.count() == 8
    assert {r["predicted_volume"] for r in got.filter("area = 'a'").collect()} == {1.0}


def test_a_single_file_can_be_streamed(spark):
    box = Inbox(spark, RAW)
    box.put([report(1, 1)])
    name = [f for f in spark.read.parquet(box.path).inputFiles()][0].removeprefix("file://")
    out = fresh_path(spark, "out")
    intake.store_running_counts(run.read_table_stream(spark, name), out, fresh_path(spark, "state"))
    assert intake.read_counts(spark, out).agg(F.sum("n")).first()[0] == 1


def test_repeats_are_known_from_the_index_and_no_state_is_kept(spark):
    """Shuffled files, replays and a compacted index: the stream gives what a batch gives."""
    import random

    box, out, state = Inbox(spark, RAW), fresh_path(spark, "out"), fresh_path(spark, "state")
    rows = scattered(600)
    random.Random(3).shuffle(rows)
    for k in range(0, 600, 150):
        box.put(rows[k : k + 150] + rows[: k // 3])
    intake.store_intake(box.stream(files_per_batch=1), out, state)
    # The last batch again, as after a crash before its commit.
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{state}/commits/{name}")
    intake.store_intake(box.stream(files_per_batch=1), out, state)
    want = rep.clean_reports(spark.createDataFrame(rows, RAW))
    got = spark.read.parquet(out).select(want.columns)
    assert got.count() == 600 and got.exceptAll(want).count() == 0
    assert not os.path.isdir(f"{state}/state")
    index = spark.read.parquet(f"{state}-ids")
    assert index.count() == 600 == index.select("id").distinct().count()
    assert index.select("bucket").distinct().count() == intake.BUCKETS
    # A batch of one known and one new id reads two buckets at most.
    batch = spark.createDataFrame([report(1, 1), report(10_000, 1)], RAW)
    found = intake.new_ids(batch, 99, f"{state}-ids", ("id",))
    assert [r["id"] for r in found.collect()] == [10_000]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    compact = fresh_path(spark, "ids")
    intake.compact_ids(spark, f"{state}-ids", last + 1, compact)
    again = spark.read.parquet(compact)
    assert again.count() == 600 and again.select("batch").distinct().count() == 1
    assert [r["id"] for r in intake.new_ids(batch, 99, compact, ("id",)).collect()] == [10_000]


def test_keys_of_two_columns_and_empty_batches(spark):
    box, out, state = Inbox(spark, RAW), fresh_path(spark, "out"), fresh_path(spark, "state")
    box.put([report(1, 1), report(1, 2)])
    store = lambda: intake.store_intake(box.stream(files_per_batch=1), out, state, ("id", "created_at"))
    store()
    box.put([report(1, 2)])
    box.put([report(2, 2), report(1, 1)])
    store()
    got = spark.read.parquet(out)
    assert sorted((r["id"], r["created_at"].hour) for r in got.collect()) == [(1, 1), (1, 2), (2, 2)]
