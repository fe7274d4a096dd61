from __future__ import annotations

import os
import random
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from curbside.llm.queries import ORACLE_SQL, QUERIES
from curbside.session import fresh_path
from tests.llm import helpers as h

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    names = [q for q in entry_module.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry_module.queries() and set(ORACLE_SQL) < set(entry_module.oracle_sql())


def test_without_the_package_the_entry_point_still_works(tmp_path):
    """As after both folders and the pipeline are deleted."""
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    for name in ("__spark_entry__.py", "curbside"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith(('op', 'pipeline'))]; assert len(e.queries()) > 60"
    assert os.system(f"cd {tmp_path} && PYTHONPATH={tmp_path} python -B -c \"{code}\"") == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(columns) == sorted(df.columns)
    assert h.rows(df, *sorted(columns)) == sorted(
        (tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in found.fetchall()), key=str
    )


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(6)
    items = [h.prose(rng, 40, 5000) for _ in range(3)]
    clean = [h.prose(rng, 120, 5000) for _ in range(20)]
    near = clean[0].split()
    near[60] = "changed"
    texts = [
        *clean, " ".join(near), clean[1], "short text", " ".join(w + "%%%" for w in clean[2].split()),
        f"{clean[3][:300]} {items[1]} {h.prose(rng, 80, 5000)}",
        f"{h.prose(rng, 100, 5000)} write to joe (at) mail (dot) com or +1 (017) 555-7713",
    ]
    path = fresh_path(spark, "tables")
    h.documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, folder):
    docs, kept = corpus_pipeline.documents(spark, folder), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        if name != "mixing":
            assert docs.columns == before.columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name == "personal_data":
            text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    everything = set(range(26))
    assert kept["quality_rules"] == everything - {22, 23}
    assert kept["near_duplicates"] == kept["quality_rules"] - {20, 21}
    assert kept["decontamination"] == kept["near_duplicates"] - {24}
    assert kept["mixing"] == kept["personal_data"] == kept["decontamination"]
    assert text[25][0].endswith("write to [EMAIL] or [PHONE]") and text[25][1] == len(text[25][0])
    assert h.rows(corpus_pipeline.run(spark, folder), "doc_id", "taken") == h.rows(docs, "doc_id", "taken")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_awkward_rows_in_every_stage(spark, folder, name, stage):
    df = h.awkward(spark)
    out = stage(spark, df, folder)
    assert out.count() <= df.count()
    if name != "mixing":
        assert out.columns == df.columns
    assert stage(spark, h.empty(spark), folder).count() == 0
    nothing = df.withColumn("text", F.lit(None).cast("string"))
    assert stage(spark, nothing, folder).count() <= df.count()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_of_the_other_queries(spark, name):
    rows = QUERIES[name](spark, SF_DIR).count()
    assert rows > 0 if name == "op10_benchmark_leaks" else rows == 200


def test_distinct_texts_of_one_id_and_clashing_names(spark):
    from curbside.llm import jaccard_join

    rng = random.Random(2)
    long, other = h.prose(rng, 60), h.prose(rng, 60)
    rows = [(1, long, "a", 1), (1, other, "b", 2), (2, long + " end", "c", 3), (3, "alone " + h.prose(rng, 40), "d", 4), (1, long, "a", 1), (None, long, "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, place int")
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns
    want = {(1, long), (1, other), (3, rows[3][1]), (None, long)}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == want and out.count() == 4
