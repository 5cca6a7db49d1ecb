"""The registered queries over the smallest shared tables: against their SQL, or against plain Python."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
import corpus_pipeline
from plenum.llm import decontaminate, jaccard
from plenum.llm.queries import MORE_QUERIES, QUERIES
from tools.check_queries import database, run

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not here")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entrypoint.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    state, problem, _, rows = run(spark, database(FOLDER), FOLDER, name, QUERIES[name])
    assert state in ("same", "rows-only"), problem
    assert rows > 0 or name == "op5_decontaminate"


@pytest.mark.parametrize("name", sorted(MORE_QUERIES))
def test_further_query(spark, name):
    assert name in entrypoint.queries()
    state, problem, _, rows = run(spark, database(FOLDER), FOLDER, name, MORE_QUERIES[name])
    assert state == "same" and rows > 0, problem


def test_held_out_folds_and_accuracy(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = QUERIES["op9_language"][0](spark, FOLDER).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) == len(docs) and {r["doc_id"] for r in out if r["held_out"]} == {r["doc_id"] for r in held}
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) > 0.95


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        tables.append(docs)
    assert all(t.columns == columns for t in tables[:-1])
    known, single, clean, mixed, placed = tables
    assert all(any(c.isalpha() for c in r["text"]) for r in known.collect())
    classes = {r["doc_id"]: r["component_id"] for r in jaccard.classes(known, n=5, percent=80).collect()}
    assert {r["doc_id"] for r in single.collect()} == set(classes.values())
    leaking = {r["doc_id"] for r in decontaminate.leaks(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaking
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert placed.count() == mixed.count() and placed.select("shard", "slot").distinct().count() == placed.count()


def test_pipeline_stages_take_awkward_and_empty_tables(spark, awkward):
    for rows in (awkward, awkward.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, FOLDER)
        assert rows.count() >= 0
