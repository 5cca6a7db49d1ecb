"""Every catalog query runs, and agrees with its SQL where it has one."""

import os

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from plenum.catalog import rule_queries
from plenum.catalog.registry import entries
from tools.check_queries import database, run

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not here")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(entries()))
def test_query(spark, con, name):
    state, problem, _, rows = run(spark, con, FOLDER, name, entries()[name])
    assert state in ("same", "rows-only"), problem
    assert rows >= 0


def test_entry(spark):
    assert entrypoint.entry(spark).columns == ["query_id", "candidate_id", "score", "rank"]
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


def test_selectors_classify_once(spark, tmp_path):
    """Four selections read one written classification; the rules are not evaluated for each of them."""
    rows = [(i, i % 3, "click", float(i), f'{{"k": {i}}}') for i in range(60)] + [(None, 1, "click", 0.5, '{"k": 4}'), (7, None, None, None, None)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    out = rule_queries.QUERIES["message_selectors"][0](spark, str(tmp_path))
    assert "RLIKE" not in out._jdf.queryExecution().executedPlan().toString().upper()
    c = rule_queries.classified(spark, str(tmp_path))
    assert out.where("selector = 'uncategorised'").count() == c.where("should_be_uncategorized").count() > 0
    assert out.where("selector = 'substantive'").count() == c.where("message_quality = 'substantive'").count() > 0
