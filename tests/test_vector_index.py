"""The pruned search against the plain one, row by row, and what it skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators.matching import Pair, block_topk
from plenum.operators.vector_index import pruned_topk


def table(spark, n, seed, groups=12, spread=0.1, blocks=3):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(groups, 6))
    rows = []
    for i in range(n):
        block = 0 if i % 2 else int(pick.integers(0, blocks))
        rows.append((i, f"b{block}", int(pick.integers(0, 30)), (centres[i % groups] + pick.normal(size=6) * spread).tolist() if i % 17 else None))
    rows.append((n, "alone", 3, [0.0] * 6))
    df = spark.createDataFrame(rows, "id long, block string, day int, v array<float>")
    return df.select("*", F.concat(F.lit("t"), F.col("id") % 5).alias("town"), F.concat(F.lit("district of t"), F.col("id") % 7).alias("name"))


def both(df, k, **options):
    ids = dict(query_id="id", candidate_id="id", query_vector="v", candidate_vector="v")
    queries = df.where("id % 3 = 0")
    tile = options.pop("tile", 64)
    got, report = pruned_topk(queries, df, ["block"], k, **ids, tile=tile, **options)
    want = block_topk(queries, df, ["block"], k, **ids, **options)
    plain = lambda d: sorted((r["query_id"], r["rank"], r["candidate_id"], r["score"]) for r in d.collect())
    return plain(got), plain(want), report.first()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_same_rows_as_the_plain_search(spark, metric, spread):
    got, want, report = both(table(spark, 900, 1, spread=spread), 5, metric=metric)
    assert got == want and len(got) > 1_000
    assert report["part_pairs"] == report["first_pairs"] + report["second_pairs"] + report["skipped_pairs"]
    if spread < 1:
        assert report["skipped_share"] > 0.3


@pytest.mark.parametrize("pair", [Pair(same_id=False), Pair(not_before=("day", "day")), Pair(same_id=False, boost=("town", "name", 0.15))])
def test_rules_between_query_and_candidate(spark, pair):
    got, want, _ = both(table(spark, 600, 2), 4, pair=pair)
    assert got == want


def test_fewer_candidates_than_k_and_copies(spark):
    df = table(spark, 90, 3)
    got, want, _ = both(df, 200)
    assert got == want
    copies = spark.createDataFrame([(i, "x", 0, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0], "t", "n") for i in range(300)], df.schema).unionByName(df.withColumn("id", F.col("id") + 1_000))
    got, want, _ = both(copies, 5, tile=32)
    assert got == want


def test_one_large_block(spark):
    """All rows in one block: parts far from a query part are never multiplied."""
    df = table(spark, 6_000, 4, groups=40, spread=0.02, blocks=1)
    got, want, report = both(df, 3, tile=100)
    assert got == want and report["skipped_share"] > 0.5


def test_empty(spark):
    df = table(spark, 30, 5)
    got, _, _ = both(df.where("id < 0"), 3)
    assert got == []
