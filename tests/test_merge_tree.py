"""The merge tree against plain complete linkage, and its metrics against those of every grouping alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import clusters as cl
from plenum.operators import merge_tree as mt


def unit(n, size, seed):
    x = np.random.default_rng(seed).normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def greedy(distance):
    """Labels for every number of clusters and the heights, by joining the closest two clusters again and again."""
    groups, cuts, heights = [[i] for i in range(len(distance))], {}, []
    while True:
        label = np.zeros(len(distance), int)
        for g in groups:
            label[g] = min(g)
        cuts[len(groups)] = np.unique(label, return_inverse=True)[1].tolist()
        if len(groups) == 1:
            return cuts, heights
        h, a, b = min((max(distance[i, j] for i in x for j in y), p, q) for p, x in enumerate(groups) for q, y in enumerate(groups) if p < q)
        heights.append(h)
        groups[a] = groups[a] + groups.pop(b)


@pytest.mark.parametrize("n", [1, 2, 3, 25, 60])
def test_tree_is_complete_linkage(n):
    x = unit(n, 4, n)
    tree = mt.MergeTree(x, *mt.complete_linkage(1 - x @ x.T))
    cuts, heights = greedy(1 - x @ x.T)
    assert {k: tree.cut(k).tolist() for k in cuts} == cuts
    assert tree.heights.tolist() == pytest.approx(heights)


def test_ties_make_a_tree_too():
    d = 1 - np.eye(7)
    merges, heights = mt.complete_linkage(d)
    assert len(merges) == 6 and set(heights) == {1.0}
    tree = mt.MergeTree(np.eye(7), merges, heights)
    assert [len(set(tree.cut(k))) for k in range(1, 8)] == list(range(1, 8))


def test_rows_get_the_clusters_of_the_plain_tree(spark):
    x = unit(40, 5, 3)
    rows = [(i, x[i % 40].tolist() if i != 50 else None) for i in range(60)]  # copies share a leaf
    df = spark.createDataFrame(rows, "id long, reduced array<double>")
    got = {r["id"]: r["cluster_id"] for r in mt.complete_clusters(df, 6).collect()}
    cuts, _ = greedy(1 - x @ x.T)
    assert len(got) == 60 and got[50] == -1
    want = {i: cuts[6][i % 40] for i in range(60) if i != 50}
    assert len(set(want.values())) == 6
    assert len({(want[i], got[i]) for i in want}) == 6 and all(got[i] == got[i + 40] for i in range(20) if i != 10)


def test_more_rows_than_leaves(spark):
    x = unit(12, 16, 5)[np.arange(300) % 12] + np.random.default_rng(1).normal(size=(300, 16)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, reduced array<double>")
    tree, placed = mt.build_tree(df, leaves=24)
    assert len(tree.centres) <= 24 and placed.count() == 300
    got = {r["id"]: r["cluster_id"] for r in mt.cut(placed, tree, 12).collect()}
    assert len({(i % 12, c) for i, c in got.items()}) == 12


@pytest.mark.parametrize("leaves", [512, 20])
def test_metrics_are_those_of_every_cut_alone(spark, leaves):
    x = unit(90, 6, 8) + 3 * np.eye(6)[np.arange(90) % 5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, reduced array<double>").repartition(3)
    tree, placed = mt.build_tree(df, leaves=leaves)
    for r in mt.metrics_by_k(placed, tree, [1, 2, 5, 19, 20]).collect():
        alone = cl.grouping_metrics(mt.cut(placed, tree, r["k"]), vector="reduced").first().asDict()
        for name, value in alone.items():
            assert r[name] == pytest.approx(value, abs=1e-8), (r["k"], name)


def test_tree_table_and_given_leaves(spark):
    x = unit(30, 4, 2)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, g int, reduced array<double>")
    tree, placed = mt.build_tree(df, leaf="g")
    assert {r["id"]: r["leaf"] for r in placed.collect()} == {i: i % 3 for i in range(30)}
    rows = tree.table(spark).collect()
    assert sorted(r["child"] for r in rows) == [0, 1, 2, 3] and {r["parent"] for r in rows} == {3, 4}
    with pytest.raises(ValueError):
        mt.build_tree(df.withColumn("g", F.col("g") + 1), leaf="g")


def test_choice_and_labels_come_from_one_tree(spark):
    x = np.eye(8)[np.arange(120) % 8] + unit(120, 8, 4) * 0.05
    df = spark.createDataFrame([(i, v.tolist() if i else None) for i, v in enumerate(x)], "id long, reduced array<double>")
    labelled, k, alternatives = cl.choose_clusters(df)
    got = {r["id"]: r["cluster_id"] for r in labelled.collect()}
    assert k == 8 and len(alternatives) <= 5 and got[0] == -1
    assert len({(i % 8, c) for i, c in got.items() if i}) == 8
    assert cl.choose_k(df)[0] == 8
    assert {r["cluster_id"] for r in cl.choose_clusters(df, k=3)[0].collect()} == {-1, 0, 1, 2}


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, reduced array<double>")
    assert {r["id"]: r["cluster_id"] for r in cl.choose_clusters(df)[0].collect()} == {1: 0, 2: -1}
    assert cl.choose_clusters(df.limit(0))[0].collect() == []
