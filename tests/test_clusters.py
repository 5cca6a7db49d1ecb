import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import clusters as cl
from plenum.operators.graph import connected_components

SCHEMA = "id bigint, cluster_id int, embedding array<float>"


def points(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_orthogonal_clusters_hit_the_cap(spark):
    df = points(spark, [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [0.0, 1.0]), (4, 1, [0.0, 1.0])])
    m = cl.grouping_metrics(df).first()
    assert m.between_within_ratio == 1000.0 and m.cv == 0.0 and m.silhouette == pytest.approx(1.0)
    assert cl.between_within_ratio(df).first().between_within_ratio == 1000.0
    assert cl.silhouette(df) == pytest.approx(1.0)


def test_closed_forms_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(size=5) + (i % 3)]) for i in range(40)]
    u = np.array([r[2] for r in rows], dtype="float32").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    labels = np.array([r[1] for r in rows])
    wcscd = sum(1 - u[i] @ u[j] for i in range(40) for j in range(i + 1, 40) if labels[i] == labels[j])
    m = cl.grouping_metrics(points(spark, rows)).first()
    assert m.wcscd == pytest.approx(wcscd)
    assert m.silhouette == pytest.approx(cl.silhouette(points(spark, rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 20)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in root}


def density_brute(rows, threshold, min_size, need):
    u = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    near = {i: [j for j in u if j != i and round(float(u[i] @ u[j]), 9) >= threshold] for i in u}
    core = {i for i in near if len(near[i]) >= need}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        stack, label[i] = [i], i
        while stack:
            for y in near[stack.pop()]:
                if y in core and y not in label:
                    label[y] = i
                    stack.append(y)
    for i in near:
        reach = [j for j in near[i] if j in core]
        if i not in core and reach:
            label[i] = label[min(reach)]
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    return {i: label[i] if i in label and sizes[label[i]] >= min_size else -1 for i in near}


@pytest.mark.parametrize("tile", [4, 11, 1000])
def test_density_clusters_for_any_tiling(spark, tile):
    rng = np.random.default_rng(4)
    rows = [(i, 0, [float(x) for x in rng.normal(size=3)]) for i in range(70)]
    rows = [(i, c, [float(np.float32(x)) for x in v]) for i, c, v in rows]
    df = spark.createDataFrame(rows, "id bigint, category int, v array<float>")
    got = cl.density_clusters(df, ["category"], "id", "v", 0.97, min_size=3, min_neighbours=2, tile=tile)
    assert {r.id: r.cluster_id for r in got.collect()} == density_brute(rows, 0.97, 3, 2)


def test_similar_pairs_for_any_tiling(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").withColumn("block", F.lit(1))
    u = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    expected = {(i, j) for i in u for j in u if i < j and u[i] @ u[j] >= 0.8}
    for tile in (7, 1000):
        got = cl.threshold_pairs(df, ["block"], "id", "v", 0.8, tile=tile).collect()
        assert len(got) == len(expected) and {(r.a, r.b) for r in got} == expected


@pytest.mark.parametrize("tile", [3, 7, 100])
def test_forest_connects_what_the_pairs_connect(spark, tile):
    rng = np.random.default_rng(8)
    rows = [("x", i, rng.normal(size=4).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "block string, id int, v array<double>")
    pairs = cl.threshold_pairs(df, ["block"], "id", "v", 0.8, tile=tile)
    forest = cl.threshold_pairs(df, ["block"], "id", "v", 0.8, tile=tile, forest=True)
    label = lambda edges: {(r.node, r.component) for r in cl.connected_components(edges.select("a", "b")).collect()}
    assert label(forest) == label(pairs) and forest.count() <= pairs.count()
    if tile == 100:
        assert forest.count() < 40


def test_merging_goes_to_the_largest_cluster(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    sizes = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1)], "cluster_id int, n int")
    mapping = cl.merge_map(pairs, sizes)
    assert {(r.cluster_id, r.target) for r in mapping.collect()} == {(1, 2), (2, 2), (3, 2)}
    df = spark.createDataFrame([(10, 1), (11, 2), (12, 4)], "id int, cluster_id int")
    got = {r.id: (r.cluster_id, r.original_cluster_id, r.merged_cluster_id, r.merge_source_clusters) for r in cl.apply_merges(df, mapping).collect()}
    assert got == {10: (2, 1, 2, [1, 2, 3]), 11: (2, 2, None, None), 12: (4, 4, None, None)}


@pytest.mark.parametrize("n, expected", [(1, (1,)), (3, (2,)), (10, (2, 8)), (14, (2, 8)), (40, (3, 15)), (200, (5, 50))])
def test_k_range(n, expected):
    r = cl.k_range(n)
    assert ((r.settled,) if r.settled else (r.min_k, r.max_k)) == expected


def test_clusters_keep_every_row_and_are_reproducible(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 0, [float(x) for x in rng.normal(size=6) + 4 * (i % 3)] if i % 10 else None) for i in range(60)]
    df = points(spark, rows).drop("cluster_id")
    reduced, kept = cl.reduce_pca(df.where("embedding is not null"), dims=3)
    assert 0 < kept <= 1.0 + 1e-9
    means = [abs(reduced.agg(F.avg(F.get("reduced", F.lit(i)))).first()[0]) for i in range(3)]
    assert max(means) < 1e-6
    a = {r.id: r.cluster_id for r in cl.cluster_k(df, 3, "embedding").collect()}
    b = {r.id: r.cluster_id for r in cl.cluster_k(df.repartition(3), 3, "embedding").collect()}
    assert len(a) == 60 and all((a[i] == -1) == (i % 10 == 0) for i in a) and sorted(map(list, [a.values()]))[0] is not None
    assert sorted(np.bincount([v + 1 for v in a.values()])) == sorted(np.bincount([v + 1 for v in b.values()]))


def test_best_k_and_ties(spark):
    rows = [(5, 12.0, 0.72, 0.4, 10, 100), (6, 12.0, 0.72, 0.4, 10, 100), (7, 1.2, 0.35, 0.9, 60, 100), (8, 0.1, 0.9, 0.1, 10, 100)]
    m = spark.createDataFrame(rows, "k int, between_within_ratio double, silhouette double, cv double, max_size int, total int")
    out = cl.score_k(m, 100, cl.k_range(100)).collect()
    assert [(r.k, r.score) for r in out] == [(5, 82), (6, 82), (7, 13)]


@pytest.mark.parametrize("good", [range(28, 41), ()])
def test_choose_k_tries_the_whole_range(spark, monkeypatch, tmp_path, good):
    """The query takes the best k wherever it lies, with five alternatives; without a k in the limits, the fallback alone."""
    from plenum.catalog.cluster_queries import QUERIES

    rng = np.random.default_rng(3)
    rows = [(i, i % 4, [float(x) for x in rng.normal(size=20)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    tried = []

    def metrics(df, ks, vector="reduced", seed=42):
        tried.append(list(ks))
        return spark.createDataFrame([(k, 60.0 - k, 0.5 if k in good else 0.1, 0.4, 10) for k in ks], "k int, between_within_ratio double, silhouette double, cv double, max_size int")

    monkeypatch.setattr(cl, "k_metrics", metrics)
    out = [(r["rank"], r["k"]) for r in QUERIES["choose_k"][0](spark, str(tmp_path)).collect()]
    assert tried[0] == list(range(5, 51))
    assert out == ([(i + 1, 28 + i) for i in range(6)] if good else [(1, 6)])


def test_k_metrics_has_one_row_per_k(spark):
    rng = np.random.default_rng(4)
    df = points(spark, [(i, 0, [float(x) for x in rng.normal(size=6) + 5 * np.eye(6)[i % 4]]) for i in range(40)])
    found = {r["k"]: r for r in cl.k_metrics(df, [2, 4, 5], "embedding").collect()}
    for k in (2, 4, 5):
        alone = cl.grouping_metrics(cl.cluster_k(df.select("embedding"), k, "embedding"), vector="embedding").first()
        assert found[k]["n_clusters"] == k and found[k]["silhouette"] == pytest.approx(alone["silhouette"])


def test_discovery_labels_every_message_once(spark):
    from plenum.plans.theme_discovery import discover

    rng = np.random.default_rng(9)
    rows = [(i, i % 9 == 0, [float(x) for x in rng.normal(size=8) + 6 * np.eye(8)[i % 3]]) for i in range(90)]
    df = spark.createDataFrame(rows, "atomic_id bigint, is_opt_out boolean, embedding array<float>")
    out = discover(df, dims=4, k=3, merge_at=0.999).collect()
    assert len(out) == 90 and all((r.cluster_id == -1) == r.is_opt_out for r in out)
    assert len({r.cluster_id for r in out} - {-1}) == 3


def test_a_tile_of_neighbours_takes_a_byte_a_pair():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1_500, 8))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    want = np.round(v @ v.T, 9) >= 0.5
    tracemalloc.start()
    got = cl._near(v, v, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 5 * got.size, peak
