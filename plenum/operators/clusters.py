"""Reduction, clustering, cluster metrics and the choice of the number of clusters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import fixed
from plenum.functions.text import let
from plenum.functions.vectors import dot, l2_normalise
from plenum.operators.graph import connected_components
from plenum.operators.matching import _matrix, _unit
from plenum.operators.merge_tree import NOISE, build_tree, complete_clusters, cut, metrics_by_k
from plenum.operators.ranking import attach_row
from plenum.operators.text_vectors import text_vectors
from plenum.session import cut_lineage


def attach_vectors(df: DataFrame, text: str, embedder=None, vectors: DataFrame | None = None, output: str = "embedding") -> DataFrame:
    """Give every row the vector of its text; each distinct text is embedded once.

    ``embedder`` is a ``mapInPandas`` function from (text) batches to (text, vector) batches, or
    ``vectors`` has (text, vector); without both, the vectors are those of ``text_vectors``.
    Blank texts carry null.
    """
    texts = df.select(F.col(text).alias("text")).where(F.trim("text") != "").distinct()
    if embedder is not None:
        vectors = texts.mapInPandas(embedder, "text string, vector array<float>")
    elif vectors is None:
        vectors = text_vectors(texts)
    known = vectors.select(F.col("text").alias(text), F.col("vector").alias(output))
    return df.join(known, text, "left")


def reduce_pca(df: DataFrame, vector: str = "embedding", dims: int = 50, output: str = "reduced") -> tuple[DataFrame, float]:
    """Centred principal components, and the share of variance they keep.

    ``dims`` is capped one below the smaller of rows and dimensions. Spark's PCA does not
    centre what it projects, so rows are centred first.
    """
    rows = df.where(F.col(vector).isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    most = min(size["n"], size["d"])
    dims = dims if dims <= most else most - 1
    prepared = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(vector))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(prepared).transform(prepared)
    model = PCA(k=dims, inputCol="_c", outputCol="_p").fit(centred)
    out = model.transform(centred).withColumn(output, vector_to_array("_p")).drop("_v", "_c", "_p")
    return out, float(sum(model.explainedVariance))


def cluster_k(df: DataFrame, k: int, vector: str = "reduced", method: str = "complete", seed: int = 42, output: str = "cluster_id") -> DataFrame:
    """Cosine clusters by complete linkage, or by ``bisecting`` or plain ``kmeans``; rows without a vector get -1."""
    if method == "complete":
        return complete_clusters(df, k, vector, output, seed=seed)
    rows = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(vector))
    maker = BisectingKMeans if method == "bisecting" else KMeans
    model = maker(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol=output).fit(rows)
    labelled = model.transform(rows).drop("_v")
    rest = df.where(F.col(vector).isNull()).withColumn(output, F.lit(NOISE))
    return labelled.unionByName(rest)


def _sums(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Rows, vector sum and unit-vector sum per cluster, combined on the map side."""
    prepared = df.where(F.col(vector).isNotNull()).select(
        cluster, array_to_vector(vector).alias("_v"), array_to_vector(l2_normalise(vector)).alias("_u")
    )
    return prepared.groupBy(cluster).agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.sum(F.col("_v"))).alias("vector_sum"),
        vector_to_array(Summarizer.sum(F.col("_u"))).alias("unit_sum"),
    )


def within_cluster_distance(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """Sum of pairwise cosine distances per cluster in closed form: (n^2 - |sum|^2) / 2.

    On unit vectors the pair sum needs only the vector sum, so no pair is formed.
    """
    s = _sums(df, cluster, vector)
    n = F.col("n").cast("double")
    return s.select(cluster, "n", ((n * n - dot("unit_sum", "unit_sum")) / 2).alias("wcscd"))


def centroids(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding", normalised: bool = True) -> DataFrame:
    s = _sums(df, cluster, vector)
    mean = F.transform("vector_sum", lambda x: x / F.col("n"))
    s = s.select(cluster, "n", mean.alias("centroid"))
    return s.withColumn("centroid", l2_normalise("centroid")) if normalised else s


def between_within_ratio(
    df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding", cap: float = 1000.0, epsilon: float = 1e-10
) -> DataFrame:
    """Pairwise centroid distances over point to centroid distances, one row.

    The point part is closed too: the cosine of unit points with a unit centroid sums to the
    dot product of their sum with it. So one aggregate over the points serves all of it.
    """
    s = _sums(df, cluster, vector).withColumn("_centre", l2_normalise("vector_sum"))
    inner = F.when(F.col("n") > 1, F.col("n") - dot("unit_sum", "_centre")).otherwise(F.lit(0.0))
    per_cluster = s.select(inner.alias("_inner"), array_to_vector("_centre").alias("_c"))
    one = per_cluster.agg(
        F.count("*").cast("double").alias("k"), F.sum("_inner").alias("within_distance"),
        vector_to_array(Summarizer.sum(F.col("_c"))).alias("_all"),
    )
    between = (F.col("k") * F.col("k") - dot("_all", "_all")) / 2
    ratio = F.when(F.col("k") < 2, 0.0).when(F.col("within_distance") < epsilon, cap).otherwise(
        F.col("between_distance") / F.col("within_distance")
    )
    return (
        one.withColumn("between_distance", between)
        .select("between_distance", "within_distance", ratio.alias("between_within_ratio"))
    )


def silhouette(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> float:
    """Mean cosine silhouette from cluster sums (Spark's evaluator); no pairwise join."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(cluster).cast("double").alias("prediction"), array_to_vector(vector).alias("features"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="cosine").evaluate(rows)


def silhouette_rows(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """Silhouette as one row, by the same closed form as an expression."""
    return grouping_metrics(df, cluster, vector).select("silhouette")


def grouping_metrics(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding", cap: float = 1000.0, epsilon: float = 1e-10) -> DataFrame:
    """All metrics of one grouping as one row, from two passes over the points.

    The first pass adds up each cluster; sizes, distances inside and between clusters follow
    from those k sums. The second pass is the silhouette: the mean distance of a point to a
    cluster is 1 minus its dot product with the cluster's unit sum over its size, so every
    point reads one array of k sums and no other point.
    """
    s = _sums(df, cluster, vector).withColumn("_centre", l2_normalise("vector_sum"))
    n = F.col("n").cast("double")
    inner = F.when(F.col("n") > 1, n - dot("unit_sum", "_centre")).otherwise(F.lit(0.0))
    facts = s.agg(
        F.count("*").alias("n_clusters"), F.min("n").alias("min_size"), F.max("n").alias("max_size"),
        F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"),
        F.sum((n * n - dot("unit_sum", "unit_sum")) / 2).alias("wcscd"), F.sum(inner).alias("within_distance"),
        vector_to_array(Summarizer.sum(array_to_vector("_centre"))).alias("_all"),
        # k entries
        F.collect_list(F.struct(F.col(cluster).alias("k"), "n", F.col("unit_sum").alias("s"))).alias("_clusters"),
    )
    points = attach_row(
        df.where(F.col(vector).isNotNull()).select(F.col(cluster).alias("_k"), l2_normalise(vector).alias("_u")), facts
    )
    # one dot product per cluster; everything after works on k numbers
    near = F.transform(
        "_clusters", lambda c: F.struct((c["k"] == F.col("_k")).alias("own"), c["n"].alias("n"), dot("_u", c["s"]).alias("d"))
    )

    def distances(c: Column) -> Column:
        own = F.get(F.filter(c, lambda x: x["own"]), F.lit(0))
        others = F.transform(F.filter(c, lambda x: ~x["own"]), lambda x: 1 - x["d"] / x["n"])
        inside = (own["n"] - own["d"]) / F.greatest(own["n"] - 1, F.lit(1))
        return F.struct(own["n"].alias("n"), inside.alias("a"), F.array_min(others).alias("b"))

    points = points.select("*", F.inline(F.array(let(near, distances))))
    value = F.when(F.col("n") == 1, 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    names = [c for c in facts.columns if c != "_clusters"]
    one = points.agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("silhouette"), *[F.first(c).alias(c) for c in names])
    k = F.col("n_clusters").cast("double")
    ratio = F.when(k < 2, 0.0).when(F.col("within_distance") < epsilon, cap).otherwise(F.col("between_distance") / F.col("within_distance"))
    return (
        one.withColumn("between_distance", (k * k - dot("_all", "_all")) / 2)
        .withColumn("between_within_ratio", ratio)
        .withColumn("cv", F.try_divide("std_size", "mean_size"))
        .drop("_all")
    )


def cluster_sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Smallest, largest and mean size, population deviation and variation, one row."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_clusters"), F.min("n").alias("min_size"), F.max("n").alias("max_size"),
        F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"),
        F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("cv"),
    )


@dataclass(frozen=True)
class KRange:
    """Which k to try, and what a k must reach."""

    min_k: int
    max_k: int
    max_cv: float
    min_silhouette: float
    min_ratio: float
    fallback: int
    settled: int | None = None


def k_range(n: int, min_k: int = 5, max_k: int = 50, max_cv: float = 1.0) -> KRange:
    """Range and constraints by data size; up to three rows settle k without a search."""
    fallback = min(15, max(5, n // 10))
    if n <= 3:
        return KRange(1, 1, max_cv, 0.0, 0.0, fallback, settled=min(n, 2) or 1)
    if n < 15:
        return KRange(2, min(n - 1, 8), 2.0, 0.05, 0.05, fallback)
    if n < 50:
        return KRange(3, min(n // 2, 15), 1.5, 0.2, 0.3, fallback)
    return KRange(min_k, max_k, max_cv, 0.3, 0.5, fallback)


def k_metrics(df: DataFrame, ks: list[int], vector: str = "reduced", seed: int = 42) -> DataFrame:
    """One row of metrics per k, all from one merge tree."""
    tree, placed = build_tree(df.select(vector), vector, seed=seed)
    return metrics_by_k(placed, tree, ks, vector)


def _ladder(value: Column, steps: list[tuple[float, int]], floor: int, falling: bool = False) -> Column:
    result = F.lit(floor)
    for bound, points in reversed(steps):
        result = F.when(value < bound if falling else value >= bound, points).otherwise(result)
    return result


def score_k(metrics: DataFrame, n: int | Column, limits: KRange | None = None) -> DataFrame:
    """Separation (50), cohesion (30) and balance (20) points; rows under the limits are left out.

    Best first, the smaller k on equal scores.
    """
    if limits is not None:
        metrics = metrics.where(
            (F.col("silhouette") >= limits.min_silhouette)
            & (F.col("between_within_ratio") >= limits.min_ratio)
            & (F.col("cv") <= limits.max_cv)
        )
    total = n if isinstance(n, Column) else F.lit(n)
    share = F.col("max_size") / total * 100
    separation = _ladder(F.col("between_within_ratio"), fixed.SEPARATION_POINTS, 0)
    cohesion = _ladder(F.col("silhouette"), fixed.COHESION_POINTS, fixed.COHESION_FLOOR)
    balance = _ladder(F.col("cv"), fixed.CV_POINTS, 0, falling=True) + _ladder(share, fixed.LARGEST_SHARE_POINTS, 0, falling=True)
    scored = metrics.withColumns({"separation": separation, "cohesion": cohesion, "balance": balance})
    return scored.withColumn("score", F.col("separation") + F.col("cohesion") + F.col("balance")).orderBy(F.desc("score"), "k")


def choose_k(df: DataFrame, vector: str = "reduced", seed: int = 42, **limits) -> tuple[int, list]:
    """The k with the best score and up to five alternatives; falls back by data size."""
    n = df.where(F.col(vector).isNotNull()).count()
    span = k_range(n, **limits)
    if span.settled is not None:
        return span.settled, []
    ks = [k for k in range(span.min_k, span.max_k + 1) if k < n]
    best = score_k(k_metrics(df, ks, vector, seed), n, span).limit(6).collect()
    return (best[0]["k"], best[1:]) if best else (span.fallback, [])


def choose_clusters(df: DataFrame, vector: str = "reduced", k: int | None = None, seed: int = 42, output: str = "cluster_id", **limits) -> tuple[DataFrame, int, list]:
    """Rows in the best number of clusters (or ``k``), that number and its alternatives; one tree serves choice and labels.

    Rows without a vector get -1.
    """
    tree, placed = build_tree(df, vector, seed=seed)
    alternatives = []
    if k is None:
        n = placed.count()
        span = k_range(n, **limits)
        k = span.settled
        if k is None:
            ks = [x for x in range(span.min_k, span.max_k + 1) if x < n]
            best = score_k(metrics_by_k(placed, tree, ks, vector), n, span).limit(6).collect()
            k, alternatives = (best[0]["k"], best[1:]) if best else (span.fallback, [])
    rest = df.where(F.col(vector).isNull()).withColumn(output, F.lit(NOISE))
    return cut(placed, tree, k, output).unionByName(rest), k, alternatives


def similar_pairs(centres: DataFrame, threshold: float = 0.92, cluster: str = "cluster_id") -> DataFrame:
    """Pairs of clusters whose unit centroids are at least ``threshold`` alike.

    Pairs are found tile by tile by the same matrix product as the vector search; a pair
    leaves the tile only if it is similar. For merging take ``similar_forest``: a dense set of
    clusters has a pair for nearly every two.
    """
    pairs = threshold_pairs(centres.withColumn("_all", F.lit(0)), ["_all"], cluster, "centroid", threshold)
    return pairs.drop("_all")


def similar_forest(centres: DataFrame, threshold: float = 0.92, cluster: str = "cluster_id") -> DataFrame:
    """Edges (a, b) that connect what the similar pairs connect: less than one per row and tile."""
    edges = threshold_pairs(centres.withColumn("_all", F.lit(0)), ["_all"], cluster, "centroid", threshold, forest=True)
    return edges.select("a", "b")


def _stars(rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Every component of a tile as a star: its other members, and its smallest once for each."""
    row_seen, column_seen = np.zeros(len(rows), bool), np.zeros(len(columns), bool)
    one_side = len(rows) == len(columns) and bool((rows == columns).all())
    a, b = [], []
    for start in range(len(rows)):
        if row_seen[start] or not linked[start].any():
            continue
        frontier, members = np.array([start]), [rows[start: start + 1]]
        row_seen[start] = True
        while len(frontier):
            reached = np.flatnonzero(linked[frontier].any(axis=0) & ~column_seen)
            column_seen[reached] = True
            # on the diagonal a node is a row and a column at once
            frontier = reached[~row_seen[reached]] if one_side else np.flatnonzero(linked[:, reached].any(axis=1) & ~row_seen)
            row_seen[frontier] = True
            members += [columns[reached], rows[frontier]]
        component = np.unique(np.concatenate(members))
        a.append(component[1:])
        b.append(np.full(len(component) - 1, component[0]))
    return a, b


def _near(left: np.ndarray, right: np.ndarray, threshold: float, rows: int = 256) -> np.ndarray:
    """Which unit rows are at least ``threshold`` alike; a byte per pair, the scores themselves only a few rows at a time."""
    out = np.empty((len(left), len(right)), bool)
    for start in range(0, len(left), rows):
        out[start: start + rows] = np.round(left[start: start + rows] @ right.T, 9) >= threshold
    return out


def threshold_pairs(df: DataFrame, on: list[str], key: str, vector: str, threshold: float, tile: int = 4_096, forest: bool = False) -> DataFrame:
    """All pairs (a < b) of a block with cosine at least ``threshold``, or a forest that connects them.

    The block is cut into tiles and every unordered tile pair is one group.
    """
    rows = df.where(F.col(vector).isNotNull()).select(*on, F.col(key).alias("id"), F.col(vector).alias("vector"))
    # rows without a vector are counted too: then this scan need not read the vectors
    counts = df.groupBy(*on).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    placed = rows.join(counts, on).withColumn("_t", F.pmod(F.xxhash64("id"), "_tiles").cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("_tiles") - 1),
        lambda o: F.struct(F.least(o, F.col("_t")).alias("i"), F.greatest(o, F.col("_t")).alias("j")),
    )
    cells = placed.select(*on, "id", "vector", "_t", F.explode(others).alias("_cell")).select(
        *on, "id", "vector", "_t", F.col("_cell.i").alias("_i"), F.col("_cell.j").alias("_j")
    )
    kind = rows.schema["id"].dataType
    schema = T.StructType([rows.schema[c] for c in on] + [T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        unit, tiles = _unit(_matrix(group["vector"])), group["_t"].to_numpy()
        i, j = group["_i"][0].as_py(), group["_j"][0].as_py()
        left, right = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
        if forest:
            near = _near(unit[left], unit[right], threshold)
            if i == j:
                np.fill_diagonal(near, False)
            others, firsts = (np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64) for part in _stars(left, right, near))
            columns = {c: group[c].take(pa.array(firsts)) for c in on}
            return pa.table({**columns, "a": group["id"].take(pa.array(firsts)), "b": group["id"].take(pa.array(others)),
                             "similarity": pa.nulls(len(firsts), pa.float64())})
        alike = unit[left] @ unit[right].T
        np.round(alike, 9, out=alike)
        x, y = np.nonzero(alike >= threshold)
        a, b = left[x], right[y]
        # the diagonal cell sees each pair twice, the others once in either order
        keep = a < b if i == j else np.ones(len(a), dtype=bool)
        low, high = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        columns = {c: group[c].take(pa.array(low)) for c in on}
        return pa.table({**columns, "a": group["id"].take(pa.array(low)), "b": group["id"].take(pa.array(high)),
                         "similarity": pa.array(alike[x, y][keep])})

    return cells.groupBy(*on, "_i", "_j").applyInArrow(search, schema)


def merge_map(pairs: DataFrame, sizes: DataFrame, cluster: str = "cluster_id", size: str = "n") -> DataFrame:
    """Every member of a group of similar clusters to its largest one (smaller id on ties)."""
    groups = connected_components(pairs, "a", "b")
    sized = groups.join(sizes.select(F.col(cluster).alias("node"), F.col(size).alias("_size")), "node")
    target = sized.groupBy("component").agg(F.max_by("node", F.struct("_size", (-F.col("node")).alias("o"))).alias("target"))
    return sized.join(target, "component").select(F.col("node").alias(cluster), "target")


def apply_merges(df: DataFrame, mapping: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """New cluster ids beside the original one and the merged group.

    The mapping has a row per merged cluster; whether it is broadcast is Spark's size check.
    """
    groups = mapping.groupBy("target").agg(F.sort_array(F.collect_set(cluster)).alias("merge_source_clusters"))
    full = mapping.join(groups, "target").withColumnRenamed(cluster, "original_cluster_id")
    out = df.withColumnRenamed(cluster, "original_cluster_id").join(full, "original_cluster_id", "left")
    moved = F.col("target").isNotNull() & (F.col("target") != F.col("original_cluster_id"))
    return (
        out.withColumn(cluster, F.coalesce("target", "original_cluster_id"))
        .withColumn("merged_cluster_id", F.when(moved, F.col("target")))
        .withColumn("merge_source_clusters", F.when(moved, F.col("merge_source_clusters")))
        .drop("target")
    )


def merge_report(merged: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters before and after, reduction and merge groups, one row."""
    per_target = merged.groupBy(cluster).agg(F.countDistinct("original_cluster_id").alias("_sources"), F.count("*").alias("_n"))
    return per_target.agg(
        F.sum("_sources").alias("original_clusters"), F.count("*").alias("final_clusters"),
        F.count_if(F.col("_sources") > 1).alias("merge_groups"),
        F.max(F.when(F.col("_sources") > 1, F.col("_sources"))).alias("largest_merge"),
        F.avg(F.when(F.col("_sources") > 1, F.col("_sources"))).alias("average_merge"),
        F.avg("_n").alias("average_cluster_size"),
    ).withColumn(
        "reduction_pct",
        F.coalesce(F.try_divide((F.col("original_clusters") - F.col("final_clusters")) * 100.0, "original_clusters"), F.lit(0.0)),
    )


def merge_size_histogram(merged: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    per_target = merged.groupBy(cluster).agg(F.countDistinct("original_cluster_id").alias("clusters_merged"))
    return per_target.where("clusters_merged > 1").groupBy("clusters_merged").agg(F.count("*").alias("occurrences"))


def density_clusters(
    df: DataFrame, on: list[str], key: str, vector: str, threshold: float, min_size: int = 3, min_neighbours: int = 2,
    tile: int = 4_096,
) -> DataFrame:
    """Density clusters inside a category; noise is -1.

    A row with ``min_neighbours`` similar rows is core; cores in reach of each other share a
    cluster, other rows join the smallest core they reach. Tiles first add up neighbour counts
    and then hand on a spanning forest instead of all similar pairs, so a dense category
    moves rows times tiles, not rows squared. Clusters under ``min_size`` become noise.
    """
    rows = df.where(F.col(vector).isNotNull()).select(*on, F.col(key).alias("id"), F.col(vector).alias("vector"))
    # rows without a vector are counted too: then this scan need not read the vectors
    counts = df.groupBy(*on).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    placed = rows.join(counts, on).withColumn("_t", F.pmod(F.xxhash64("id"), "_tiles").cast("int"))
    id_type = rows.schema["id"].dataType

    def cells(source: DataFrame, *extra: str) -> DataFrame:
        others = F.transform(
            F.sequence(F.lit(0), F.col("_tiles") - 1),
            lambda o: F.struct(F.least(o, F.col("_t")).alias("i"), F.greatest(o, F.col("_t")).alias("j")),
        )
        return source.select(*on, "id", "vector", "_t", *extra, F.explode(others).alias("_cell")).select(
            *on, "id", "vector", "_t", *extra, F.col("_cell.i").alias("_i"), F.col("_cell.j").alias("_j")
        )

    def adjacency(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        unit, tiles = _unit(_matrix(group["vector"])), group["_t"].to_numpy()
        i, j = group["_i"][0].as_py(), group["_j"][0].as_py()
        left, right = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
        near = _near(unit[left], unit[right], threshold)
        if i == j:
            np.fill_diagonal(near, False)
        return left, right, near, np.array([i == j])

    degree_schema = T.StructType([T.StructField("id", id_type), T.StructField("degree", T.LongType())])

    def count_near(group: pa.Table) -> pa.Table:
        left, right, near, same = adjacency(group)
        total = np.zeros(group.num_rows, dtype=np.int64)
        total[left] += near.sum(axis=1)
        if not same[0]:
            total[right] += near.sum(axis=0)
        return pa.table({"id": group["id"], "degree": pa.array(total)})

    degrees = (
        cells(placed).groupBy(*on, "_i", "_j").applyInArrow(count_near, degree_schema)
        .groupBy("id").agg((F.sum("degree") >= min_neighbours).alias("core"))
    )
    marked = cut_lineage(placed.join(degrees, "id"))
    edge_schema = T.StructType(
        [T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("both_core", T.BooleanType())]
    )

    def forest(group: pa.Table) -> pa.Table:
        """A star per component of the tile's cores, and the smallest core each border row reaches."""
        group = group.sort_by("id")
        left, right, near, same = adjacency(group)
        core = group["core"].to_numpy(zero_copy_only=False).astype(bool)
        rows, columns = left[core[left]], right[core[right]]
        a, b = _stars(rows, columns, near[np.ix_(core[left], core[right])])
        both = sum(len(x) for x in a)
        sides = [(left, right, near)] if same[0] else [(left, right, near), (right, left, near.T)]
        for outer, inner, table in sides:
            inner_core = inner[core[inner]]
            reach = table[np.ix_(~core[outer], core[inner])]
            border = reach.any(axis=1)
            a.append(outer[~core[outer]][border])
            b.append(inner_core[reach.argmax(axis=1)[border]] if border.any() else np.array([], dtype=np.int64))
        a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        kinds = np.arange(len(a)) < both
        return pa.table({"a": group["id"].take(pa.array(a)), "b": group["id"].take(pa.array(b)), "both_core": pa.array(kinds)})

    edges = cut_lineage(cells(marked, "core").groupBy(*on, "_i", "_j").applyInArrow(forest, edge_schema))
    components = connected_components(edges.where("both_core").select("a", "b"))
    cores = marked.where("core").select("id").join(
        components.select(F.col("node").alias("id"), "component"), "id", "left"
    ).withColumn("component", F.coalesce("component", "id"))
    borders = (
        edges.where("not both_core").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_core"))
        .join(cores.select(F.col("id").alias("_core"), "component"), "_core").select("id", "component")
    )
    labels = cores.unionByName(borders)
    sizes = labels.groupBy("component").agg(F.count("*").alias("_size"))
    kept = labels.join(sizes.where(F.col("_size") >= min_size), "component").select(F.col("id").alias(key), "component")
    return df.join(kept, key, "left").withColumn("cluster_id", F.coalesce("component", F.lit(NOISE).cast(id_type))).drop("component")
