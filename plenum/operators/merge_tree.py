"""One tree of merged clusters, from which every number of clusters is read.

Complete linkage joins the two clusters whose furthest members are nearest. Its result for any
number of clusters is a cut of one tree, so the tree is built once. What it is built over is
bounded: every distinct vector is a leaf while there are at most ``leaves`` of them, beyond
that the leaves are that many clusters of bisecting k-means. Spark assigns the rows to leaves
and adds them up; the tree itself is a model of at most ``leaves`` summaries on the driver, as
the centres of k-means are.

The distance of two leaves is the largest cosine distance that members can have, from the angle
of the centres and the angles of the furthest members to them. For leaves of one vector it is
their distance, and the tree is that of complete linkage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.vectors import l2_normalise
from plenum.session import cut_lineage

#: Leaves of a tree: a distance table of 2 MB.
LEAVES = 512
NOISE = -1


def complete_linkage(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges (two places that are joined under the smaller one) with their heights, lowest first.

    Clusters that are each other's nearest are joined in rounds: under complete linkage a merge
    never brings two others closer, so the order of such merges does not change the tree. Ties go to
    the smaller place.
    """
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive, found = np.arange(len(d)), []
    while len(alive) > 1:
        table = d[np.ix_(alive, alive)]
        near = table.argmin(axis=1)
        one = np.flatnonzero((near[near] == np.arange(len(alive))) & (np.arange(len(alive)) < near))
        if not len(one):  # a ring of equal distances: the first of the smallest ones
            one = np.array([int(table.min(axis=1).argmin())])
        gone = []
        for i in one:
            a, b = sorted((int(alive[i]), int(alive[near[i]])))
            found.append((float(d[a, b]), a, b))
            gone.append(b)
            joined = np.maximum(d[a], d[b])
            joined[a] = np.inf
            d[a], d[:, a] = joined, joined
        alive = np.setdiff1d(alive, gone)
    # by height; a merge of a later round is not below those inside it, and stays behind them on ties
    order = sorted(range(len(found)), key=lambda i: (found[i][0], i))
    return np.array([found[i][1:] for i in order], int).reshape(-1, 2), np.array([found[i][0] for i in order])


@dataclass(frozen=True)
class MergeTree:
    """Leaf centres (unit vectors), the merges and their heights."""

    centres: np.ndarray
    merges: np.ndarray
    heights: np.ndarray

    def cut(self, k: int) -> np.ndarray:
        """The cluster of every leaf when ``k`` are left (all, if there are fewer leaves), numbered by their first leaf."""
        place = np.arange(len(self.centres))
        for a, b in self.merges[: max(len(place) - k, 0)]:
            place[place == b] = a
        return np.unique(place, return_inverse=True)[1]

    def table(self, spark: SparkSession) -> DataFrame:
        """(child, parent, height): leaves are numbered from 0, merges after them by height."""
        leaves, node, rows = len(self.centres), list(range(len(self.centres))), []
        for i, ((a, b), height) in enumerate(zip(self.merges.tolist(), self.heights.tolist(), strict=True)):
            rows += [(node[a], leaves + i, height), (node[b], leaves + i, height)]
            node[a] = leaves + i
        return spark.createDataFrame(rows, "child int, parent int, height double")


def _with_leaf(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Every row with its nearest leaf by cosine and that cosine; ties and zero vectors go to the first one."""
    held = df.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*df.schema, T.StructField("leaf", T.IntegerType()), T.StructField("_cosine", T.DoubleType())])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch.column(vector))
            near = unit @ held.value.T
            # equal up to rounding is equal
            leaf = (near >= near.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
            cosine = np.minimum(near[np.arange(len(leaf)), leaf], 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(cosine)], schema=pa.schema([*batch.schema, ("leaf", pa.int32()), ("_cosine", pa.float64())]))

    return df.mapInArrow(assign, schema)


def _units(column: pa.Array) -> np.ndarray:
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    size = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return matrix / np.where(size > 0, size, 1.0)


def build_tree(df: DataFrame, vector: str = "reduced", leaves: int = LEAVES, seed: int = 42, leaf: str | None = None) -> tuple[MergeTree, DataFrame]:
    """The tree over the vectors of ``df``, and its rows (those with a vector) with their ``leaf``, written once.

    With ``leaf`` the rows are in given leaves, numbered from 0.
    """
    rows = df.where(F.col(vector).isNotNull())
    if leaf is None:
        few = rows.select(F.col(vector).alias("v")).distinct().limit(leaves + 1).toArrow()["v"]
        if len(few) <= leaves:
            centres = np.unique(np.round(_units(few.combine_chunks()), 12), axis=0) if len(few) else np.zeros((0, 1))
            centres = _again_unit(centres)
        else:
            prepared = rows.select(array_to_vector(vector).alias("_v"))
            model = BisectingKMeans(k=leaves, seed=seed, distanceMeasure="cosine", featuresCol="_v").fit(prepared)
            centres = _again_unit(np.array(model.clusterCenters()))
        placed = cut_lineage(_with_leaf(rows, vector, centres)) if len(centres) else rows.withColumns({"leaf": F.lit(0), "_cosine": F.lit(1.0)})
    else:
        sums = rows.groupBy(F.col(leaf).alias("leaf")).agg(vector_to_array(Summarizer.sum(array_to_vector(l2_normalise(vector)))).alias("s")).orderBy("leaf").toArrow()
        if sums["leaf"].to_pylist() != list(range(sums.num_rows)):
            raise ValueError("given leaves are numbered from 0 without gaps")
        centres = _again_unit(np.array(sums["s"].to_pylist()))
        own = {i: c for i, c in enumerate(centres.tolist())}
        chosen = rows.join(rows.sparkSession.createDataFrame(list(own.items()), "leaf int, _centre array<double>"), rows[leaf] == F.col("leaf"))
        cosine = F.aggregate(F.zip_with(l2_normalise(vector), "_centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        placed = cut_lineage(chosen.withColumn("_cosine", F.least(cosine, F.lit(1.0))).select(*[rows[c] for c in rows.columns if c != "leaf"], "leaf", "_cosine"))
    far = dict(placed.groupBy("leaf").agg(F.min("_cosine")).collect())
    reach = np.arccos(np.clip([1.0 if far.get(i, 1.0) > 1 - 1e-12 else far[i] for i in range(len(centres))], -1, 1))
    alike = np.clip(centres @ centres.T, -1.0, 1.0)
    both = reach[:, None] + reach[None, :]
    distance = np.where(both == 0, 1 - alike, 1 - np.cos(np.minimum(np.arccos(alike) + both, np.pi)))
    return MergeTree(centres, *complete_linkage(distance)), placed.drop("_cosine")


def _again_unit(matrix: np.ndarray) -> np.ndarray:
    size = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return matrix / np.where(size > 0, size, 1.0)


def cut(placed: DataFrame, tree: MergeTree, k: int, output: str = "cluster_id") -> DataFrame:
    """The rows of ``build_tree`` with their cluster among ``k``."""
    labels = list(enumerate(tree.cut(k).tolist()))
    mapping = placed.sparkSession.createDataFrame(labels, f"leaf int, `{output}` int")
    return placed.drop(output).join(mapping, "leaf").drop("leaf")


def complete_clusters(df: DataFrame, k: int, vector: str = "reduced", output: str = "cluster_id", leaves: int = LEAVES, seed: int = 42) -> DataFrame:
    """``k`` clusters by complete linkage on cosine distances; rows without a vector get -1."""
    tree, placed = build_tree(df, vector, max(leaves, k), seed)
    rest = df.where(F.col(vector).isNull()).withColumn(output, F.lit(NOISE))
    return cut(placed, tree, k, output).unionByName(rest)


METRICS = ("n_clusters int, min_size long, max_size long, mean_size double, std_size double, wcscd double, within_distance double, silhouette double, "
           "between_distance double, between_within_ratio double, cv double, k int")


def metrics_by_k(placed: DataFrame, tree: MergeTree, ks: list[int], vector: str = "reduced", cap: float = 1000.0, epsilon: float = 1e-10) -> DataFrame:
    """One row of metrics per k, from one sum per leaf and one more pass over the rows for all silhouettes.

    The clusters of all cuts are few nodes of the tree. A row needs its dot product with the unit
    sum of each of them once; the silhouettes of every k are read off these.
    """
    spark = placed.sparkSession
    prepared = placed.select("leaf", array_to_vector(vector).alias("_v"), array_to_vector(l2_normalise(vector)).alias("_u"))
    sums = {r["leaf"]: r for r in prepared.groupBy("leaf").agg(
        F.count("*").alias("n"), vector_to_array(Summarizer.sum(F.col("_v"))).alias("v"), vector_to_array(Summarizer.sum(F.col("_u"))).alias("u")).collect()}
    leaves, width = len(tree.centres), tree.centres.shape[1]
    n = np.array([sums[i]["n"] if i in sums else 0 for i in range(leaves)], float)
    plain, unit = (np.array([sums[i][c] if i in sums else [0.0] * width for i in range(leaves)], float).reshape(leaves, width) for c in ("v", "u"))
    cuts, nodes, facts = {}, {}, {}
    for k in ks:
        label = tree.cut(k)
        member = np.eye(int(label.max(initial=-1)) + 1)[label].T if leaves else np.zeros((0, 0))
        size, s, u = member @ n, member @ plain, member @ unit
        used = size > 0
        size, s, u = size[used], s[used], u[used]
        centre = _again_unit(s)
        within = float(np.where(size > 1, size - (u * centre).sum(axis=1), 0.0).sum())
        total = centre.sum(axis=0)
        between = (len(size) ** 2 - float(total @ total)) / 2
        ratio = 0.0 if len(size) < 2 else cap if within < epsilon else between / within
        facts[k] = (len(size), int(size.min()), int(size.max()), float(size.mean()), float(size.std()), float(((size**2 - (u * u).sum(axis=1)) / 2).sum()), within, between, ratio)
        # a node is known by its leaves
        cuts[k] = [nodes.setdefault(tuple(np.flatnonzero(label == c).tolist()), len(nodes)) for c in np.flatnonzero(used)]
    keys = list(nodes)
    node_sum, node_size = np.array([unit[list(x)].sum(axis=0) for x in keys]), np.array([n[list(x)].sum() for x in keys])
    inside = np.zeros((len(keys), leaves), bool)
    for i, x in enumerate(keys):
        inside[i, list(x)] = True
    held = spark.sparkContext.broadcast((node_sum, node_size, inside, cuts))

    def silhouettes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node_sum, node_size, inside, cuts = held.value
        total = dict.fromkeys(cuts, 0.0)
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                u, leaf = _units(part.column(1)), part.column(0).to_numpy()
                near = u @ node_sum.T
                for k, chosen in cuts.items():
                    own = inside[np.ix_(chosen, leaf)].argmax(axis=0)
                    dots, size, row = near[:, chosen], node_size[chosen], np.arange(len(leaf))
                    others = 1 - dots / size
                    others[row, own] = np.inf
                    a, b = (size[own] - dots[row, own]) / np.maximum(size[own] - 1, 1), others.min(axis=1)
                    top = np.maximum(a, b)
                    good = (size[own] > 1) & np.isfinite(b) & (top != 0)
                    total[k] += float(((b - a)[good] / top[good]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], ["k", "s"])

    rows = placed.select("leaf", F.col(vector).alias("v"))
    found = dict(rows.mapInArrow(silhouettes, "k int, s double").groupBy("k").agg(F.sum("s")).collect())
    out = []
    for k, (clusters, least, most, mean, std, wcscd, within, between, ratio) in facts.items():
        out.append((clusters, least, most, mean, std, wcscd, within, found.get(k, 0.0) / float(n.sum()), between, ratio, std / mean, k))
    return spark.createDataFrame(out, METRICS)
