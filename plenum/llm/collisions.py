"""Nearest neighbours by collision counting over single projections.

Every vector is projected on ``projections`` random directions. A shard of vectors keeps one
sorted array per direction. A query opens a window around its own projection in each of them
and counts, per vector, in how many windows it lies. Virtual rehashing widens all windows from
radius to radius without building anything anew: only what a wider window adds is counted. A
vector whose count reaches the threshold is verified by its exact distance.

For a vector at distance ``r`` a projection falls within ``WINDOW * r`` of the query's with a
known probability, so its collisions at radius ``r`` are binomial; the threshold is the largest
count that such a vector misses with probability ``miss`` at most. A query is done in a shard
when the radius reaches the distance of its k-th verified vector: a nearer one left out
would have missed its threshold. Nothing else ends the search, and no cap cuts candidates.

Shards hold at most about ``tile`` vectors by a hash of id and vector, so groups stay
bounded however the vectors lie; each hands on ``k`` rows per query.

Cases: null and zero vectors, and vectors with a null or non-finite component, take no part;
vectors are compared with vectors of the same length only. Equal rows (id and vector) count once. Rows
with the query's id are its own. A null id is a candidate, last among ties, and no query. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.matching import _matrix
from plenum.operators.ranking import top_n

#: Half of a window at radius 1.
WINDOW = 1.5
#: A wider window is so many times as wide, if the k-th verified distance is not nearer.
WIDER = 1.5
#: The first radius as a share of the spread of the projections.
FIRST = 0.1


def usable(vector: Column | str) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def threshold(projections: int, miss: float) -> int:
    """Collisions that a vector at the radius itself reaches but for a chance of ``miss``."""
    p = math.erf(WINDOW / math.sqrt(2))
    chance, below = (1 - p) ** projections, 0.0
    for count in range(projections + 1):
        below += chance
        if below > miss:
            return count
        chance *= (projections - count) / (count + 1) * p / (1 - p)
    return projections


class Shard:
    """The sorted arrays of some vectors."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray) -> None:
        self.vectors, self.n = vectors, len(vectors)
        values = directions @ vectors.T
        order = np.argsort(values, axis=1)
        values = np.take_along_axis(values, order, axis=1)
        self.spread = float(values.std()) or 1.0
        # all arrays behind each other in one, so that one search finds a place in each
        self.low, self.gap = float(values.min()), float(values.max() - values.min()) * 4 + 4 * self.spread
        self.shift = np.arange(len(directions)) * self.gap
        self.values, self.ids = (values + self.shift[:, None]).ravel(), order.ravel()
        self.starts = np.arange(len(directions)) * self.n

    def places(self, at: np.ndarray, side: str) -> np.ndarray:
        inside = np.clip(at, self.low - self.spread, self.low + self.gap / 2)
        found = np.searchsorted(self.values, inside + self.shift, side)
        return np.clip(found, self.starts, self.starts + self.n)

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The vectors in the places from ``low`` to ``high`` of all arrays."""
        size = high - low
        return self.ids[np.arange(int(size.sum())) + np.repeat(low - np.cumsum(size) + size, size)]

    def nearest(self, query: np.ndarray, centre: np.ndarray, k: int, least: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified vectors with their distances; the nearest ``k`` are among them."""
        counts, open_ = np.zeros(self.n, np.int32), np.ones(self.n, bool)
        open_[own] = False
        wanted = min(k, int(open_.sum()))
        found, distances = [], np.zeros(0)
        radius, kth = FIRST * self.spread, math.inf
        low = high = self.places(centre, "left")
        while True:
            wider = self.places(centre - WINDOW * radius, "left"), self.places(centre + WINDOW * radius, "right")
            new = np.concatenate([self.between(wider[0], low), self.between(high, wider[1])])
            low, high = wider
            counts += np.bincount(new, minlength=self.n).astype(np.int32)
            reached = np.flatnonzero((counts >= least) & open_)
            if len(reached):
                open_[reached] = False
                found.append(reached)
                distances = np.concatenate([distances, _distances(self.vectors[reached], query)])
                if len(distances) >= wanted:
                    kth = float(np.partition(distances, wanted - 1)[wanted - 1])
            if len(distances) >= wanted and radius >= kth:
                break
            radius = min(radius * WIDER, max(kth, radius)) if kth < math.inf else radius * WIDER
        return np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), distances


def _distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, the components added in their order."""
    total = np.zeros(len(vectors))
    for component, x in zip(vectors.T, query, strict=True):
        total += (component - x) ** 2
    return np.sqrt(total)


def nearest(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, projections: int = 128, miss: float = 0.002,
    tile: int = 8_192, query_tile: int = 512, seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found of every row whose id ``every`` divides."""
    rows = df.where(usable(vector)).select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"), F.size(vector).alias("dims")).distinct()
    asked = F.coalesce(F.col(key) % every == 0, F.lit(False))
    # counted before equal rows are dropped, and without an index of any kind: an upper bound is enough
    counts = df.where(usable(vector)).groupBy(F.size(vector).alias("dims")).agg(
        F.ceil(F.count("*") / tile).cast("int").alias("_shards"), F.greatest(F.ceil(F.count_if(asked) / query_tile), F.lit(1)).cast("int").alias("_tiles")
    )
    placed = rows.join(counts, "dims").withColumn("_row", F.xxhash64("vec_id", "vector"))
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fresh = lambda n: F.col(n).alias(n)  # noqa: E731  both sides come from one table
    queries = placed.where(F.coalesce(F.col("vec_id") % every == 0, F.lit(False))).select(
        fresh("dims"), F.pmod("_row", "_tiles").cast("int").alias("_tile"), every_one("_shards").alias("_shard"), F.col("vec_id").alias("query_id"),
        F.col("_row").alias("_query"), fresh("vector"),
    )
    shards = placed.select(
        fresh("dims"), every_one("_tiles").alias("_tile"), F.pmod(F.xxhash64("_row"), "_shards").cast("int").alias("_shard"), fresh("vec_id"), fresh("vector")
    )
    least = threshold(projections, miss)

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "_query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vectors, wanted, ids = _matrix(c["vector"]), _matrix(q["vector"]), c["vec_id"].to_pandas().to_numpy(object)
        directions = np.random.default_rng(seed).standard_normal((projections, vectors.shape[1]))
        shard, centres = Shard(vectors, directions), wanted @ directions.T
        known = {}
        for i, x in enumerate(ids):
            known.setdefault(x, []).append(i)
        out = []
        for i, query in enumerate(q["query_id"].to_pylist()):
            at, distances = shard.nearest(wanted[i], centres[i], k, least, np.array(known.get(query, []), np.int64))
            if len(at) > k:
                near = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1])
                at, distances = at[near], distances[near]
            out.append((np.full(len(at), i), at, distances))
        who, at, distances = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": q["query_id"].take(pa.array(who)), "_query": q["_query"].take(pa.array(who)), "vec_id": c["vec_id"].take(pa.array(at)), "score": pa.array(distances)})

    cell = ["dims", "_tile", "_shard"]
    found = queries.groupBy(*cell).cogroup(shards.groupBy(*cell)).applyInArrow(search, "query_id long, _query long, vec_id long, score double")
    ranked = top_n(found, ["query_id", "_query"], [F.col("score"), F.asc_nulls_last("vec_id")], k)
    return ranked.select("query_id", "rank", "vec_id", "score")
