"""Hard negatives from an inverted multi-index.

Vectors of integers are cut into two halves with a codebook each; a pair of codewords names a
cell. The inner product of an anchor with any vector of a cell is at most the sum of two half
scores: the product with the codeword plus the length of the anchor's half times the radius
of the codeword, the largest distance of a vector here from it. A heap visits the cells of a
shard in the order of that bound (multi-sequence): the first halves and the second halves are
sorted by bound, and a cell is pushed when the one before it in its row was visited. A search
stops when its window is certified: what it holds is better than the bound of the next cell,
or that bound is under the window. Cells are multiplied in bursts, each twice as large as the
one before, so a search whose bounds skip little takes few steps.

Two searches use the same index. The first finds the positives of every anchor, the best rows
of its label; the second the best rows of other labels in the window that each positive sets.
Both are exact, whatever the codebooks; those are fitted on a sample of at most ``sample_rows``
rows chosen by a hash. Shards hold at most about ``tile`` vectors, by a hash of the row.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part;
vectors are compared with vectors of the same length only. Equal rows (id, label, vector) count once;
rows with the anchor's id are its own. A null id is neither an anchor nor relabelled and comes last among ties (2^63-1 is no id).
A positive of negative score has an empty window. An empty table gives no rows; other
columns are not read. Integer scores must fit 63 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import staged
from plenum.operators.ranking import top_n

#: Rows that a search multiplies at first, at least.
BURST = 256
_NO_ID = (1 << 63) - 1


def integers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component; null unless all of them are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(x.cast("double") * float(scale)).cast("long")
    return F.when(finite, F.transform(vector, whole))


def fit_codebook(rows: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Codewords by k-means, from evenly spaced rows of a fixed order."""
    distinct = np.unique(rows, axis=0)
    words = min(words, len(distinct))
    centres = distinct[np.linspace(0, len(distinct) - 1, words).astype(int)].astype(float)
    for _ in range(rounds):
        code = _codes(rows, centres)
        held = np.bincount(code, minlength=words)
        for w in np.flatnonzero(held):
            centres[w] = rows[code == w].mean(axis=0)
    return centres


def _codes(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2.0 * rows @ centres.T, axis=1)


def fit_codebooks(rows: DataFrame, words: int = 8, sample_rows: int = 4_096) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length the codebooks of both halves; lengths outside the sample have none and use one cell.

    What reaches the driver is the sample: at most ``sample_rows`` vectors.
    """
    picked = rows.select("vector").orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(sample_rows).toArrow()["vector"].to_pylist()
    books = {}
    for size in {len(v) for v in picked}:
        same = sorted(v for v in picked if len(v) == size)
        table = np.array(same, float).reshape(len(same), size)
        books[size] = tuple(fit_codebook(half, words) for half in (table[:, : size // 2], table[:, size // 2:]))
    return books


class Index:
    """The cells of a shard: codes, radii and rows by cell."""

    def __init__(self, vectors: np.ndarray, books: dict[int, tuple[np.ndarray, np.ndarray]], most: int = 0) -> None:
        """``most`` is the largest component of the anchors, if larger than those here."""
        size = vectors.shape[1]
        self.half = size // 2
        # floats hold the integer products exactly while they are small, then doubles; else Python integers do
        most = max(int(np.abs(vectors).max(initial=0)), most)
        kind = next((kind for kind, bits in ((np.float32, 24), (float, 52)) if most * most * max(size, 1) < 1 << bits), object)
        self.exact = vectors.astype(kind)
        reals = vectors.astype(float)
        halves = reals[:, : self.half], reals[:, self.half:]
        self.books = books.get(size) or tuple(np.zeros((1, h.shape[1])) for h in halves)
        codes, self.radii = [], []
        for half, book in zip(halves, self.books, strict=True):
            code = _codes(half, book)
            radius = np.full(len(book), -np.inf)
            np.maximum.at(radius, code, np.sqrt(((half - book[code]) ** 2).sum(axis=1)))
            codes.append(code)
            self.radii.append(radius)
        cell = codes[0] * len(self.books[1]) + codes[1]
        self.rows = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[self.rows], np.arange(len(self.books[0]) * len(self.books[1]) + 1))

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Rows of the next cells, and the bound of all rows not yet visited."""
        reals = anchor.astype(float)
        bounds, orders = [], []
        for half, book, radius in zip((reals[: self.half], reals[self.half:]), self.books, self.radii, strict=True):
            bound = np.where(np.isfinite(radius), book @ half + np.sqrt(half @ half) * np.maximum(radius, 0), -np.inf)
            order = np.argsort(-bound, kind="stable")[: int(np.isfinite(radius).sum())]
            # a little more than the bound, for the rounding of the sums
            bounds.append((bound[order] + 1e-9 * (1 + np.abs(bound[order]))).tolist())
            orders.append(order.tolist())
        (one, two), (first, second) = bounds, orders
        width, heap, held, parts, burst = len(self.books[1]), [(-one[0] - two[0], 0, 0)], 0, [], BURST
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-one[i] - two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-one[i + 1] - two[0], i + 1, 0))
            cell = first[i] * width + second[j]
            low, high = self.starts[cell], self.starts[cell + 1]
            if high > low:
                parts.append(self.rows[low:high])
                held += high - low
            if parts and (held >= burst or not heap):
                yield np.concatenate(parts), -heap[0][0] if heap else -np.inf
                held, parts, burst = 0, [], 2 * burst

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return (self.exact[rows] @ anchor.astype(self.exact.dtype)).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties by the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _positives(index: Index, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    at, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, bound in index.visits(anchor):
        rows = rows[(labels[rows] == label) & (ids[rows] != own)]
        at, scores = np.concatenate([at, rows]), np.concatenate([scores, index.scores(rows, anchor)])
        keep = best(scores, ids[at], k)
        at, scores = at[keep], scores[keep]
        if len(at) == k and scores[-1] > bound:
            break
    return at, scores


def _negatives(
    index: Index, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, label: int, positives: list[int], k: int, low: int, high: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per positive the best rows of other labels with ``low * p <= 100 * score <= high * p``."""
    windows = {turn: (-(-low * p // 100), high * p // 100) for turn, p in enumerate(positives) if p >= 0}
    kept = {turn: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for turn in windows}
    open_ = set(windows)
    for rows, bound in index.visits(anchor) if windows else ():
        rows = rows[labels[rows] != label]
        scores = index.scores(rows, anchor)
        near = np.flatnonzero(scores >= min(windows[turn][0] for turn in open_))
        rows, scores = rows[near], scores[near]
        for turn in list(open_):
            floor, top = windows[turn]
            use = (scores >= floor) & (scores <= top)
            if use.any():
                at, s = np.concatenate([kept[turn][0], rows[use]]), np.concatenate([kept[turn][1], scores[use]])
                keep = best(s, ids[at], k)
                kept[turn] = at[keep], s[keep]
            s = kept[turn][1]
            if bound < floor or len(s) == k and s[-1] > bound:
                open_.discard(turn)
        if not open_:
            break
    for turn, (at, s) in kept.items():
        yield turn, at, s


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), len(flat) // max(len(rows), 1)).astype(np.int64)


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256, relabel: int | None = 7, labels: int = 10, words: int = 8, sample_rows: int = 4_096,
    tile: int = 8_192, anchor_tile: int = 512,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides. Where ``relabel`` divides the id, the label
    becomes the next one of ``labels``; None leaves all labels.
    """
    spark = df.sparkSession
    divides = lambda n: F.coalesce(F.col(key) % n == 0, F.lit(False))
    given = F.col(label).cast("long")
    own = given if relabel is None else F.when(divides(relabel), (given + 1) % labels).otherwise(given)
    rows = df.select(
        F.coalesce(F.col(key), F.lit(_NO_ID)).cast("long").alias("vec_id"), own.alias("label"), integers(F.col(vector), scale).alias("vector"), divides(every).alias("anchor")
    ).where("label IS NOT NULL AND vector IS NOT NULL").distinct()
    rows = staged(rows.select("*", F.size("vector").alias("dims"), F.xxhash64("vec_id", "label", "vector").alias("row")), "negatives-rows")
    books = spark.sparkContext.broadcast(fit_codebooks(rows, words, sample_rows))
    counts = rows.groupBy("dims").agg(
        F.ceil(F.count("*") / tile).cast("int").alias("_shards"), F.greatest(F.ceil(F.count_if("anchor") / anchor_tile), F.lit(1)).cast("int").alias("_tiles")
    )
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fresh = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  both sides come from one table
    placed = rows.join(counts, "dims")
    members = placed.select(*fresh("dims"), every_one("_tiles").alias("_tile"), F.pmod(F.xxhash64("row"), "_shards").cast("int").alias("_shard"), *fresh("vec_id", "label", "vector"))
    anchors = placed.where("anchor").select(*fresh("dims"), F.pmod("row", "_tiles").cast("int").alias("_tile"), every_one("_shards").alias("_shard"), *fresh("vec_id", "row", "label", "vector"))
    cell = ["dims", "_tile", "_shard"]

    def in_cells(queries: DataFrame, search, schema: str) -> DataFrame:
        """``search`` of the anchors of a tile in the index of a shard; yields (anchor, turn, rows, scores)."""

        def run(q: pa.Table, c: pa.Table) -> pa.Table:
            who, turns, found, scores = [], [], [], []
            if q.num_rows and c.num_rows:
                ids, own_labels = c["vec_id"].to_numpy(), c["label"].to_numpy()
                wanted = _matrix(q["vector"])
                index = Index(_matrix(c["vector"]), books.value, int(np.abs(wanted).max(initial=0)))
                extra = q["scores"].to_pylist() if "scores" in q.column_names else [None] * q.num_rows
                for i, (own_id, own_label) in enumerate(zip(q["vec_id"].to_pylist(), q["label"].to_pylist(), strict=True)):
                    for turn, at, score in search(index, ids, own_labels, wanted[i], own_id, own_label, extra[i]):
                        who += [i] * len(at)
                        turns += [turn] * len(at)
                        found.append(ids[at])
                        scores.append(score)
            column = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64())
            take = pa.array(who, pa.int64())
            return pa.table({"anchor_id": q["vec_id"].take(take).cast(pa.int64()), "row": q["row"].take(take).cast(pa.int64()), "turn": pa.array(turns, pa.int32()), "found": column(found), "score": column(scores)})

        return queries.groupBy(*cell).cogroup(members.groupBy(*cell)).applyInArrow(run, schema)

    schema = "anchor_id long, row long, turn int, found long, score long"

    def same(index, ids, own_labels, anchor, own_id, own_label, _):
        yield 0, *_positives(index, ids, own_labels, anchor, own_id, own_label, positives)

    def other(index, ids, own_labels, anchor, own_id, own_label, scores):
        yield from _negatives(index, ids, own_labels, anchor, own_label, scores, negatives, low, high)

    first = top_n(in_cells(anchors, same, schema), ["row"], [F.desc("score"), F.col("found")], positives, rank="place")
    first = staged(first.select("row", (F.col("place") - 1).alias("turn"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # at most ``positives`` scores per anchor
    limits = first.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    found = in_cells(anchors.join(limits, "row"), other, schema)
    number = F.row_number().over(Window.partitionBy("row", "turn").orderBy(F.desc("score"), "found"))
    ranked = found.withColumn("rank", number).where(F.col("rank") <= negatives).join(first, ["row", "turn"])
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return ranked.select(
        "anchor_id", known("positive_id").alias("positive_id"), "rank", known("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
