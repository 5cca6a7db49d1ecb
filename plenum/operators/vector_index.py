"""Exact nearest neighbours inside blocks that skip the tiles which cannot matter.

Candidates are parted by their nearest pivot, some rows of the block itself, and so are the
queries. A part knows its pivot and its radius, so the distance of two pivots less both radii
bounds every distance between the two parts. The first search looks at the nearest parts of
every query part, enough to hold ``k`` candidates; what it finds bounds the k-th best of every
query. The second one multiplies the parts whose bound may still enter, and no others. The
result is that of ``matching.block_topk`` row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.vectors import l2_normalise, squared_distance
from plenum.operators.matching import Pair, _arrow_schema, _matrix, _tile_search
from plenum.operators.ranking import top_n
from plenum.session import cut_lineage

#: What rounding may hide: scores are rounded to nine digits.
SLACK = 1e-8
#: Rows that look for their pivot in one group.
CHUNK = 32_768


def _pivots(rows: DataFrame, on: list[str], key: str, tile: int) -> DataFrame:
    """(on..., _p, _pivot): about one row in ``tile`` of every block, and the one with the smallest id."""
    picked = rows.where(F.pmod(F.xxhash64(key, F.lit("pivot")), F.lit(tile)) == 0).select(*on, key, F.col("point"))
    first = rows.groupBy(*on).agg(F.min(key).alias(key), F.min_by("point", key).alias("point"))
    both = picked.unionByName(first).dropDuplicates([*on, key])
    number = F.row_number().over(Window.partitionBy(*on).orderBy(key))
    return cut_lineage(both.select(*on, number.alias("_p"), F.col("point").alias("_pivot")))


def _parted(rows: DataFrame, pivots: DataFrame, on: list[str], key: str) -> DataFrame:
    """``rows`` with ``_part``, the number of their nearest pivot, and ``_far``, the distance to it."""
    counts = rows.groupBy(*on).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    placed = rows.join(counts, on).withColumn("_chunk", F.pmod(F.xxhash64(key), "_chunks").cast("int")).drop("_chunks")
    spread = pivots.join(counts.select(*[F.col(c).alias(c) for c in on], "_chunks"), on).select(
        *on, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "_p", "_pivot")
    schema = T.StructType([*placed.schema, T.StructField("_part", T.IntegerType()), T.StructField("_far", T.DoubleType())])

    def nearest(group: pa.Table, near: pa.Table) -> pa.Table:
        if not group.num_rows or not near.num_rows:
            part, far = np.zeros(0, np.int32), np.zeros(0)
            group = group.slice(0, 0)
        else:
            near = near.sort_by("_p")
            points, centres = _matrix(group["point"]), _matrix(near["_pivot"])
            part, far = np.zeros(len(points), np.int64), np.zeros(len(points))
            for start in range(0, len(points), 4_096):
                some = points[start: start + 4_096]
                best = ((centres**2).sum(axis=1) - 2 * some @ centres.T).argmin(axis=1)
                part[start: start + 4_096] = best
                far[start: start + 4_096] = np.sqrt(((some - centres[best]) ** 2).sum(axis=1))
            part = near["_p"].to_numpy()[part].astype(np.int32)
        return group.append_column("_part", pa.array(part, pa.int32())).append_column("_far", pa.array(far, pa.float64()))

    cell = [*on, "_chunk"]
    return cut_lineage(placed.groupBy(*cell).cogroup(spread.groupBy(*cell)).applyInArrow(nearest, schema).drop("_chunk"))


def pruned_topk(
    queries: DataFrame, candidates: DataFrame, on: list[str], k: int, query_id: str = "query_id", candidate_id: str = "candidate_id",
    query_vector: str = "query_vector", candidate_vector: str = "candidate_vector", metric: str = "cosine", pair: Pair = Pair(), tile: int = 4_096,
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``block_topk``, and a report of the pairs of parts and of rows that were and were not multiplied.

    Rows with a null vector, or a null in a column of ``on``, find nothing. Ids are not null.
    """
    point = (lambda c: l2_normalise(c)) if metric == "cosine" else (lambda c: F.transform(c, lambda x: x.cast("double")))

    def side(df: DataFrame, key: str, name: str, vector: str, columns: list[str]) -> DataFrame:
        # fresh names on both sides: queries and candidates may be the same table
        return df.where(F.col(vector).isNotNull()).select(
            *[F.col(c).alias(c) for c in on], F.col(key).alias(name), F.col(vector).alias("vector"), point(F.col(vector)).alias("point"), *[F.col(c).alias(c) for c in columns])

    c_rows = side(candidates, candidate_id, "candidate_id", candidate_vector, pair.candidate_columns)
    pivots = _pivots(c_rows, on, "candidate_id", tile)
    q = _parted(side(queries, query_id, "query_id", query_vector, pair.query_columns), pivots, on, "query_id").withColumnRenamed("_part", "_qp")
    c = _parted(c_rows, pivots, on, "candidate_id").withColumnRenamed("_part", "_cp")

    def stats(df: DataFrame, part: str, n: str, r: str) -> DataFrame:
        return df.groupBy(*on, part).agg(F.count("*").alias(n), F.max("_far").alias(r))

    def pivot_of(part: str, name: str) -> DataFrame:
        return pivots.select(*[F.col(x).alias(x) for x in on], F.col("_p").alias(part), F.col("_pivot").alias(name))

    q_parts = stats(q, "_qp", "_qn", "_qr").join(pivot_of("_qp", "_qv"), [*on, "_qp"])
    c_parts = stats(c, "_cp", "_cn", "_cr").join(pivot_of("_cp", "_cv"), [*on, "_cp"])
    # a row per pair of parts: the square of rows over ``tile``
    apart = F.sqrt(squared_distance("_qv", "_cv")) - F.col("_qr") - F.col("_cr")
    split = lambda n: F.ceil(F.col(n) / (2 * tile)).cast("int")  # noqa: E731  parts that grew too large are halved by hash
    pairs = q_parts.join(c_parts, on).select(
        *on, "_qp", "_cp", "_qn", "_cn", split("_qn").alias("_qs"), split("_cn").alias("_cs"), F.greatest(apart, F.lit(0.0)).alias("_least"))
    before = F.sum("_cn").over(Window.partitionBy(*on, "_qp").orderBy("_least", "_cp").rowsBetween(Window.unboundedPreceding, -1))
    pairs = cut_lineage(pairs.withColumn("_first", F.coalesce(before, F.lit(0)) < k))

    id_types = (q.schema["query_id"].dataType, c.schema["candidate_id"].dataType)
    schema = T.StructType([T.StructField("query_id", id_types[0]), T.StructField("candidate_id", id_types[1]), T.StructField("score", T.DoubleType())])
    cell = [*on, "_qp", "_cp", "_qi", "_ci"]

    def search(chosen: DataFrame) -> DataFrame:
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        of = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        fresh = [F.col(x).alias(x) for x in [*on, "_qp", "_cp"]]
        left = q.join(chosen, [*on, "_qp"]).select(*fresh, of("query_id", "_qs").alias("_qi"), each("_cs").alias("_ci"), "query_id", "vector", *pair.query_columns)
        right = c.join(chosen, [*on, "_cp"]).select(*fresh, each("_qs").alias("_qi"), of("candidate_id", "_cs").alias("_ci"), "candidate_id", "vector", *pair.candidate_columns)
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_tile_search(k, metric, pair, _arrow_schema(schema)), schema)

    ascending = metric == "l2"
    order: list[Column] = [F.col("score") if ascending else F.desc("score"), F.col("candidate_id")]
    first = cut_lineage(top_n(search(pairs.where("_first")), ["query_id"], order, k).drop("rank"))
    kth = first.groupBy("query_id").agg(F.count("*").alias("_found"), (F.max if ascending else F.min)("score").alias("_kth"))
    worst = (F.max if ascending else F.min)("_kth")
    known = q.select(*on, "_qp", "query_id").join(kth, "query_id", "left").groupBy(*on, "_qp").agg(
        F.when(F.bool_and(F.coalesce("_found", F.lit(0)) >= k), worst).alias("_kth"))
    least = F.col("_least")
    if ascending:
        enters = least * least - SLACK <= F.col("_kth")
    else:
        enters = 1 - least * least / 2 + SLACK + (pair.boost[2] if pair.boost else 0.0) >= F.col("_kth")
    joined = cut_lineage(pairs.join(known, [*on, "_qp"], "left").withColumn("_second", ~F.col("_first") & F.coalesce(enters, F.lit(True))))
    found = first.unionByName(search(joined.where("_second").drop("_kth")))
    work = F.col("_qn") * F.col("_cn")
    used = F.col("_first") | F.col("_second")
    report = joined.agg(
        F.count("*").alias("part_pairs"), F.count_if("_first").alias("first_pairs"), F.count_if("_second").alias("second_pairs"), F.count_if(~used).alias("skipped_pairs"),
        F.coalesce(F.try_divide(F.sum(F.when(~used, work).otherwise(0)), F.sum(work)), F.lit(0.0)).alias("skipped_share"),
    )
    return top_n(found, ["query_id"], order, k), report
