import math

import numpy as np
import pytest

from plenum.llm import collisions

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    """Rows of (vec_id, vector) -> {(query_id, vector): [(vec_id, distance)]}."""
    good = {(i, tuple(np.float32(v).tolist())) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good:
        if q is None or q % every:
            continue
        near = []
        for c, y in good:
            if c != q and len(x) == len(y):
                total = 0.0
                for a, b in zip(x, y, strict=True):
                    total += (b - a) * (b - a)
                near.append((math.sqrt(total), c is None, c))
        out[q, x] = [(c, d) for d, _, c in sorted(near, key=lambda t: (t[0], t[1], t[2] or 0))[:k]]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted((r["query_id"], r["rank"], r["vec_id"] is None, r["vec_id"] or 0, r["score"]) for r in collisions.nearest(df, **options).collect())


def as_rows(found):
    return sorted((q, rank, c is None, c or 0, d) for (q, _), near in found.items() for rank, (c, d) in enumerate(near, 1))


def clouds(n, size, seed):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((5, size))
    return [(i, (centres[i % 5] + pick.standard_normal(size) * (0.02 if i % 3 else 1)).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("tile,query_tile", [(8_192, 512), (97, 3)])
def test_recall_and_scores(spark, tile, query_tile):
    rows = clouds(1_500, 32, 1)
    want = brute(rows, 100, 10)
    got = run(spark, rows, tile=tile, query_tile=query_tile)
    assert len(got) == sum(map(len, want.values()))
    exact = set(as_rows(want))
    assert len(exact & set(got)) / len(exact) >= 0.99
    by_id = dict(rows)
    for q, _, _, c, score in got:
        assert score == pytest.approx(math.dist(np.float32(by_id[q]).astype(float), np.float32(by_id[c]).astype(float)), rel=1e-12)


def test_uniform_directions_keep_recall(spark):
    pick = np.random.default_rng(3)
    vectors = pick.standard_normal((3_000, 64))
    rows = list(enumerate((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).tolist()))
    want, got = as_rows(brute(rows, 100, 10)), run(spark, rows, tile=1_000)
    assert len(set(want) & set(got)) / len(want) >= 0.95


def test_copies_and_ties_fall_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1_000 + i, [float(i), 0.5, 0.25]) for i in range(40)]
    assert run(spark, rows, every=100) == as_rows(brute(rows, 100, 10))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-inf, 1.0]),
            (None, [1.0, 0.5]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, []), (9, [3.0]), (100, [4.0]), (10, [1e30, -1e30]), (200, [1.0, 2.0, 3.0])]
    got = run(spark, rows)
    assert got == as_rows(brute(rows, 100, 10))
    assert all(c not in (1, 2, 3, 4, 5, 6, 8) for _, _, null, c, _ in got if not null)


def test_fewer_candidates_than_k_empty_and_other_columns(spark):
    assert run(spark, [(0, [1.0, 2.0])]) == []
    assert run(spark, []) == []
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 3.0], 0)], SCHEMA)
    names = ["vector", "dims", "_row", "_tile", "_shard", "_query", "query_id", "score", "rank", "_tiles", "_shards"]
    extra = df.select("*", *[F.lit("x").alias(n) for n in names])
    assert [tuple(r) for r in collisions.nearest(extra).collect()] == [(0, 1, 1, 1.0)]


def test_threshold_is_the_binomial_quantile():
    p = math.erf(collisions.WINDOW / math.sqrt(2))
    for m, miss in ((128, 0.002), (32, 0.01), (8, 0.5)):
        chance = [math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(m + 1)]
        least = collisions.threshold(m, miss)
        assert sum(chance[:least]) <= miss < sum(chance[: least + 1])
