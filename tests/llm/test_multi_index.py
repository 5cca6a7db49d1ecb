import math

import numpy as np
import pytest

from plenum.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    good = set()
    for i, v, label in rows:
        if label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        good.add((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label))
    last = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a, x, label in good:
        if a is None or a % every:
            continue
        pairs = [(sum(p * q for p, q in zip(x, y, strict=True)), c, other == label) for c, y, other in good if c != a and len(y) == len(x)]
        for ps, p, _ in sorted((t for t in pairs if t[2]), key=last)[:positives]:
            inside = sorted((t for t in pairs if not t[2] and 50 * ps <= 100 * t[0] <= 95 * ps), key=last)[:negatives]
            out += [(a, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


def run(spark, rows, **options):
    return sorted((tuple(r) for r in multi_index.hard_negatives(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


def clouds(n, size, seed):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((6, size))
    return [(i, (centres[i % 6] + pick.standard_normal(size) * 0.7).tolist(), int(pick.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"tile": 60, "anchor_tile": 2, "words": 5}, {"words": 1}, {"words": 40, "sample_rows": 25}])
@pytest.mark.parametrize("size", [1, 7, 16])
def test_against_brute_force(spark, options, size):
    rows = clouds(700, size, size)
    assert run(spark, rows, **options) == brute(rows)


def test_bounds_hold_and_visits_go_down():
    pick = np.random.default_rng(5)
    vectors = pick.integers(-300, 300, (900, 10))
    books = {10: tuple(multi_index.fit_codebook(h, 6) for h in (vectors[:400, :5].astype(float), vectors[:400, 5:].astype(float)))}
    index = multi_index.Index(vectors, books)
    for anchor in vectors[:20]:
        left, bounds = set(range(900)), []
        for rows, bound in index.visits(anchor):
            left -= set(rows.tolist())
            bounds.append(bound)
            assert max((int(vectors[i] @ anchor) for i in left), default=-math.inf) <= bound
        assert not left and bounds == sorted(bounds, reverse=True)


def test_searches_stop_early():
    """Vectors in tight groups: a certified search reads a part of the shard."""
    pick = np.random.default_rng(6)
    centres = pick.integers(-2_000, 2_000, (20, 8))
    vectors = (centres[np.arange(4_000) % 20] + pick.integers(-5, 5, (4_000, 8))).astype(np.int64)
    books = {8: tuple(multi_index.fit_codebook(h, 20) for h in (vectors[:, :4].astype(float), vectors[:, 4:].astype(float)))}
    index, seen = multi_index.Index(vectors, books), []
    visits = index.visits
    index.visits = lambda anchor: ((seen.append(len(rows)), (rows, bound))[1] for rows, bound in visits(anchor))
    multi_index._positives(index, np.arange(4_000), np.arange(4_000) % 2, vectors[0], 0, 0, 5)
    assert sum(seen) < 2_000


def test_copies_ties_and_large_values(spark):
    rows = [(i, [0.5, 0.25, -0.125], i % 3) for i in range(250)] + [(300 + i, [float(i), 1.0, 2.0], i % 2) for i in range(40)]
    assert run(spark, rows) == brute(rows)
    rows = [(i, [float(2**18 + i), 3.0 * i, -7.0], i % 4) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 3), (0, [1.0, 0.0], 3), (0, [0.9, 0.1], 3), (1, None, 4), (2, [1.0, None], 4), (3, [nan, 1.0], 4), (4, [inf, 0.0], 4), (5, [1.0, 0.2], None), (None, [0.8, 0.1], 4),
            (None, [0.6, 0.0], 5), (6, [0.9, 0.0], 4), (8, [0.7, 0.0], 5), (9, [0.0, 0.0], 4), (50, [0.0, 0.0], 4), (51, [-1.0, 0.0], 4), (100, [1.0], 1), (101, [1.0], 1), (102, [0.7], 2), (150, [], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_other_columns(spark):
    from pyspark.sql import functions as F

    rows = clouds(120, 4, 9)
    names = ["vector", "dims", "row", "anchor", "_tile", "_shard", "score", "turn", "found", "rank", "place", "scores"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(n) for n in names])
    assert sorted((tuple(r) for r in multi_index.hard_negatives(df).collect()), key=str) == brute(rows)


def test_a_search_that_skips_nothing_takes_few_steps():
    pick = np.random.default_rng(3)
    vectors = pick.integers(-60, 60, (8_000, 16))
    books = {16: tuple(multi_index.fit_codebook(half.astype(float), 8) for half in (vectors[:2_000, :8], vectors[:2_000, 8:]))}
    index = multi_index.Index(vectors, books)
    steps = [rows for rows, _ in index.visits(vectors[0])]
    assert sorted(np.concatenate(steps)) == list(range(8_000)) and len(steps) <= 6


def test_scores_are_whole_where_only_the_anchor_is_large():
    vectors = np.array([[3, 5], [-7, 1]])
    anchor = np.array([(1 << 30) + 1, (1 << 31) + 3])
    index = multi_index.Index(vectors, {}, int(np.abs(anchor).max()))
    assert index.scores(np.arange(2), anchor).tolist() == [int(v @ anchor) for v in vectors]
    small = multi_index.Index(vectors, {})
    assert small.scores(np.arange(2), vectors[0]).tolist() == [34, -16]
