import datetime as dt
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plenum.operators import districts as ds
from plenum.operators import matching as mt


def vectors(n, dims, seed, blocks=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)).astype("float32")
    # the first block has a third of all rows, and some rows are exact copies
    v[1::7] = v[0]
    return [(int(i), "hot" if i % 3 == 0 else f"b{i % blocks}", [float(x) for x in v[i]]) for i in range(n)]


def brute(rows, k, same=False):
    out = {}
    for i, b, v in rows:
        scored = []
        for j, c, w in rows:
            if b == c and (same or i != j):
                a, d = np.array(v), np.array(w)
                s = round(float(a @ d / np.linalg.norm(a) / np.linalg.norm(d)), 9)
                if s > 0:
                    scored.append((-s, j))
        out[i] = [j for _, j in sorted(scored)[:k]]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("tiles", [(1000, 1000), (5, 7), (1, 3)])
def test_topk_is_exact_for_any_tiling(spark, tiles):
    rows = vectors(60, 8, 3)
    df = spark.createDataFrame(rows, "id bigint, block string, v array<float>")
    got = mt.block_topk(df, df, ["block"], 4, "id", "id", "v", "v", pair=mt.Pair(same_id=False), query_tile=tiles[0], candidate_tile=tiles[1])
    lists = {}
    for r in got.orderBy("query_id", "rank").collect():
        lists.setdefault(r.query_id, []).append(r.candidate_id)
    assert lists == brute(rows, 4)


def test_long_vectors_and_string_ids(spark):
    rows = [(str(i), "b", v) for i, _, v in vectors(6, 3072, 5)]
    df = spark.createDataFrame(rows, "id string, block string, v array<float>")
    got = mt.block_topk(df, df, ["block"], 1, "id", "id", "v", "v").collect()
    assert len(got) == 6 and all(r.score == pytest.approx(1.0) for r in got)


def test_no_candidates_no_rows(spark):
    a = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 0.0])], "id bigint, block string, v array<float>")
    b = spark.createDataFrame([(9, "y", [1.0, 0.0]), (8, "z", [1.0, 0.0])], "id bigint, block string, v array<float>")
    assert mt.block_topk(a, b, ["block"], 3, "id", "id", "v", "v").collect() == []


def test_calibration(spark):
    cases = [(90.0, "John", "Smith", "john smith", 90.0), (90.0, "John", "Smith", "Susan Smith", 57.0), (90.0, "Ann", "Lee", "Bob Lee", 82.0),
             (90.0, "Ann", "Lee", "Bob Kim", 75.0), (0.0, "a", "b", "c", 0.0), (90.0, "", "Lee", "Bob Lee", 90.0)]
    df = spark.createDataFrame(cases, "c double, f string, l string, m string, e double")
    for r in df.select(mt.calibrate("c", "f", "l", "m").alias("got"), "e").collect():
        assert r.got == r.e


def test_runoff_types_follow_the_base_date(spark):
    day = lambda m: dt.date(2024, m, 5)
    v = [1.0, 0.0]
    q = spark.createDataFrame(
        [(1, "CA", "runoff", day(12), day(11), None, v), (2, "CA", "runoff", day(5), None, day(3), v), (3, "CA", "runoff", day(6), None, None, v)],
        "rid bigint, state string, election_type string, election_date date, general_election_date date, primary_election_date date, embedding array<float>")
    r = spark.createDataFrame(
        [(10, "CA", "general", day(11), v), (11, "CA", "primary", day(3), v), (12, "CA", "runoff", day(12), v), (13, "CA", "primary", day(11), v), (14, "NV", "general", day(11), v)],
        "result_id bigint, state string, election_type string, election_date date, embedding array<float>")
    got = mt.runoff_candidates(q, r, query_id="rid", candidate_id="result_id", query_vector="embedding", candidate_vector="embedding")
    found = {}
    for row in got.collect():
        found.setdefault(row.query_id, set()).add(row.candidate_id)
    # base 11-05 has a general, so primaries are out; base 03-05 a primary, so generals are out; base 06-05 nothing, so all
    assert found == {1: {10, 12}, 2: {11, 12, 13}, 3: {10, 12, 13}}


def test_city_boost_is_capped(spark):
    p = spark.createDataFrame([(1, "CA", "Dover", [1.0, 0.0])], "id bigint, state string, city string, v array<float>")
    d = spark.createDataFrame([(7, "CA", "dover city", [0.8, 0.6]), (8, "CA", "other", [0.9, 0.4358899]), (9, "CA", "DOVER", [1.0, 0.0])], "did bigint, state string, district_name string, v array<float>")
    got = ds.district_topk(p, d, city="city", query_id="id", candidate_id="did", query_vector="v", candidate_vector="v").orderBy("rank").collect()
    assert [(r.candidate_id, round(r.score, 3)) for r in got] == [(9, 1.0), (7, 0.95), (8, 0.9)]


def test_selection_prefers_score_then_rank(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "a")], "q int, rank int, name string")
    got = mt.select_candidate(df, mt.lexical_score(F.lit("a"), F.col("name")), ["q"], ["name"]).first()
    assert (got.best_match, got.confidence, got.alternatives) == (2, 100.0, [3, 1])


def test_patching_prefers_id(spark):
    m = spark.createDataFrame([(1, 5, "QUOTA_ERROR", "x"), (2, 5, "A", "Processing error: y"), (3, 5, "B", None)], "id int, database_id int, district_name string, reason string")
    new = ds.error_rows(m).withColumn("district_name", F.lit("fixed"))
    got = {r.id: r.district_name for r in ds.patch_rows(m, new).collect()}
    assert got == {1: "fixed", 2: "fixed", 3: "B"}


def test_long_vectors_in_several_tiles(spark, monkeypatch):
    """3072 dimensions; a tile holds what fits the bytes, and the result does not depend on it."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(150, 3072)).astype(np.float32)
    df = spark.createDataFrame([("x", i, vectors[i].tolist()) for i in range(150)], "block string, id long, v array<float>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit.astype(np.float64) @ unit.T.astype(np.float64), 6)
    got = {}
    for size in (1 << 20, 64 << 20):
        monkeypatch.setattr(mt, "TILE_BYTES", size)
        rows = mt.block_topk(df, df, ["block"], 3, "id", "id", "v", "v", pair=mt.Pair(same_id=False)).collect()
        got[size] = sorted((r.query_id, r.rank, r.candidate_id) for r in rows)
    assert got[1 << 20] == got[64 << 20]
    for q, rank, c in got[64 << 20]:
        others = np.delete(scores[q], q)
        assert abs(scores[q, c] - np.sort(others)[-rank]) < 1e-5


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_a_long_tile_is_searched_in_little_memory(metric):
    """Many candidates, copies among them and rules on the pairs: as by a full table, in chunks of it."""
    rng = np.random.default_rng(8)
    n, m, dims, k = 300, 30_000, 8, 5
    left, right = rng.normal(size=(n, dims)), rng.normal(size=(m, dims))
    right[1_000::500] = right[7]
    right[2_000:2_050] = left[:50]
    right[40], left[3] = 0.0, np.nan
    arrays = lambda v: pa.array(list(v), pa.list_(pa.float64()))
    first, day, mask, bit = rng.integers(0, 9, n), rng.integers(0, 9, m), rng.integers(1, 8, n), 1 << rng.integers(0, 3, m)
    mask[5], first[6] = 0, 99
    q = pa.table({"query_id": np.arange(n), "vector": arrays(left), "first": first, "mask": mask})
    c = pa.table({"candidate_id": np.arange(m), "vector": arrays(right), "day": day, "bit": bit}).take(pa.array(rng.permutation(m)))
    rule = mt.Pair(same_id=False, not_before=("first", "day"), allowed=("mask", "bit"))
    schema = pa.schema([("query_id", pa.int64()), ("candidate_id", pa.int64()), ("score", pa.float64())])
    search = mt._tile_search(k, metric, rule, schema)
    tracemalloc.start()
    found = search(q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6, peak
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
    costs = np.round(-unit(left) @ unit(right).T if metric == "cosine" else np.maximum((left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2 * left @ right.T, 0), 9)
    good = np.isfinite(costs) & (day[None, :] >= first[:, None]) & ((bit[None, :] & mask[:, None]) != 0) & (np.arange(n)[:, None] != np.arange(m)[None, :])
    if metric == "cosine":
        good &= costs < 0
    want = [(i, j, costs[i, j]) for i in range(n) for j in np.lexsort((np.arange(m), np.where(good[i], costs[i], np.inf)))[:k] if good[i, j]]
    got = sorted((r["query_id"], r["score"] if metric == "l2" else -r["score"], r["candidate_id"]) for r in found.to_pylist())
    assert [(i, j) for i, _, j in got] == [(i, j) for i, j, _ in want]
    assert np.allclose([s for _, s, _ in got], [s for _, _, s in want])


def test_candidates_pass_a_query_tile(spark):
    """Queries are held, candidates come in batches by id: as many rows as by one table, and few of them at a time."""
    rng = np.random.default_rng(4)
    n, m, dims, k = 700, 9_000, 6, 4
    left, right = rng.normal(size=(n, dims)).astype(np.float32), rng.normal(size=(m, dims)).astype(np.float32)
    right[5::40] = right[5]
    right[7], left[3] = 0.0, np.nan
    schema = pa.schema([("query_id", pa.int64()), ("candidate_id", pa.int64()), ("score", pa.float64())])
    arrays = lambda v: pa.array(list(v), pa.list_(pa.float32()))
    q = pa.table({"query_id": np.arange(n), "vector": arrays(left)})
    c = pa.table({"candidate_id": np.arange(m), "vector": arrays(right)})
    want = mt._tile_search(k, "cosine", mt.Pair(), schema)(q, c)
    none = lambda size: pa.nulls(size, pa.int64())
    both = pa.concat_tables([
        pa.table({"_side": np.zeros(n, np.int32), "_q_query_id": q["query_id"], "vector": q["vector"], "_c_candidate_id": none(n)}),
        pa.table({"_side": np.ones(m, np.int32), "_q_query_id": none(m), "vector": c["vector"], "_c_candidate_id": c["candidate_id"]})]).combine_chunks()
    search = mt._stream_search(k, "cosine", mt.Pair(), schema)
    got = pa.Table.from_batches(search(iter(both.to_batches(max_chunksize=333))), schema)
    plain = lambda t: sorted(map(tuple, (r.values() for r in t.to_pylist())))
    assert plain(got) == plain(want) and got.num_rows > 2_000
    unit = lambda v: v / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(left) @ unit(right).T, 9)
    assert plain(got) == [(i, j, s) for i, j, s in plain(got) if abs(scores[i, j] - s) < 2e-9]
    for i in (0, 5, 699):
        order = [j for j in np.lexsort((np.arange(m), -scores[i])) if scores[i, j] > 0][:k]
        assert [j for j, _ in sorted(((r["candidate_id"], -r["score"]) for r in got.to_pylist() if r["query_id"] == i), key=lambda x: (x[1], x[0]))] == order
    assert list(search(iter(both.slice(0, n).to_batches()))) == [] == list(search(iter(both.slice(n).to_batches())))


def test_tiles_are_as_large_as_they_can_be(spark):
    """Candidates are shuffled once per query tile: a block of 9,000 queries is one tile while it is little work."""
    df = spark.range(9_000).select(F.lit("x").alias("block"), "id", F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("v"))
    few = df.where("id < 50")
    plan = mt.block_topk(df, few, ["block"], 1, "id", "id", "v", "v")
    assert plan.count() == 9_000
    assert "FlatMapCoGroupsInArrow" not in plan._jdf.queryExecution().executedPlan().toString()
