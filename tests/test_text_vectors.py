import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import text_vectors as tv
from plenum.operators.clusters import attach_vectors
from plenum.plans.theme_discovery import discover_texts

THEMES = [["the potholes on main street", "fix the potholes on our street", "potholes on every street again", "street full of potholes"],
          ["school lunch is too dear", "the price of school lunch", "my kids need school lunch", "school lunch for all kids"],
          ["more police patrols at night", "police should patrol at night", "no police patrols in the park at night", "night patrols by police please"]]


def vectors(spark, texts, **options):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["text"]: np.array(r["vector"]) for r in tv.text_vectors(df, **options).collect()}


def test_features(spark):
    df = spark.createDataFrame([("Ab cde, ab!",), ("  ",), ("漢",)], "text string")
    got = [sorted(r[0]) for r in df.select(tv.features("text")).collect()]
    assert got == [sorted(["w:ab", "w:cde", "w:ab", "p:ab cde", "p:cde ab", "c:ab", "c:cde", "c:ab"]), [], ["c:漢", "w:漢"]]


@pytest.mark.parametrize("dims", [64, 100, 16])
def test_alike_texts_are_near(spark, dims):
    got = vectors(spark, sum(THEMES, []) + [None, "", " . ", "school lunch is too dear"], dims=dims)
    assert len(got) == 12 and all(len(v) == dims and np.linalg.norm(v) == pytest.approx(1, abs=1e-5) for v in got.values())
    inside = np.mean([got[a] @ got[b] for t in THEMES for a in t for b in t if a < b])
    across = np.mean([got[a] @ got[b] for s in THEMES for t in THEMES if s is not t for a in s for b in t])
    assert inside > across + 0.15


def test_the_same_under_any_partitioning(spark):
    texts = sum(THEMES, [])
    a = vectors(spark, texts)
    b = {r["text"]: np.array(r["vector"]) for r in tv.text_vectors(spark.createDataFrame([(t,) for t in reversed(texts)], "text string").repartition(7)).collect()}
    assert all(np.abs(a[t] - b[t]).max() < 1e-6 for t in texts)
    assert np.abs(a[texts[0]] - vectors(spark, texts, seed=1)[texts[0]]).max() > 0.01


def test_one_vector_per_distinct_text_and_themes(spark):
    rows = [(i, t, i % 11 == 10) for i, t in enumerate((sum(THEMES, []) * 3)[:33])] + [(90, " ", False), (91, None, False)]
    df = spark.createDataFrame(rows, "atomic_id long, message_text string, is_opt_out boolean")
    attached = attach_vectors(df, "message_text")
    assert attached.count() == len(rows) and attached.where("embedding IS NULL").count() == 2
    out = {r["atomic_id"]: r for r in discover_texts(df, dims=8, k=3, merge_at=0.99).collect()}
    assert len(out) == len(rows) and all((r["cluster_id"] == -1) == (r["is_opt_out"] or not (r["message_text"] or "").strip()) for r in out.values())
    theme = {t: i for i, ts in enumerate(THEMES) for t in ts}
    pairs = {(theme[r["message_text"]], r["cluster_id"]) for r in out.values() if r["cluster_id"] >= 0}
    assert len(pairs) == 3


def by_hand(texts, dims, seed=42):
    """Every feature for itself: md5, bucket, weight, signs."""
    def found(t):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return [f"w:{x}" for x in w] + [f"p:{a} {b}" for a, b in zip(w, w[1:])] + [f"c:{x[i: i + 3]}" for x in w for i in range(max(len(x) - 2, 1))]

    def digest(f, block=0):
        return hashlib.md5(f"{seed}/{block}/{f}".encode()).hexdigest()

    all_features = {t: found(t) for t in set(texts) if found(t)}
    held = Counter(b for fs in all_features.values() for b in {digest(f)[:5] for f in fs})
    out = {}
    for t, fs in all_features.items():
        v = np.zeros(dims)
        for f in fs:
            weight = np.log((len(all_features) + 1) / (held[digest(f)[:5]] + 1)) + 1
            for i in range(dims):
                h = digest(f, i // 64)
                v[i] += weight if int(h[5 + 8 * (i % 64 // 32):][:8], 16) >> (i % 32) & 1 else -weight
        out[t] = v / np.linalg.norm(v)
    return out


@pytest.mark.parametrize("dims", [64, 70])
def test_against_features_one_by_one_in_small_parts(spark, monkeypatch, dims):
    monkeypatch.setattr(tv, "FEATURES", 40)
    monkeypatch.setattr(tv, "CHUNK", 7)
    texts = sum(THEMES, []) + ["漢 字 Ünder", " ", "a " * 60, "", THEMES[0][0]]
    got, want = vectors(spark, texts, dims=dims), by_hand(texts, dims)
    assert got.keys() == want.keys() and all(np.abs(got[t] - want[t]).max() < 1e-6 for t in want)


def test_features_are_not_shuffled(spark, monkeypatch):
    """Only the distinct texts are: what is written last reads them and has no row per feature."""
    plans = []
    cut = tv.cut_lineage
    monkeypatch.setattr(tv, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    assert len(vectors(spark, THEMES[0])) == 4
    assert len(plans) == 2 and not any("Generate" in p for p in plans) and "Exchange" not in plans[1]


def test_no_texts(spark):
    assert vectors(spark, []) == {}
    assert tv.text_vectors(spark.createDataFrame([], "text string, vector int").withColumn("key", F.lit(1))).count() == 0
