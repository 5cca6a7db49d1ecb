import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plenum.llm import mixing


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by the rule itself: cut what is above, share the rest by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_targets_and_words_taken(documents):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choices(["a", "b", "c", None, "é", "z"], [30, 1, 8, 2, 3, 1])[0]) for i in range(1500)]
    docs = documents(*rows)
    plan = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in plan:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["repeats"]
        assert 0 <= r["repeats"] <= 3
    want = fill(sizes)
    for r in plan:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 130
    assert sum(sizes.values()) - 200 <= sum(taken.values()) <= sum(sizes.values())
    again = {(r["doc_id"], r["repeats"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in plan}


def test_queue_order_as_by_sorting(documents):
    rng = random.Random(2)
    docs = documents(*[(i, " ".join(["w"] * rng.randint(1, 9)), "en", rng.choice("ab")) for i in range(80)])
    rows = mixing.mix(docs).join(docs.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("turn")), "doc_id").collect()
    queue, reach = [], defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["turn"], r["doc_id"])):
        reach[r["source"]] += r["size"]
        queue += [((reach[r["source"]] + lap * r["source_size"]) / r["target"], r["source"], r["turn"], r["doc_id"], r["size"], lap) for lap in range(3)]
    total, run, laps = sum(r["size"] for r in rows), 0, Counter()
    for key in sorted(queue):
        run += key[4]
        if run > total:
            break
        laps[key[3]] += 1
    assert {r["doc_id"]: r["repeats"] for r in rows} == {r["doc_id"]: laps[r["doc_id"]] for r in rows}


def test_mixed_rows_follow_the_plan(documents):
    docs = documents(*[(i, "w " * (i % 7), "en", "ab"[i % 2]) for i in range(60)], (3, "w w w", "en", "b"), (3, "w w w", "en", "b"))
    words = mixing.mix(docs).agg(F.sum(F.col("size") * F.col("repeats"))).first()[0]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] == words


def test_awkward_rows(awkward, documents):
    plan = mixing.mix(awkward)
    assert plan.count() == awkward.count()
    assert all(r["repeats"] == 0 for r in plan.where("size = 0").collect())
    assert mixing.mixed(awkward).columns == awkward.columns
    assert mixing.mix(awkward.limit(0)).count() == 0 and mixing.mixed(awkward.limit(0)).count() == 0
    empty = mixing.mix(documents((1, None), (2, "")))
    assert [r["repeats"] for r in empty.collect()] == [0, 0]
