import random

from pyspark.sql import functions as F

from plenum.llm import syncmers


def brute(hashes, k):
    """The runs of k words whose smallest word hash is at an edge."""
    return [tuple(hashes[i : i + k]) for i in range(len(hashes) - k + 1) if min(hashes[i : i + k]) in (hashes[i], hashes[i + k - 1])]


def test_anchors_are_closed_syncmers(spark, documents):
    rng = random.Random(11)
    docs = documents(*[(i, " \t".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randint(0, 80)))) for i in range(80)])
    rows = docs.select(syncmers.word_hashes(F.col("text")).alias("h"), syncmers.anchors(F.col("text")).alias("a"), syncmers.anchor_places(F.col("text")).alias("p")).collect()
    runs = sorted({run for r in rows for run in brute(r["h"], 5)})
    code = dict(zip(runs, [r[0] for r in spark.createDataFrame([(i, *run) for i, run in enumerate(runs)], "i int, a long, b long, c long, d long, e long").orderBy("i").select(
        F.hash("a", "b", "c", "d", "e")).collect()], strict=True))
    for r in rows:
        want = list(dict.fromkeys(code[run] for run in brute(r["h"], 5)))
        assert want == r["a"] if want else len(r["a"]) == (1 if r["h"] else 0)
        assert [p["place"] for p in r["p"]] == [i for i in range(len(r["h"]) - 4) if min(r["h"][i : i + 5]) in (r["h"][i], r["h"][i + 4])]


def test_shared_passage_has_the_same_anchors_anywhere(documents):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents((1, passage), (2, "some other words come first " + passage + " and others last"))
    a, b = (set(r[0]) for r in docs.orderBy("doc_id").select(syncmers.anchors(F.col("text"))).collect())
    assert a <= b


def test_edits_and_followers(documents):
    rng = random.Random(12)
    texts = {i * 3: "é" * rng.randint(0, 3) + " ".join(rng.choices([f"w{j}" for j in range(500)], k=rng.randint(0, 120))) for i in range(70)}
    out = {r["doc_id"]: r for r in syncmers.edited_pairs(documents(*texts.items()).repartition(5)).collect()}
    order = sorted(texts, reverse=True)
    assert len(out) == len(texts)
    for i, d in enumerate(order):
        follower, own = texts[order[(i + 1) % len(order)]], texts[d]
        third = len(own) // 3
        assert out[d]["n_chars"] == len(own) and out[d]["edited"] == own[: len(own) - third] + follower[:third]
        assert out[d]["next_anchors"] == out[order[(i + 1) % len(order)]]["anchors"]


def test_likeness(spark):
    row = spark.range(1).select(*[syncmers.likeness(F.array(*map(F.lit, a)).cast("array<int>"), F.array(*map(F.lit, b)).cast("array<int>")) for a, b in
                                  [([1, 2], [2, 3]), ([], []), ([1], []), ([5, 6], [6, 5])]]).first()
    assert list(row) == [1 / 3, 1.0, 0.0, 1.0]
    assert spark.range(1).select(syncmers.as_text(F.array(F.lit(-1), F.lit(255)))).first()[0] == "FFFFFFFF000000FF"


def test_awkward_rows(awkward):
    out = syncmers.edited_pairs(awkward).collect()
    assert len(out) == awkward.count()
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["anchors"] == by_id[2]["anchors"] and by_id[3]["anchors"] == by_id[4]["anchors"] == by_id[5]["anchors"] == []
    assert len(by_id[7]["anchors"]) == 1
    assert syncmers.edited_pairs(awkward.limit(0)).count() == 0
    one = syncmers.edited_pairs(awkward.where("doc_id = 7")).collect()
    assert one[0]["edited"] == "wor" + "w" and one[0]["next_anchors"] == one[0]["anchors"]
