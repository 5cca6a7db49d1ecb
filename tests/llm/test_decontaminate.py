import math
import random
import re
from itertools import combinations

import pytest

from plenum.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, items, window=12):
    out = set()
    for d, text in docs:
        own = words(text)
        for i, body in items:
            item = words(body)
            if len(item) < 5:
                continue
            span, best = min(window, len(item)), None
            for shift in range(-len(item) + 1, len(own)):
                equal = [0 <= shift + j < len(own) and own[shift + j] == w for j, w in enumerate(item)]
                if max(sum(equal[k : k + span]) for k in range(len(item) - span + 1)) >= math.ceil(0.75 * span):
                    best = max(best or (-1, 0), (sum(equal), -shift))
            if best:
                out.add((d, i, -best[1], best[0]))
    return out


@pytest.mark.parametrize("lost", [1, 2, 3])
def test_masks_see_every_three_replacements_in_a_window(lost):
    for gone in combinations(range(12), lost):
        assert any(all(p + j not in gone for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(12 - len(m) + 1))


@pytest.mark.parametrize("n", range(5, 12))
def test_masks_see_all_that_a_short_item_accepts(n):
    masks = decontaminate.MASKS + (decontaminate.SHORT_MASKS if n in decontaminate.SHORT_LENGTHS else ())
    for lost in range(n - math.ceil(0.75 * n) + 1):
        for gone in combinations(range(n), lost):
            assert any(all(p + j not in gone for j, c in enumerate(m) if c == "1") for m in masks for p in range(n - len(m) + 1)), gone


@pytest.mark.parametrize("n", [5, 6, 8, 11])
def test_short_items_with_replaced_words(spark, documents, n):
    item = [f"word{i}" for i in range(n)]
    docs = []
    for lost in range(4):
        for gone in combinations(range(n), lost):
            text = ["x" if i in gone else w for i, w in enumerate(item)]
            docs.append((len(docs), "before it " + " ".join(text) + " behind it"))
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["end"] - r["item_words"], r["matched"]) for r in decontaminate.leaks(documents(*docs), benchmark).collect()}
    want = brute(docs, [(1, " ".join(item))])
    assert found == want and want


def test_against_all_alignments(spark, documents):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 30)))) for i in range(12)] + [(99, "too short here"), (98, None), (97, "")]
    docs = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 3 == 0:
            part = words(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 5)):
                part[rng.randrange(len(part))] = "other"
            if d % 2:
                part = part[rng.randint(0, 8):]
            at = rng.randint(0, len(text))
            text = text[:at] + part + text[at:]
        docs.append((d, ", ".join(text).title()))
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, seed int")
    found = decontaminate.leaks(documents(*docs), benchmark).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"], r["end"] - r["item_words"], r["matched"]) for r in found} == want and len(want) > 10


def test_short_items_match_verbatim(spark, documents):
    benchmark = spark.createDataFrame([(1, "five words stand in here"), (2, "Five words stand in here!")], "item_id long, text string")
    found = decontaminate.leaks(documents((1, "so five words stand in here now"), (2, "five words stood in there"), (3, "words stand")), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (1, 2)}


def test_awkward_rows(spark, awkward):
    benchmark = spark.createDataFrame([(1, " ".join(awkward.first()["text"].split()[:20]), "x"), (None, awkward.first()["text"], "x")], "item_id long, text string, item string")
    kept = decontaminate.without_leaks(awkward, benchmark)
    assert kept.columns == awkward.columns
    gone = {(r["doc_id"]) for r in awkward.collect()} - {r["doc_id"] for r in kept.collect()}
    assert {1, 2} <= gone and not gone & {3, 4, 5, 7, 8, 10}
    assert decontaminate.without_leaks(awkward, benchmark.limit(0)).count() == awkward.count()
    assert decontaminate.leaks(awkward.limit(0), benchmark).count() == 0
    both = {r["item_id"] for r in decontaminate.leaks(awkward, benchmark).where("doc_id = 2").collect()}
    assert both == {1, None}
