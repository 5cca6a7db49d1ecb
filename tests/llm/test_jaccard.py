import random
from itertools import combinations

import numpy as np
import pytest

from plenum.llm import jaccard


def grams(text, n):
    words = [w for w in (text or "").replace("\x1c", "?").lower().split()]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(docs, n, percent):
    sets, up = [grams(t, n) for _, t in docs], list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    return {docs[i][0]: (len(sets[i]), min(docs[j][0] for j in range(len(docs)) if top(j) == top(i))) for i in range(len(docs))}


def corpus(rng, groups=25):
    docs, vocabulary = [], [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=40)
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 6, 20, 60, 150, 200]))
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy).title() if rng.random() < 0.2 else "  ".join(copy)))
    return docs


def classes(frame, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(frame, **how).collect()}


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 70, 3)])
def test_against_all_pairs(documents, n, percent, seed):
    docs = corpus(random.Random(seed))
    assert classes(documents(*docs), n=n, percent=percent) == brute(docs, n, percent)


def test_against_all_pairs_in_small_blocks(documents, monkeypatch):
    """Blocks of a few documents, and every shared shingle common: tiles and the late order are used."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "COMMON_LEAST", 2)
    monkeypatch.setattr(jaccard, "COMMON_SIGMAS", 0)
    docs = corpus(random.Random(5), 40)
    assert classes(documents(*docs)) == brute(docs, 4, 85)


@pytest.mark.parametrize("block", [None, 4])
def test_every_link_is_counted(documents, monkeypatch, block):
    """The links of groups of near and equal copies, whole or cut into tiles, against all pairs."""
    if block:
        monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus(random.Random(9), 30)
    sets = [grams(t, 4) for _, t in docs]
    want = {d: sum(j != i and bool(sets[i]) and 100 * len(sets[i] & s) >= 85 * len(sets[i] | s) for j, s in enumerate(sets)) for i, (d, _) in enumerate(docs)}
    found = jaccard.classes(documents(*docs), links=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in found} == want and max(want.values()) > 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(docs, 4, 85)


def test_cells_never_enlarge_a_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, size=rng.integers(1, 900)))
        b = np.unique(np.concatenate((a[: len(a) * 9 // 10], rng.integers(0, 1 << 62, size=rng.integers(1, 100)))))
        near = jaccard._by_cells([jaccard.cells(a), jaccard.cells(b)], np.array([len(a), len(b)]), 85)(0, np.array([1]))[0]
        pair = jaccard._pair_by_cells((0, len(a), jaccard.cells(a).tobytes()), (1, len(b), jaccard.cells(b).tobytes()), 85)
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both >= 85 * union:
            assert near and pair
        if 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
            assert near == pair


def test_hot_group(documents):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(base[:50] + [f"x{rng.randrange(40)}"] + base[50:])) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(300)]
    found = classes(documents(*docs))
    assert {c for _, c in found.values()} == {0}


def test_without_copies(documents):
    docs = corpus(random.Random(8))
    want = {c for d, (n, c) in brute(docs, 5, 80).items()}
    out = jaccard.without_copies(documents(*docs), n=5, percent=80)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_awkward_rows(awkward):
    rows = jaccard.classes(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == 1 and by_id[None]["component_id"] is None and by_id[None]["n_shingles"] > 0
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (3, 4, 5)) and by_id[7]["n_shingles"] == 1
    kept = jaccard.without_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert jaccard.classes(awkward.limit(0)).count() == 0 and jaccard.without_copies(awkward.limit(0)).count() == 0
