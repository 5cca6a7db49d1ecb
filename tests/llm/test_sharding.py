import zlib
from collections import Counter, defaultdict

import numpy as np

from plenum.llm import sharding


def test_balance_slots_and_whole_groups(documents):
    rows = [(i, f"text {i % 900} " + "w " * ((i % 900) * 7 % 60)) for i in range(2000)]
    out = sharding.shard(documents(*rows), 8).collect()
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    texts = dict(rows)
    for r in out:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[texts[r["doc_id"]]].add(r["shard"])
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    assert max(load.values()) / min(load.values()) < 1.05
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_hot_group_is_dealt_out(documents):
    out = sharding.shard(documents(*[(i, "same text again and again") for i in range(3000)], *[(i, f"other {i}") for i in range(3000, 5000)]), 10).collect()
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert len(load) == 10 and max(load.values()) / min(load.values()) < 1.1


def test_pack_takes_the_largest_dot_product():
    demand = np.array([[4.0, 0], [0, 4], [2, 2], [1, 1], [1, 1]])
    placed = sharding.pack(demand, 2, (1.0, 1.0))
    sums = np.zeros((2, 2))
    for d, s in zip(demand, placed, strict=True):
        sums[s] += d
    assert np.abs(sums[0] - sums[1]).max() <= 4


def test_awkward_rows(awkward):
    out = sharding.shard(awkward, 4).collect()
    assert len(out) == awkward.count()
    assert {r["size"] for r in out if r["doc_id"] in (3, 4)} == {16} and all(r["text_crc32"] == 0 for r in out if r["doc_id"] in (3, 4))
    assert sharding.shard(awkward.limit(0), 4).count() == 0
