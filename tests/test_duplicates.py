"""Near duplicates against a plain fold, with runs that cross chunk borders."""

import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import messages as ms


def fold(rows):
    """The rule, one message after the other."""
    seen, kept, near = set(), {}, []
    for phone, file, row, text in sorted(rows, key=lambda r: (r[1], r[2])):
        norm = " ".join(text.lower().split())
        if (phone, norm) in seen:
            continue
        seen.add((phone, norm))
        words = frozenset(norm.split())
        if phone in kept and ms.near_duplicate(words, kept[phone]):
            near.append((file, row))
            continue
        kept[phone] = words
    return sorted(near)


def sample(seed, n=400):
    """One phone has a third of all rows, and its texts drift word by word."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(24)]
    rows, current = [], list(words)
    for i in range(n):
        phone = "hot" if i % 3 == 0 else f"p{rng.randrange(6)}"
        if rng.random() < 0.7:
            current[rng.randrange(24)] = f"w{rng.randrange(40)}"
        text = " ".join(current) if rng.random() < 0.9 else f"other {rng.randrange(30)}"
        rows.append((phone, f"f{i % 2}.csv", i, text))
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 7, 65_536])
@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_the_fold(spark, monkeypatch, chunk, seed):
    monkeypatch.setattr(ms, "CHUNK_ROWS", chunk)
    rows = sample(seed)
    df = spark.createDataFrame(rows, "phone string, file string, row bigint, text string").repartition(3)
    flagged = ms.exact_duplicates(df, "phone", "text", "file", "row")
    near = ms.near_duplicates(flagged.where(~F.col("is_exact_duplicate")), "phone", "text", "file", "row")
    got = sorted((r.file, r.row) for r in near.select("file", "row").collect())
    expected = fold(rows)
    assert expected and got == expected
