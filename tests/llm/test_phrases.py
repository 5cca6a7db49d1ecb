import random
import re
from collections import Counter

import numpy as np
import pytest

from plenum.llm import phrases

OUT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=4, least=30, covered=80, scale=2_000_000, top=2_000):
    """(doc_id, text, lang) -> rows, by counting every phrase of every piece."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang, text = lang if lang is not None else "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i: i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found, kept = {p: c for p, c in f.items() if len(p) > 1 and c >= least}, []
        for p, a in found.items():
            longer = max((c for q, c in found.items() if len(q) > len(p) and any(q[i: i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * longer >= covered * a:
                continue
            score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def result(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).select(*OUT).collect())


def texts(seed, n, words=12):
    pick = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma", "délta", "x", "漢字", "it's", "a b", "e-f", "\x1f", "K", "zeta"][:words]
    glue = [" "] * 8 + [".", ", ", "\t", "  ", "\n", " ; ", "\x0b"]
    return ["".join(pick.choice(vocabulary) + pick.choice(glue) for _ in range(pick.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("modulus", [1, 3, 16, 1 << 40])
def test_chunks_own_every_start_once(modulus):
    import pyarrow as pa

    rows = texts(modulus, 40) + ["", "one", "one two", "one.two", "a b c a b c a b c a b c a b c"]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in rows]), pa.array(["en"] * len(rows))], ["text", "lang"])
    got = Counter()
    for part in phrases._parser(3, modulus)([batch]):
        for chunk, owned in zip(part.column("chunk").to_pylist(), part.column("owned").to_pylist(), strict=True):
            pieces = [(w, i) for i, piece in enumerate(chunk.split(b"\n")) for w in piece.split(b" ")]
            for i in range(owned):
                for n in range(1, 5):
                    span = pieces[i: i + n]
                    if len(span) == n and span[0][1] == span[-1][1]:
                        got[tuple(w for w, _ in span)] += 1
    want = Counter()
    for t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            words = [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)]
            want.update(tuple(words[i: i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    assert got == want


@pytest.mark.parametrize("least", [3, 30, 300])
def test_against_brute_force(spark, documents, least):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts(7, 300))]
    rows += [(1000 + i, "Beta gamma délta x. beta gamma délta x", "en") for i in range(400)]
    assert result(documents(*rows), least=least) == brute([(t, lang) for _, t, lang in rows], least=least)


def test_top_and_ties(spark, documents):
    rows = [(i, t, "en") for i, t in enumerate(texts(3, 200, words=6))]
    assert result(documents(*rows), least=2, top=7) == brute([(t, lang) for _, t, lang in rows], least=2, top=7)


def test_buckets_may_collide(spark, documents):
    """Tables of few bits let too much through, and change nothing."""
    docs = documents(*[(i, t, "en") for i, t in enumerate(texts(5, 150))])
    chunks = phrases.dictionary(docs)
    few, many = ({tuple(r) for r in phrases.phrase_counts(chunks, least=5, size=size).collect()} for size in (7, 26))
    assert few == many and len(few) > 50


def test_spelled_rows_are_per_group_not_per_phrase(spark):
    """Twice the phrases, as many rows between the tasks; the counts are those of the phrases."""
    import pyarrow as pa

    def packed(n):
        chunks = [f"w{i} x{i} y{i}".encode() for i in range(n)] * 2
        batch = pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(["en"] * (2 * n)), pa.array([3] * (2 * n), pa.int32()), pa.array([2] * (2 * n), pa.int64())],
                                           ["chunk", "lang", "owned", "frequency"])
        speller, g = phrases._Speller(8), phrases.Grams(chunks, batch, 3)
        for k in (1, 2, 3):
            speller.add(g, ["en"] * (2 * n), k, np.flatnonzero(g.whole[k - 1]))
        assert speller.held == 6 * n
        return list(speller.rows())

    for n in (500, 1000):
        rows = pa.Table.from_batches(packed(n))
        assert rows.num_rows == 24
        one = rows.filter(pa.compute.and_(pa.compute.equal(rows["words"], 3), pa.compute.equal(rows["group"], 0)))
        got = phrases._spelled_sums(4)(pa.concat_tables([one, one]))
        assert got.num_rows > n / 16 and set(got["f"].to_pylist()) == {8}


def test_awkward_and_empty(spark, awkward):
    rows = [(r["text"], r["lang"]) for r in awkward.collect()]
    assert result(awkward, least=3) == brute(rows, least=3)
    assert result(awkward.limit(0)) == []


def test_scores_past_64_bits(spark, monkeypatch):
    """Counts of 10^13: the product with the scale does not fit 64 bits."""
    big = 9_000_000_000_000_000
    chunks = spark.createDataFrame([("en", 2, bytearray(b"aa bb"), big), ("en", 1, bytearray(b"aa"), 7)], "lang string, owned int, chunk binary, frequency long")
    monkeypatch.setattr(phrases, "dictionary", lambda *_: chunks)
    got = result(spark.createDataFrame([], "text string, lang string"))
    assert got == [("en", 1, "aa bb", big, big + 7, big, 2 * big + 7, 2_000_000 * big // (2 * big + 7))]


def test_words_are_parted_like_the_contract(spark):
    w = phrases.Words([b"", b"One  two.three\t", b".;", b"four"])
    assert [w.bytes[b: b + n] for b, n in zip(w.begin, w.size, strict=True)] == [b"one", b"two", b"three", b"four"]
    assert w.text.tolist() == [1, 1, 1, 3] and len(set(w.piece.tolist())) == 3
    assert len(np.unique(w.hash)) == 4
