import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plenum.operators import quotes
from plenum.operators.page_index import PageIndex, suffix_order


def plain(body, quote):
    m = SequenceMatcher(None, body, quote, autojunk=False).find_longest_match(0, len(body), 0, len(quote))
    return (m.size, m.a) if m.size else (0, 0)


@pytest.mark.parametrize("letters", ["ab", "abcdef ", "aé\U0001f600 "])
def test_longest_block_is_that_of_difflib(letters):
    rng = random.Random(letters)
    for _ in range(150):
        body = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        quote = "".join(rng.choices(letters + "z", k=rng.randint(0, 30)))
        assert PageIndex(body).longest(quote) == plain(body, quote) == quotes.common_block(body, quote)
        assert suffix_order(body).tolist() == sorted(range(len(body)), key=lambda i: body[i:])


def test_long_pages_and_quotes():
    rng = random.Random(1)
    body = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60_000))
    start = time.perf_counter()
    page = PageIndex(body)
    for at in rng.sample(range(300_000), 50):
        size, place = page.longest("#" + body[at : at + 400] + "#")
        assert size >= 400 and body[place : place + 400] == body[at : at + 400]
    assert PageIndex("a" * 200_000).longest("b" + "a" * 5_000 + "b") == (5_000, 0)
    assert time.perf_counter() - start < 30


def test_claims_of_popular_and_missing_pages(spark, monkeypatch):
    """One page asked by most claims, in several lists; repeated claims, nulls and pages with two versions."""
    monkeypatch.setattr(quotes, "QUOTES_AT_ONCE", 7)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcd", k=3)) for _ in range(30)]
    bodies = {"hot": " ".join(rng.choices(words, k=80)), "cold": " ".join(rng.choices(words, k=20)), "empty": ""}
    rows = [("hot", " ".join(rng.choices(words, k=rng.randint(1, 4)))) for _ in range(60)] * 2
    rows += [("cold", "abc"), ("empty", "abc"), ("gone", "abc"), (None, "abc"), ("hot", None), ("hot", ""), ("twice", "one"), ("twice", None)]
    claims = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, url string, quote string")
    pages = spark.createDataFrame([*bodies.items(), ("twice", "one two"), ("twice", "three"), (None, "abc")], "url string, html string")
    got = quotes.verify_quotes(claims, pages).collect()
    assert sorted(r.n for r in got) == sorted([*range(len(rows)), len(rows) - 2, len(rows) - 1])
    for r in got:
        if r.url == "twice":
            continue
        body, quote = bodies.get(r.url, ""), r.quote or ""
        size, at = plain(body, quote)
        if quote and quote in body:
            assert (r.match, r.similarity, r.closest_match) == (True, 1.0, quote)
        elif size:
            assert (r.match, r.similarity, r.closest_match) == (False, size / len(quote), body[max(0, at - 30) : at + size + 30])
        else:
            assert (r.match, r.similarity, r.closest_match) == (False, 0.0, None)
    assert sorted(r.match for r in got if r.url == "twice") == [False, False, False, True]
    plain_test = quotes.verify_quotes(claims, pages, explain_misses=False).orderBy("n", F.col("match")).select("n", "match").collect()
    assert plain_test == sorted((r.n, r.match) for r in got)
    nothing = quotes.verify_quotes(claims.limit(0), pages.limit(0))
    assert nothing.columns == ["n", "url", "quote", "match", "similarity", "closest_match"] and nothing.count() == 0
