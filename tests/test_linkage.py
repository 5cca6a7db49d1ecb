"""Weights from patterns against plain Python, and what the scores pick on records with mistakes."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import linkage as lk
from plenum.operators import pair_tiles as pt
from plenum.operators.matching import lexical_score, select_candidate

FIELDS = [lk.Field("name", "l_name", "r_name", close=0.8, counted=True), lk.Field("town", "l_town", "r_town"), lk.Field("year", "l_year", "r_year", close=0.7)]


def test_levels(spark):
    rows = [("Ann Lee", " ann lee ", "x", "X", None, "1990"), ("Jon Smith", "John Smith", "x", "y", "1990", "1991"), ("abc", "xyz", "", "y", "1990", "2015"), (None, None, None, "y", " ", "1")]
    df = spark.createDataFrame(rows, "l_name string, r_name string, l_town string, r_town string, l_year string, r_year string")
    got = [tuple(r[f"level_{n}"] for n in ("name", "town", "year")) for r in lk.with_levels(df, FIELDS).collect()]
    assert got == [(2, 2, -1), (1, 0, 1), (0, -1, 0), (-1, -1, -1)]
    counts = {tuple(r)[:3]: r["pairs"] for r in lk.pattern_counts(lk.with_levels(df.union(df), FIELDS), FIELDS).collect()}
    assert counts == dict.fromkeys(got, 2)


def test_weights_find_the_shares_that_made_the_patterns():
    pick = random.Random(1)
    m, u, prior = [{0: 0.1, 1: 0.2, 2: 0.7}, {0: 0.05, 1: 0.05, 2: 0.9}, {0: 0.2, 1: 0.3, 2: 0.5}], [{0: 0.9, 1: 0.08, 2: 0.02}, {0: 0.7, 1: 0.1, 2: 0.2}, {0: 0.8, 1: 0.15, 2: 0.05}], 0.2
    patterns = Counter()
    for _ in range(60_000):
        side = m if pick.random() < prior else u
        pattern = tuple(pick.choices(list(s), list(s.values()))[0] for s in side)
        patterns[tuple(-1 if pick.random() < 0.1 else x for x in pattern)] += 1
    w = lk.fit_weights(list(patterns.items()), FIELDS)
    assert w.prior == pytest.approx(prior, abs=0.03)
    for i, f in enumerate(FIELDS):
        for level in lk.LEVELS:
            assert w.matches[f.name][level] == pytest.approx(m[i][level], abs=0.05)
            assert w.others[f.name][level] == pytest.approx(u[i][level], abs=0.03)
    assert w.weight("name", lk.MISSING) == 0 and w.weight("name", lk.EQUAL) > w.weight("town", lk.EQUAL) > 0


def test_no_pairs_and_one_pattern():
    w = lk.fit_weights([], FIELDS)
    assert w.weight("name", lk.EQUAL) == pytest.approx(4) and w.prior == 0.1
    w = lk.fit_weights([((2, 2, 2), 50)], FIELDS)
    assert all(math.isfinite(w.weight(f.name, x)) for f in FIELDS for x in lk.LEVELS)


def test_a_rare_value_is_worth_more(spark):
    df = spark.createDataFrame([("smith", "smith"), ("zyxwv", "zyxwv"), ("new", "new"), ("smith", "zyxwv")], "l_name string, r_name string")
    field = [FIELDS[0]]
    w = lk.Weights({"name": {0: 0.1, 1: 0.1, 2: 0.8}}, {"name": {0: 0.6, 1: 0.2, 2: 0.2}}, 0.5)
    shares = lk.value_shares(spark.createDataFrame([("Smith ",)] * 99 + [("zyxwv",), (None,), (" ",)], "n string"), "n")
    assert {r["value"]: r["share"] for r in shares.collect()} == {"smith": 0.99, "zyxwv": 0.01}
    got = [(r["l_name"], r["r_name"], r["match_weight"], r["match_probability"]) for r in lk.score(lk.with_levels(df, field), field, w, {"name": shares}).collect()]
    want = {("smith", "smith"): math.log2(4), ("zyxwv", "zyxwv"): math.log2(80), ("new", "new"): math.log2(4), ("smith", "zyxwv"): math.log2(0.1 / 0.6)}
    assert len(got) == 4
    for left, right, weight, probability in got:
        assert weight == pytest.approx(want[left, right]) and probability == pytest.approx(1 / (1 + 2 ** -want[left, right]))


def test_picks_more_right_records_than_edit_distance(spark):
    """Records with typing mistakes, missing fields and namesakes; nothing is labelled."""
    pick = random.Random(4)
    first, last = ["ann", "maria", "john", "peter", "li", "omar"], ["smith"] * 12 + ["jones"] * 6 + ["abernathy", "quill", "zielinski", "okafor", "baptiste", "lindqvist"]
    people = [(i, f"{pick.choice(first)} {pick.choice(last)}", pick.choice(["york", "leeds", "hull", "bath"]), str(pick.randrange(1940, 2000))) for i in range(400)]

    def typed(text):
        if pick.random() < 0.35:
            at = pick.randrange(len(text))
            text = text[:at] + pick.choice("abcdeios") + text[at + 1:]
        return text

    left = [(i, typed(n), t if pick.random() > 0.15 else None, y if pick.random() > 0.15 else None) for i, n, t, y in people]
    a = spark.createDataFrame(left, "l_id int, l_name string, l_town string, l_year string")
    b = spark.createDataFrame(people, "r_id int, r_name string, r_town string, r_year string")
    pairs = a.join(b, F.substring("l_name", 1, 1) == F.substring("r_name", 1, 1)).withColumn("rank", F.col("r_id"))
    levels = lk.with_levels(pairs, FIELDS).cache()
    w = lk.fit(levels, FIELDS, prior=0.02)
    scored = lk.score(levels, FIELDS, w, {"name": lk.value_shares(b, "r_name")})

    def right(df, column):
        chosen = select_candidate(df, column, ["l_id"], ["r_id"]).collect()
        return sum(r["l_id"] == r["r_id"] for r in chosen) / len(chosen)

    fitted = right(scored, F.col("match_weight"))
    lexical = right(pairs, lexical_score(F.col("l_name"), F.col("r_name"), F.col("l_town") == F.col("r_town")))
    assert fitted > 0.8 and fitted > lexical + 0.1, (fitted, lexical)


def test_one_block_is_paired_in_many_tasks(spark):
    """A block of a few kilobytes has many pairs: all of them come, and from several tasks."""
    left = spark.range(1_000).select(F.lit("x").alias("block"), "id", F.when(F.col("id") % 7 != 0, F.concat(F.lit(" Ann "), F.col("id").cast("string"))).alias("l_name"))
    left = left.union(spark.createDataFrame([(None, 1, "a"), ("alone", None, "b"), ("x", None, "c"), ("x", 5, "d")], "block string, id long, l_name string"))
    right = spark.createDataFrame([("x", "ann 12"), ("x", "ann 12"), ("x", None), (None, "a")], "block string, r_name string")
    got = lk.block_pairs(left, right, ["block"], "id")
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "block").collect()))
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    # cleaned before pairing or by the pairs: the same levels
    field = [lk.Field("name", "l_name", "r_name", close=0.8)]
    early = lk.with_levels(lk.block_pairs(lk.cleaned(left, field, "left"), lk.cleaned(right, field, "right"), ["block"], "id"), field)
    assert early.columns == lk.with_levels(got, field).columns
    assert sorted(map(str, early.collect())) == sorted(map(str, lk.with_levels(got, field).collect()))


def test_close_texts_at_the_limit(spark):
    rows = [("abcd", "abcx"), ("abcd", "abxy"), ("abcdefgh", "abcdef"), ("abcdefgh", "abcde"), ("abcdefgh", "hgabcd"), ("a", "b")]
    df = spark.createDataFrame(rows, "l_name string, r_name string")
    got = [r["level_name"] for r in lk.with_levels(df, [lk.Field("name", "l_name", "r_name", close=0.75)]).collect()]
    assert got == [1, 0, 1, 0, 0, 0]


def test_shares_looked_up_per_record(spark):
    df = spark.createDataFrame([("smith", "smith"), ("zyxwv", "zyxwv"), ("new", "new"), ("smith", "zyxwv"), (None, "smith")], "l_name string, r_name string")
    field = [FIELDS[0]]
    w = lk.Weights({"name": {0: 0.1, 1: 0.1, 2: 0.8}}, {"name": {0: 0.6, 1: 0.2, 2: 0.2}}, 0.5)
    shares = spark.createDataFrame([("smith", 0.99), ("zyxwv", 0.01)], "value string, share double")
    want = lk.score(lk.with_levels(df, field), field, w, {"name": shares})
    got = lk.score(lk.with_levels(lk.with_share(df, "l_name", shares, "held"), field), field, w, {"name": "held"})
    assert got.count() == 5 and sorted(map(str, got.drop("held").collect())) == sorted(map(str, want.collect()))


def _tile_sides(spark, rows=150):
    """Records with close, equal, missing and repeated texts in blocks, some of them without a block or a partner."""
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("abé中") for _ in range(pick.randrange(1, 9)))

    def record(i):
        return (pick.choice(["x", "x", "x", "y", "z", None]), i // 2, pick.choice([None, " ", word(), word() + " " + word(), "LONG " * 15 + word()]), pick.choice(["york", "Yorck", "bath", None]), str(pick.randrange(4)))

    left = spark.createDataFrame([record(i) for i in range(rows)], "block string, l_id long, l_name string, l_town string, l_year string")
    right = spark.createDataFrame([record(i) for i in range(rows)], "block string, r_id long, r_name string, r_town string, r_year string").where("block <> 'z'")
    return left.union(left.limit(9)), right.union(right.limit(7))


def test_tiles_count_the_patterns_of_all_pairs(spark, monkeypatch):
    left, right = _tile_sides(spark)
    fields = [lk.Field("name", "l_name", "r_name", close=0.6, counted=True), lk.Field("town", "l_town", "r_town", close=0.75), lk.Field("year", "l_year", "r_year")]
    rows = lk.with_levels(lk.block_pairs(left, right, ["block"], "l_id"), fields)
    want = lk.pattern_counts(rows, fields)
    monkeypatch.setattr(lk, "COUNTED", (16, 32))
    got = lk.pattern_counts(lk.with_levels(lk.block_pairs(left, right, ["block"], "l_id", carry=["l_id", "r_id"]), fields), fields)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the pairs are rows in no plan: a tile is a group, and what comes out of it is a row per pattern
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "levenshtein" not in plan


def test_tiles_score_like_rows(spark, monkeypatch):
    left, right = _tile_sides(spark, 90)
    fields = [lk.Field("name", "l_name", "r_name", close=0.6, counted=True), lk.Field("town", "l_town", "r_town", close=0.75), lk.Field("year", "l_year", "r_year")]
    shares = lk.value_shares(left, "l_name")
    left = lk.with_share(left, "l_name", shares, "name_share")
    rows = lk.with_levels(lk.block_pairs(left, right, ["block"], "l_id"), fields)
    w = lk.fit(rows, fields)
    want = lk.score(rows, fields, w, {"name": "name_share"})
    monkeypatch.setattr(lk, "LISTED", (16, 32))
    monkeypatch.setattr(lk, "PICKED", (16, 32))
    tiles = lk.with_levels(lk.block_pairs(left, right, ["block"], "l_id", carry=["l_id", "r_id"]), fields)
    assert lk.fit(tiles, fields).prior == pytest.approx(w.prior)
    got = lk.score(tiles, fields, w, {"name": "name_share"})
    columns = ["l_id", "r_id", "match_weight", "match_probability"]
    plain = lambda df: sorted(map(str, map(tuple, df.select(*columns).collect())))
    assert got.columns == columns and plain(got) == plain(want)
    assert plain(lk.score(tiles, fields, w, {"name": shares})) == plain(want)
    assert plain(lk.score(tiles, fields, w, {"name": "name_share"}, digits=3)) == plain(lk.score(rows, fields, w, {"name": "name_share"}, digits=3))
    # the same selection from the best pairs of each tile
    cut = lk.score(tiles, fields, w, {"name": "name_share"}, best=4, order="r_id")
    assert cut.count() < want.count()
    select = lambda df: sorted(map(str, select_candidate(df.withColumn("rank", F.col("r_id")), F.col("match_weight"), ["l_id"], ["r_id"]).drop("n_candidates").collect()))
    assert select(cut) == select(want)


@pytest.mark.parametrize("lengths", [(0, 7), (1, 25), (50, 90), (3, 140)])
def test_edit_distances_of_many_pairs(lengths):
    pick = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    texts = lambda n: ["".join(pick.choice("abcdé中😀") for _ in range(pick.randint(*lengths))) for _ in range(n)]
    one = list(dict.fromkeys(texts(25)))
    two = list(dict.fromkeys([*texts(20), *[t[:2] + t[3:] for t in one[:12]], *[t + "q" for t in one[:5]], *one[:3]]))
    pairs = [(i, j) for i in range(len(one)) for j in range(len(two))]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    want = [plain(one[a], two[b]) for a, b in pairs]
    assert pt.edit_distances(one, two, i, j).tolist() == want
    for close in (1 / 3, 0.6, 0.75, 0.85, 1.0):
        good = {p for p, d in zip(pairs, want, strict=True) if (m := max(len(one[p[0]]), len(two[p[1]]))) and 1 - d / m >= close}
        assert set(zip(*map(np.ndarray.tolist, pt.close_pairs(one, two, close)), strict=True)) == good
