"""Scores of candidate pairs by what the agreement of each field is worth.

A pair has a level of agreement per field: 2 equal, 1 close, 0 different, -1 where a side is
missing. How often each level occurs among matches and among other pairs is fitted without
labels, by expectation-maximisation over the counts of the patterns of levels. That table has at
most four rows to the power of the fields, however many pairs there are. A field adds the binary logarithm
of the two shares to the weight of a pair. Where a field counts values, equal values add what
their own frequency is worth instead: a rare surname says more than a common one.

All pairs of a block are its square, so pairs may stay tiles: some left rows beside some right rows, whose
levels are numbers in a matrix (``pair_tiles``). Counts of patterns and scores are then found tile by tile, and
only what is asked for becomes rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.text import nullif_blank
from plenum.operators import pair_tiles as pt

MISSING, DIFFERENT, CLOSE, EQUAL = -1, 0, 1, 2
LEVELS = (DIFFERENT, CLOSE, EQUAL)
#: No level is taken to be impossible.
FLOOR = 1e-4


@dataclass(frozen=True)
class Field:
    """A compared field: two text columns, the edit similarity from which they are close, and whether values are counted."""

    name: str
    left: str
    right: str
    close: float | None = None
    counted: bool = False


#: Left rows of a block that meet its right rows in one group.
SLICE = 256


#: Left and right rows of a tile whose patterns are counted, whose best pairs are picked, whose pairs become rows.
COUNTED, PICKED, LISTED = (4_096, 8_192), (2_048, 8_192), (512, 2_048)
#: Fields of which all patterns together are a short list.
SHORT = 4


@dataclass(frozen=True)
class Tiles:
    """Every left row beside every right row of its block, as tiles; ``carry`` are the columns that pairs keep when they become rows."""

    left: DataFrame
    right: DataFrame
    on: list[str]
    key: str
    carry: list[str]
    fields: list[Field] = field(default_factory=list)

    def rows(self) -> DataFrame:
        return with_levels(block_pairs(self.left, self.right, self.on, self.key), self.fields)

    def compared(self) -> list[tuple[str, str, float | None]]:
        return [(f"_left_{f.name}", f"_right_{f.name}", f.close) for f in self.fields]

    def search(self, size: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, also: tuple[str, ...] = ()) -> DataFrame:
        """``work`` on the rows of every tile of about ``size``; ``also`` are further columns of the left rows."""
        spark = self.left.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        parts = lambda df, n, name: df.groupBy(*[F.col(c).alias(c) for c in self.on]).agg(F.ceil(F.count("*") / n).cast("long").alias(name))
        counts = parts(self.left, size[0], "_lefts").join(parts(self.right, size[1], "_rights"), self.on)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        cell = [*self.on, "_i", "_j"]
        sides = []
        for df, side, mine, others, own, other in ((self.left, "left", "_lefts", "_rights", "_i", "_j"), (self.right, "right", "_rights", "_lefts", "_j", "_i")):
            kept = [c for c in dict.fromkeys([*self.carry, *(also if side == "left" else [])]) if c in df.columns and c not in self.on and (side == "left" or c not in self.left.columns)]
            texts = [f"_{side}_{f.name}" for f in self.fields]
            dealt = F.pmod(F.xxhash64(*([self.key] if side == "left" else kept), *texts), mine).alias(own)
            placed = df.join(counts, self.on).select(*self.on, *kept, *texts, dealt, every(others).alias(other))
            sides.append(placed.select(*[F.col(c).alias(c) for c in [*cell, *kept, *texts]]).repartition(tasks, *cell).groupBy(*cell))
        return sides[0].cogroup(sides[1]).applyInArrow(work, schema)


def block_pairs(left: DataFrame, right: DataFrame, on: list[str], key: str, carry: list[str] | None = None) -> DataFrame | Tiles:
    """Every left row beside every right row of its block; with ``carry`` they stay tiles.

    Pairs are many more than rows, so neither the size of the files nor that of a block says
    how many tasks they take: the left rows of a block are dealt by ``key`` into slices, the right rows
    come beside every slice, and slices are spread over a number of tasks that does not follow the bytes.
    """
    if carry is not None:
        return Tiles(left, right, on, key, carry)
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    slices = left.groupBy(*on).agg(F.ceil(F.count("*") / SLICE).cast("long").alias("_slices"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))
    one = left.join(slices, on).withColumn("_slice", F.pmod(F.xxhash64(key), "_slices")).drop("_slices")
    two = right.join(slices, on).withColumn("_slice", every).drop("_slices")
    cell = [*on, "_slice"]
    return one.repartition(tasks, *cell).join(two.repartition(tasks, *cell), cell).drop("_slice")


def agreement(field: Field, a: Column, b: Column) -> Column:
    """The level of a pair of cleaned texts."""
    out = F.when(a.isNull() | b.isNull(), MISSING).when(a == b, EQUAL)
    if field.close is not None:
        # the distance is at least the gap between the lengths: only texts that can be close are compared
        most, least = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
        out = out.when(1 - (most - least) / most < field.close, DIFFERENT)
        # counted no further than one above what is still close; -1 beyond that
        limit = F.floor(most * (1 - field.close)).cast("int") + 1
        distance = F.call_function("levenshtein", a, b, limit)
        out = out.when((distance >= 0) & (1 - distance / most >= field.close), CLOSE)
    return out.otherwise(DIFFERENT)


def cleaned(records: DataFrame, fields: list[Field], side: str) -> DataFrame:
    """Records of the ``left`` or ``right`` side with their fields as they are compared: trimmed and in lower case.

    Done before pairing, a text is cleaned once and not once per pair.
    """
    return records.withColumns({f"_{side}_{f.name}": F.lower(F.trim(nullif_blank(getattr(f, side)))) for f in fields})


def with_levels(pairs: DataFrame | Tiles, fields: list[Field]) -> DataFrame | Tiles:
    """``pairs`` with a column ``level_<name>`` per field; texts are compared trimmed and in lower case.

    Columns of ``cleaned`` are taken where the pairs have them. The levels of tiles are found where they are used.
    """
    if isinstance(pairs, Tiles):
        left, right = (cleaned(df, [f for f in fields if f"_{side}_{f.name}" not in df.columns], side) for df, side in ((pairs.left, "left"), (pairs.right, "right")))
        return replace(pairs, left=left, right=right, fields=fields)
    ready = pairs
    for side in ("left", "right"):
        ready = cleaned(ready, [f for f in fields if f"_{side}_{f.name}" not in pairs.columns], side)
    used = {f"_{side}_{f.name}" for side in ("left", "right") for f in fields}
    # plain columns, not a lambda: so the comparison stays compiled
    levels = [agreement(f, F.col(f"_left_{f.name}"), F.col(f"_right_{f.name}")).alias(f"level_{f.name}") for f in fields]
    return ready.select(*[c for c in pairs.columns if c not in used], *levels)


def pattern_counts(levels: DataFrame | Tiles, fields: list[Field]) -> DataFrame:
    """How often every pattern of levels occurs: a row per pattern, added up on the map side."""
    if isinstance(levels, Tiles):
        tiles = replace(levels, fields=fields, carry=[])
        compared, schema = tiles.compared(), pa.schema([("code", pa.int64()), ("n", pa.int64())])

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            return pa.table(list(map(pa.array, pt.count_patterns(pt.TileLevels(left, right, compared)))), schema=schema)

        sums = tiles.search(COUNTED, count, T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])).groupBy("code").agg(F.sum("n").alias("pairs"))
        digits = [(F.pmod(F.floor(F.col("code") / pt.BASE**i).cast("long"), F.lit(pt.BASE)) - 1).cast("int").alias(f"level_{f.name}") for i, f in enumerate(fields)]
        return sums.select(*digits, "pairs")
    return levels.groupBy(*[f"level_{f.name}" for f in fields]).agg(F.count("*").alias("pairs"))


@dataclass(frozen=True)
class Weights:
    """Shares of the levels among matches and among others, per field, and the share of matches."""

    matches: dict[str, dict[int, float]]
    others: dict[str, dict[int, float]]
    prior: float

    def weight(self, name: str, level: int) -> float:
        return 0.0 if level == MISSING else math.log2(self.matches[name][level] / self.others[name][level])


def fit_weights(patterns: list[tuple[tuple[int, ...], int]], fields: list[Field], prior: float = 0.1, rounds: int = 500, settled: float = 1e-9) -> Weights:
    """The most likely shares for counts of patterns, fields taken as independent inside matches and inside others.

    Starts from agreement being common among matches and rare among others, so that the group of agreeing
    pairs is the one called matches. Missing levels say nothing. No patterns give that start.
    """
    m = [{DIFFERENT: 0.05, CLOSE: 0.15, EQUAL: 0.8} for _ in fields]
    u = [{DIFFERENT: 0.8, CLOSE: 0.15, EQUAL: 0.05} for _ in fields]
    total, before = sum(n for _, n in patterns), math.inf
    for _ in range(rounds if total else 0):
        sums = [[{x: 0.0 for x in LEVELS} for _ in fields] for _ in (m, u)]
        matched, likelihood = 0.0, 0.0
        for pattern, n in patterns:
            p, q = prior, 1 - prior
            for i, level in enumerate(pattern):
                if level != MISSING:
                    p, q = p * m[i][level], q * u[i][level]
            share = p / (p + q)
            likelihood += n * math.log(p + q)
            matched += n * share
            for i, level in enumerate(pattern):
                if level != MISSING:
                    sums[0][i][level] += n * share
                    sums[1][i][level] += n * (1 - share)
        for side, counts in ((m, sums[0]), (u, sums[1])):
            for i, levels in enumerate(counts):
                known = sum(levels.values())
                if known > 0:
                    raised = {x: max(c / known, FLOOR) for x, c in levels.items()}
                    side[i] = {x: c / sum(raised.values()) for x, c in raised.items()}
        prior = min(max(matched / total, FLOOR), 1 - FLOOR)
        if abs(likelihood - before) <= settled * abs(likelihood):
            break
        before = likelihood
    names = [f.name for f in fields]
    return Weights(dict(zip(names, m, strict=True)), dict(zip(names, u, strict=True)), prior)


def fit(levels: DataFrame | Tiles, fields: list[Field], **options) -> Weights:
    """Weights from the pairs themselves; only the counts of patterns reach the driver."""
    rows = pattern_counts(levels, fields).collect()
    return fit_weights([(tuple(r[f"level_{f.name}"] for f in fields), r["pairs"]) for r in rows], fields, **options)


def value_shares(records: DataFrame, column: str) -> DataFrame:
    """(value, share) of every value of a column, trimmed and in lower case."""
    values = records.select(F.lower(F.trim(nullif_blank(column))).alias("value")).where("value IS NOT NULL")
    total = values.agg(F.count("*").alias("n"))
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    return counts.select("value", (F.col("n") / total.scalar()).alias("share"))


def with_share(rows: DataFrame, column: str, shares: DataFrame, output: str, where: Column | None = None) -> DataFrame:
    """Rows with the share of their value in ``shares``; null where it is not in there, or ``where`` does not hold."""
    known = shares.select(F.col("value").alias("_value"), F.col("share").alias(output))
    key = F.lower(F.trim(nullif_blank(column)))
    keyed = rows.withColumn("_key", key if where is None else F.when(where, key))
    return keyed.join(known, F.col("_key") == F.col("_value"), "left").drop("_key", "_value")


def _worth(fields: list[Field], weights: Weights, level: Callable[[Field], Column], share: Callable[[Field], Column | None]) -> list[Column]:
    """What each field adds to the weight of a pair."""
    parts = []
    for f in fields:
        plain = F.lit(0.0)
        for x in LEVELS:
            plain = F.when(level(f) == x, F.lit(weights.weight(f.name, x))).otherwise(plain)
        rarity = share(f)
        if rarity is not None:
            rare = F.log2(F.lit(weights.matches[f.name][EQUAL]) / rarity)
            plain = F.when(level(f) == EQUAL, F.greatest(plain, F.coalesce(rare, plain))).otherwise(plain)
        parts.append(plain)
    return parts


def _probability(weight: Column, weights: Weights) -> Column:
    odds = math.log2(weights.prior / (1 - weights.prior))
    return 1 / (1 + F.pow(F.lit(2.0), -(weight + F.lit(odds))))


def score(levels: DataFrame | Tiles, fields: list[Field], weights: Weights, shares: dict[str, DataFrame | str] | None = None, digits: int | None = None, best: int | None = None, order: str | None = None) -> DataFrame:
    """Pairs with ``match_weight`` (binary logarithm) and ``match_probability``, rounded to ``digits`` where given.

    ``shares`` has (value, share) per counted field, or names a column of ``levels`` with the share of the left
    value, looked up once per record by ``with_share`` and not once per pair; a value that is not in there, or more common
    than the share of equal pairs among others, is worth the plain weight. Shares are joined: whether a
    side is broadcast is Spark's size check, and skewed values are split by adaptive execution.

    Tiles give the columns that they carry. With ``best`` the pairs of a left row that cannot be among its so many best by weight, then
    by the right column ``order``, may be left out of them: for a selection that takes no more than these.
    """
    if isinstance(levels, Tiles):
        if len(fields) <= SHORT:
            return _tile_scores(levels, fields, weights, shares or {}, digits, best, order)
        levels = levels.rows()
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    held = {}
    for f in fields:
        if f.counted and shares and f.name in shares:
            held[f.name] = shares[f.name]
            if not isinstance(held[f.name], str):
                # only equal pairs look up their value; the others have none to join
                levels = with_share(levels, f.left, shares[f.name], name := f"_share_{f.name}", F.col(f"level_{f.name}") == EQUAL)
                held[f.name] = name
    parts = _worth(fields, weights, lambda f: F.col(f"level_{f.name}"), lambda f: F.col(held[f.name]) if f.name in held else None)
    weight = reduce(add, parts, F.lit(0.0))
    scored = levels.withColumn("match_weight", weight).drop(*[n for n in held.values() if n.startswith("_share_")])
    scored = scored.withColumn("match_probability", _probability(F.col("match_weight"), weights))
    return scored.withColumns({c: rounded(F.col(c)) for c in ("match_weight", "match_probability")}) if digits is not None else scored


def _tile_scores(tiles: Tiles, fields: list[Field], weights: Weights, shares: dict[str, DataFrame | str], digits: int | None, best: int | None, order: str | None) -> DataFrame:
    """Scores by what every pattern is worth: those that depend on a share are reckoned per left row, the others once."""
    left, held = tiles.left, {}
    for f in fields:
        if f.counted and f.name in shares:
            given = shares[f.name]
            if not isinstance(given, str):
                left, given = with_share(left, f.left, given, f"_share_{f.name}"), f"_share_{f.name}"
            held[f.name] = given
    patterns = list(product((MISSING, *LEVELS), repeat=len(fields)))
    code = lambda p: sum((x + 1) * pt.BASE**i for i, x in enumerate(p))
    own = [p for p in patterns if any(x == EQUAL and f.name in held for x, f in zip(p, fields, strict=True))]

    def worth(some: list[tuple[int, ...]], share: Callable[[Field], Column | None]) -> list[Column]:
        out = []
        for p in some:
            level = dict(zip([f.name for f in fields], p, strict=True))
            weight = reduce(add, _worth(fields, weights, lambda f: F.lit(level[f.name]), share), F.lit(0.0))
            out.append((weight, _probability(weight, weights)))
        turned = [F.array(*[c if digits is None else F.round(c, digits) for c in side]) for side in zip(*out, strict=True)]
        return turned or [F.array().cast("array<double>")] * 2

    no_share = lambda f: F.lit(None).cast("double") if f.name in held else None
    fixed = left.sparkSession.range(1).select(*worth(patterns, no_share)).first()
    plain = np.zeros((2, pt.BASE ** len(fields)))
    plain[:, [code(p) for p in patterns]] = np.array([fixed[0], fixed[1]])
    at = np.array([code(p) for p in own], np.int64)
    for name, column in zip(("_weights", "_probabilities"), worth(own, lambda f: F.col(held[f.name]) if f.name in held else None), strict=True):
        left = left.withColumn(name, column)
    tiles = replace(tiles, left=left, fields=fields)
    compared, carry = tiles.compared(), tiles.carry
    kinds = {c: (left if c in left.columns else tiles.right).schema[c].dataType for c in carry}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in carry], T.StructField("match_weight", T.DoubleType()), T.StructField("match_probability", T.DoubleType())])
    of_left = [c in left.columns for c in carry]

    def listed(one: pa.Table, two: pa.Table) -> pa.Table:
        if best is not None and order is not None:
            two = two.sort_by(order)
        held_by = [one.schema if mine else two.schema for mine in of_left]
        arrow = pa.schema([*[pa.field(c, s.field(c).type) for c, s in zip(carry, held_by, strict=True)], ("match_weight", pa.float64()), ("match_probability", pa.float64())])
        if not one.num_rows or not two.num_rows:
            return arrow.empty_table()
        levels = pt.TileLevels(one, two, compared)
        worths = []
        for side, name in enumerate(("_weights", "_probabilities")):
            table = np.tile(plain[side], (one.num_rows, 1))
            table[:, at] = one[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(one.num_rows, -1)
            worths.append(table)
        every, found = np.arange(two.num_rows), []
        for part in pt.chunks(one.num_rows, two.num_rows):
            codes = levels.codes(part, every)
            if best is None:
                i, j = np.repeat(np.arange(len(part)), len(every)), np.tile(every, len(part))
            else:
                i, j = pt.best_columns(codes, worths[0][part], best)
            place = part[i] * plain.shape[1] + codes[i, j] if best is not None else (part[:, None] * plain.shape[1] + codes).ravel()
            rows = [pa.array(part[i]), pa.array(j)]
            sides = [(one if mine else two)[c].take(rows[0 if mine else 1]) for c, mine in zip(carry, of_left, strict=True)]
            found.append(pa.table([*sides, *[pa.array(w.ravel()[place]) for w in worths]], schema=arrow))
        return pa.concat_tables(found)

    return tiles.search(LISTED if best is None else PICKED, listed, schema, ("_weights", "_probabilities"))
