"""Record matching: blocked vector search, selection, calibration and match records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import fixed
from plenum.functions.names import is_municipal
from plenum.functions.text import _col, nullif_blank
from plenum.operators.ranking import top_n

#: Bytes of the vectors of a tile of queries. Candidates pass it in batches; their tile is at most ``STRIPE`` times as long.
TILE_BYTES, STRIPE = 32 << 20, 4
#: Tiles are not cut smaller than to so many pairs, and not to fewer rows.
LEAST_PAIRS, LEAST_ROWS = 1 << 28, 1_024
#: Scores that are looked at together, and candidates among them: a megabyte or eight.
CHUNK, WIDTH = 1 << 20, 2_048
DIGITS = 9
#: Scores this far apart cannot be equal when rounded.
SLACK = 2e-9


@dataclass(frozen=True)
class Pair:
    """What decides besides the vectors whether and how high a pair ranks.

    ``same_id`` keeps pairs of one id; ``not_before`` names (query, candidate) date columns;
    ``allowed`` names (query bit mask, candidate bit); ``boost`` names (query text, candidate
    text, amount): the candidate text must contain the query text.
    """

    same_id: bool = True
    not_before: tuple[str, str] | None = None
    allowed: tuple[str, str] | None = None
    boost: tuple[str, str, float] | None = None
    query_columns: list[str] = field(init=False, default_factory=list)
    candidate_columns: list[str] = field(init=False, default_factory=list)

    def __post_init__(self) -> None:
        for rule in (self.not_before, self.allowed, self.boost):
            if rule:
                self.query_columns.append(rule[0])
                self.candidate_columns.append(rule[1])


def block_topk(
    queries: DataFrame,
    candidates: DataFrame,
    on: list[str],
    k: int,
    query_id: str = "query_id",
    candidate_id: str = "candidate_id",
    query_vector: str = "query_vector",
    candidate_vector: str = "candidate_vector",
    metric: str = "cosine",
    pair: Pair = Pair(),
    query_tile: int | None = None,
    candidate_tile: int | None = None,
) -> DataFrame:
    """The exact ``k`` nearest candidates of every query inside its block.

    A block is cut into query tiles times candidate tiles; one task group holds a query tile,
    multiplies it with the candidates that pass it in batches, and hands on at most ``k`` rows per query. So pairs are
    never rows, and a block holding a third of the table is many groups. Candidates are shuffled once per
    query tile and queries once per candidate tile, so tiles are as large as they can be: a query tile has
    at most as many rows as fit ``TILE_BYTES`` at the length of the first vector, so memory grows neither with the block nor
    with the dimension, and both are cut smaller only until there is work for all cores (unless rows are given).
    The tile lists are a row per block: the join with them is left to adaptive
    execution, which checks their size before broadcasting and splits skewed blocks otherwise.

    Scores are rounded before ranking, so ties fall to the smaller id whatever the tile shape.
    ``cosine`` keeps similarities above 0, best first; ``l2`` gives squared distances.
    """
    # fresh names on both sides: queries and candidates may be the same table
    q = queries.select(
        *[F.col(c).alias(c) for c in on], F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"), *[F.col(c).alias(c) for c in pair.query_columns]
    ).where(F.col("vector").isNotNull())
    c = candidates.select(
        *[F.col(c).alias(c) for c in on], F.col(candidate_id).alias("candidate_id"), F.col(candidate_vector).alias("vector"), *[F.col(c).alias(c) for c in pair.candidate_columns]
    ).where(F.col("vector").isNotNull())

    def block_counts(df: DataFrame, name: str) -> DataFrame:
        # counted without looking at the vectors, so this scan reads the block columns only
        return df.groupBy(*[F.col(b).alias(b) for b in on]).agg(F.count("*").alias(name))

    context = queries.sparkSession.sparkContext
    counts = block_counts(queries, "_n").join(block_counts(candidates, "_m"), on)
    q_size, c_size, total = F.lit(query_tile), F.lit(candidate_tile), 0.0
    if query_tile is None or candidate_tile is None:
        first = c.select(F.size("vector")).first()
        rows = max(64, TILE_BYTES // (4 * max(first[0], 1))) if first else 64
        total = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0.0
        pairs = max(total / (8 * context.defaultParallelism), LEAST_PAIRS)
        # tiles of as many queries as candidates are shuffled least; a short side of a block makes the other tile longer
        fitted = lambda other, most: F.least(F.greatest(F.floor(F.lit(float(pairs)) / other), F.lit(LEAST_ROWS)), F.lit(most))
        q_size = fitted(F.least(F.col("_m"), F.lit(float(pairs) ** 0.5)), rows) if query_tile is None else q_size
        c_size = fitted(F.least(F.col("_n"), q_size), STRIPE * rows) if candidate_tile is None else c_size
    whole = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    tiles = counts.withColumn("_q_tiles", whole("_n", q_size)).withColumn("_c_tiles", whole("_m", c_size)).drop("_n", "_m")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(tiles, on).withColumn("_qt", F.pmod(F.xxhash64("query_id"), "_q_tiles")).withColumn("_ct", every("_c_tiles"))
    c = c.join(tiles, on).withColumn("_ct", F.pmod(F.xxhash64("candidate_id"), "_c_tiles")).withColumn("_qt", every("_q_tiles"))
    cell = [*on, "_qt", "_ct"]
    id_types = (q.schema["query_id"].dataType, c.schema["candidate_id"].dataType)
    schema = T.StructType(
        [
            T.StructField("query_id", id_types[0]),
            T.StructField("candidate_id", id_types[1]),
            T.StructField("score", T.DoubleType()),
        ]
    )
    fresh = [F.col(name).cast("long" if name in ("_qt", "_ct") else tiles.schema[name].dataType).alias(name) for name in cell]
    asked = q.select(*fresh, F.lit(0).alias("_side"), F.col("query_id").alias("_q_query_id"), "vector", *[F.col(x).alias(f"_q_{x}") for x in pair.query_columns])
    given = c.select(*fresh, F.lit(1).alias("_side"), F.col("candidate_id").alias("_c_candidate_id"), "vector", *[F.col(x).alias(f"_c_{x}") for x in pair.candidate_columns])
    # the bytes of little work say how many tasks it takes, those of much work do not
    tasks = [max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)] if total > 8 * LEAST_PAIRS else []
    # the queries of a cell come first, then its candidates by id
    both = asked.unionByName(given, allowMissingColumns=True).repartition(*tasks, *cell).sortWithinPartitions(*cell, "_side", "_c_candidate_id")
    best = both.groupBy(*cell).applyInArrow(_stream_search(k, metric, pair, _arrow_schema(schema)), schema)
    ascending = metric == "l2"
    order = [F.col("score") if ascending else F.desc("score"), F.col("candidate_id")]
    return top_n(best, ["query_id"], order, k)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema.fields])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1).astype(np.float64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """The rows at unit length, in place."""
    sizes = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    sizes[sizes == 0] = 1.0
    matrix /= sizes
    return matrix


def _first_k(costs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` smallest finite costs of every row; ties go to the left column."""
    limit = np.partition(costs, k - 1, axis=1)[:, k - 1 : k] if costs.shape[1] > k else np.inf
    rows, columns = np.nonzero((costs <= limit) & np.isfinite(costs))
    order = np.lexsort((columns, costs[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, np.arange(len(costs)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], columns[keep]


def _merge_k(one: tuple, two: tuple, k: int, n: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The ``k`` smallest costs of every row from two lists of (row, column, cost), and the ``k``-th cost of each of ``n`` rows."""
    rows, columns, costs = (np.concatenate(x) for x in zip(one, two, strict=True))
    order = np.lexsort((columns, costs, rows))
    rows, columns, costs = rows[order], columns[order], costs[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
    bound = np.full(n, np.inf)
    last = place == k - 1
    bound[rows[last]] = costs[last]
    keep = place < k
    return (rows[keep], columns[keep], costs[keep]), bound


def _products(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of pairs of rows."""
    out, step = np.empty(len(i)), max(1, CHUNK // max(left.shape[1], 1))
    for low in range(0, len(i), step):
        part = slice(low, low + step)
        out[part] = np.einsum("ij,ij->i", left[i[part]], right[j[part]])
    return out


class _Search:
    """The nearest candidates of some queries; candidates are added in the order of their ids."""

    def __init__(self, k: int, metric: str, pair: Pair, q: pa.Table) -> None:
        self.k, self.pair, self.ascending = k, pair, metric == "l2"
        self.q, self.ids = q.drop_columns("vector"), q["query_id"].to_numpy()
        flat = q["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        # doubles are made for few rows at a time
        self.left = flat.reshape(q.num_rows, -1)
        self.first = q[pair.not_before[0]].to_numpy() if pair.not_before else None
        self.mask = q[pair.allowed[0]].to_numpy() if pair.allowed else None
        step = max(1, CHUNK // WIDTH)
        self.parts = [np.arange(start, min(start + step, q.num_rows)) for start in range(0, q.num_rows, step)]
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(self.parts)
        self.bound = [np.full(len(part), np.inf) for part in self.parts]
        self.found: list[pa.Array] = []
        self.seen = 0

    def add(self, c: pa.Table) -> None:
        pair, ascending, k = self.pair, self.ascending, self.k
        names = c[pair.boost[1]].combine_chunks() if pair.boost else None
        contains: dict[str, np.ndarray] = {}
        c_ids = c["candidate_id"].to_numpy()
        day = c[pair.not_before[1]].to_numpy() if pair.not_before else None
        bit = c[pair.allowed[1]].to_numpy() if pair.allowed else None

        def usable(costs: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            """Whether pairs may rank, for indexes that fit ``costs``: all of a chunk, or single pairs."""
            good = np.isfinite(costs)
            if not ascending:
                good &= costs < 0
            if not pair.same_id:
                good &= self.ids[rows] != c_ids[columns]
            if pair.not_before:
                good &= day[columns] >= self.first[rows]
            if pair.allowed:
                good &= (bit[columns] & self.mask[rows]) != 0
            return good

        # ranked ascending: a similarity is negated, what must not rank is infinite
        rank = lambda scores: np.round(scores if ascending else -scores, DIGITS)
        for begin in range(0, c.num_rows, WIDTH):
            columns = np.arange(begin, min(begin + WIDTH, c.num_rows))
            right = _matrix(c["vector"].slice(begin, WIDTH))
            right = right if ascending else _unit(right)
            right_sizes = (right * right).sum(axis=1)
            for at_part, part in enumerate(self.parts):
                left = self.left[part].astype(np.float64)
                left = left if ascending else _unit(left)
                if not (ascending or pair.boost) and np.isfinite(self.bound[at_part]).all():
                    # products of floats tell which pairs may come before the k-th found; those are measured in doubles
                    rough = left.astype(np.float32) @ right.astype(np.float32).T
                    least = -self.bound[at_part] - SLACK - (left.shape[1] + 16) * float(np.finfo(np.float32).eps)
                    found = np.flatnonzero(rough >= np.nextafter(least.astype(np.float32), np.float32(-2))[:, None])
                    if len(found) * 16 <= rough.size:
                        rows, at = np.divmod(found, len(columns))
                        costs = rank(_products(left, right, rows, at))
                        keep = (costs < self.bound[at_part][rows]) & usable(costs, part[rows], columns[at])
                        self._merge(at_part, rows[keep], columns[at[keep]], costs[keep])
                        continue
                scores = left @ right.T
                if ascending:
                    scores = np.maximum((left * left).sum(axis=1)[:, None] + right_sizes[None, :] - 2.0 * scores, 0.0)
                for i, needle in enumerate(self.q[pair.boost[0]].slice(part[0], len(part)).to_pylist() if pair.boost else []):
                    if not needle:
                        continue
                    if needle not in contains:
                        contains[needle] = pc.match_substring(names, needle).to_numpy(zero_copy_only=False).astype(bool)
                    hit = np.flatnonzero(contains[needle][columns])
                    scores[i, hit] = np.minimum(1.0, scores[i, hit] + pair.boost[2])
                # candidates come by id, so one that only equals the k-th found so far is behind it
                bound = self.bound[at_part]
                near = scores <= bound[:, None] + SLACK if ascending else scores >= -bound[:, None] - SLACK
                if np.count_nonzero(near) * 16 > near.size:
                    costs = rank(scores)
                    costs[~usable(costs, part[:, None], columns[None, :])] = np.inf
                    rows, at = _first_k(costs, k)
                    costs = costs[rows, at]
                else:
                    rows, at = np.nonzero(near)
                    costs = rank(scores[rows, at])
                    keep = (costs < bound[rows]) & usable(costs, part[rows], columns[at])
                    rows, at, costs = rows[keep], at[keep], costs[keep]
                self._merge(at_part, rows, columns[at], costs)
        self.found.extend(c["candidate_id"].chunks)
        self.seen += c.num_rows

    def _merge(self, at_part: int, rows: np.ndarray, columns: np.ndarray, costs: np.ndarray) -> None:
        if len(rows):
            self.best[at_part], self.bound[at_part] = _merge_k(self.best[at_part], (rows, self.seen + columns, costs), self.k, len(self.parts[at_part]))

    def result(self, schema: pa.Schema) -> pa.Table:
        if not self.seen or not self.parts:
            return schema.empty_table()
        rows = np.concatenate([part[best[0]] for part, best in zip(self.parts, self.best, strict=True)])
        at, costs = (np.concatenate([best[x] for best in self.best]) for x in (1, 2))
        return pa.table(
            {
                "query_id": self.q["query_id"].take(pa.array(rows)),
                "candidate_id": pa.chunked_array(self.found).take(pa.array(at)),
                "score": pa.array((costs if self.ascending else -costs).astype(np.float64)),
            }
        ).cast(schema)


def _tile_search(k: int, metric: str, pair: Pair, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Search of one tile pair: matrix products and a partial sort per query."""

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return schema.empty_table()
        found = _Search(k, metric, pair, q)
        found.add(c.sort_by("candidate_id"))
        return found.result(schema)

    return search


def _stream_search(k: int, metric: str, pair: Pair, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same where queries, then candidates by id come in batches; only the queries are held."""

    def side(batch: pa.RecordBatch, mark: str) -> pa.Table:
        names = ["vector", *[c for c in batch.schema.names if c.startswith(mark)]]
        return pa.Table.from_batches([batch.select(names).rename_columns([c.removeprefix(mark) for c in names])])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found = [], None
        for batch in batches:
            cut = int(np.searchsorted(batch.column("_side").to_numpy(), 1))
            if cut:
                if found is not None:
                    raise ValueError("queries behind candidates")
                asked.append(side(batch.slice(0, cut), "_q_"))
            if cut < batch.num_rows and (asked or found is not None):
                if found is None:
                    found, asked = _Search(k, metric, pair, pa.concat_tables(asked)), []
                found.add(side(batch.slice(cut), "_c_"))
        if found is not None:
            yield from found.result(schema).combine_chunks().to_batches()

    return search


RACE_BLOCK = ["election_date", "state", "election_type"]
TYPE_BITS = {"primary": 1, "general": 2, "runoff": 4}


def _type_bit(election_type: str) -> Column:
    bits = [F.when(F.col(election_type) == t, F.lit(b)) for t, b in TYPE_BITS.items()]
    return F.coalesce(*bits, F.lit(0)).cast("long")


def direct_candidates(candidates: DataFrame, results: DataFrame, k: int = 10, **ids: str) -> DataFrame:
    """Same date, state and election type; runoffs and records without a state are not here."""
    with_state = candidates.where(nullif_blank("state").isNotNull() & (F.col("election_type") != "runoff"))
    found = block_topk(with_state, results, RACE_BLOCK, k, **ids)
    return found.withColumn("match_source", F.lit("direct"))


def stateless_candidates(candidates: DataFrame, results: DataFrame, k: int = 10, **ids: str) -> DataFrame:
    """Records without a state are searched in all states of their date and type."""
    no_state = candidates.where(nullif_blank("state").isNull() & (F.col("election_type") != "runoff"))
    found = block_topk(no_state, results, ["election_date", "election_type"], k, **ids)
    return found.withColumn("match_source", F.lit("stateless_fallback"))


def runoff_base(candidates: DataFrame) -> DataFrame:
    """Runoff records with the date their search starts from."""
    runoffs = candidates.where((F.col("election_type") == "runoff") & nullif_blank("state").isNotNull())
    base = F.coalesce("general_election_date", "primary_election_date", "election_date")
    return runoffs.withColumn("base_date", base).where("base_date is not null")


def runoff_candidates(candidates: DataFrame, results: DataFrame, k: int = 10, **ids: str) -> DataFrame:
    """Results of the state from the base date on, of the types that the base date suggests.

    What was held on the base date is a small aggregate per state and date. The date range is
    cut by year: a query is sent to the years of its state that can hold a hit, which turns
    the range into an equi-join on state and year.
    """
    held = results.groupBy(F.col("state"), F.col("election_date").alias("base_date")).agg(
        F.bool_or(F.col("election_type") == "general").alias("_general"),
        F.bool_or(F.col("election_type") == "primary").alias("_primary"),
    )
    allowed = (
        F.when(F.col("_general"), TYPE_BITS["general"] | TYPE_BITS["runoff"])
        .when(F.col("_primary"), TYPE_BITS["primary"] | TYPE_BITS["runoff"])
        .otherwise(sum(TYPE_BITS.values()))
    )
    queries = (
        runoff_base(candidates)
        .join(held, ["state", "base_date"], "left")
        .withColumn("allowed_types", allowed.cast("long"))
        .withColumn("base_day", F.unix_date("base_date").cast("long"))
    )
    ranged = (
        results.where(F.col("election_type").isin(*TYPE_BITS))
        .withColumn("type_bit", _type_bit("election_type"))
        .withColumn("day", F.unix_date("election_date").cast("long"))
        .withColumn("year", F.year("election_date"))
    )
    # a row per state with its years: bounded by the calendar
    years = ranged.groupBy("state").agg(F.sort_array(F.collect_set("year")).alias("_years"))
    spread = queries.join(years, "state").withColumn(
        "year", F.explode(F.filter("_years", lambda y: y >= F.year("base_date")))
    )
    rule = Pair(not_before=("base_day", "day"), allowed=("allowed_types", "type_bit"))
    found = block_topk(spread, ranged, ["state", "year"], k, pair=rule, **ids)
    return found.withColumn("match_source", F.lit("date_range_runoff"))


def race_candidates(candidates: DataFrame, results: DataFrame, k: int = 10, **ids: str) -> DataFrame:
    """Ranked result records for every candidate record, by the path that applies to it."""
    return (
        direct_candidates(candidates, results, k, **ids)
        .unionByName(stateless_candidates(candidates, results, k, **ids))
        .unionByName(runoff_candidates(candidates, results, k, **ids))
    )


def split_by_level(df: DataFrame, level: str = "office_level") -> tuple[DataFrame, DataFrame]:
    """Records to match, and records settled by their office level.

    The split is a filter in front of the vector work, so settled rows never reach it.
    """
    settled = F.upper(nullif_blank(F.col(level))).isin("FEDERAL", "STATE")
    settled = F.coalesce(settled, F.lit(False))
    name = F.initcap(F.lower(nullif_blank(F.col(level))))
    marker = F.concat(F.upper(nullif_blank(F.col(level))), F.lit("_RACE"))
    done = (
        df.where(settled)
        .withColumn("has_match", F.lit(False))
        .withColumn("confidence", F.lit(100.0))
        .withColumn("reason", F.concat(name, F.lit(" race (pre-filtered by office_level field)")))
        .withColumn("matched_race_name", marker)
        .withColumn("top_candidates", marker)
    )
    return df.where(~settled), done


def lexical_score(left: Column, right: Column, same_state: Column | None = None) -> Column:
    """Default scorer, 0 to 100: edit similarity of the lower-cased texts, halved across states."""
    a, b = F.lower(F.coalesce(left, F.lit(""))), F.lower(F.coalesce(right, F.lit("")))
    longest = F.greatest(F.length(a), F.length(b))
    score = F.when(longest > 0, (F.lit(1.0) - F.levenshtein(a, b) / longest) * 100).otherwise(0.0)
    if same_state is not None:
        score = F.when(F.coalesce(same_state, F.lit(False)), score).otherwise(score / 2)
    return F.round(score, 4)


def select_candidate(
    ranked: DataFrame, score: Column, keys: list[str], carry: list[str], n_alternatives: int = 3
) -> DataFrame:
    """The best scored candidate per record, its list position, and the runners-up.

    ``ranked`` holds at most ``k`` rows per record, so the lists stay small. A user scorer is
    a column too: compute it before with ``mapInPandas`` and pass its column here.
    """
    scored = ranked.withColumn("_score", score)
    best = F.struct(F.col("_score").alias("s"), (-F.col("rank")).alias("r"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("_score")).alias("s"), F.col("rank").alias("rank"))))
    others = F.transform(F.slice(listed, 2, n_alternatives), lambda x: x["rank"])
    return scored.groupBy(*keys).agg(
        F.max_by("rank", best).alias("best_match"),
        F.max("_score").alias("confidence"),
        F.count("*").alias("n_candidates"),
        others.alias("alternatives"),
        *[F.max_by(c, best).alias(c) for c in carry],
    )


def calibrate(
    confidence: Column | str, first: Column | str, last: Column | str, matched_name: Column | str
) -> Column:
    """Confidence after the name checks; parts are tested by substring, so an empty part hits."""
    given = _col(confidence)
    f = F.trim(F.lower(F.coalesce(_col(first), F.lit(""))))
    l = F.trim(F.lower(F.coalesce(_col(last), F.lit(""))))  # noqa: E741
    m = F.lower(F.coalesce(_col(matched_name), F.lit("")))
    male, female = "|".join(fixed.MALE_NAMES), "|".join(fixed.FEMALE_NAMES)
    clash = (f.rlike(male) & m.rlike(female)) | (f.rlike(female) & m.rlike(male))
    after = F.when(clash, F.greatest(F.lit(0), given - 25)).otherwise(given)
    has_first, has_last = m.contains(f), m.contains(l)
    penalty = F.when(~has_first & ~has_last, 15).when(~has_first | ~has_last, 8).otherwise(0)
    after = F.when(penalty > 0, F.greatest(F.lit(0), after - penalty)).otherwise(after)
    return F.when(given == 0, given).otherwise(after)


def accept(confidence: Column | str, threshold: float | Column = 70) -> Column:
    return F.coalesce(_col(confidence) >= threshold, F.lit(False))


def district_threshold(office: Column | str, city: Column | str) -> Column:
    """70 for a municipal office without a city, else 60."""
    generic = is_municipal(office) & nullif_blank(city).isNull()
    return F.when(generic, 70).otherwise(60)


def candidate_list_json(ranked: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The ranked list of each record as one JSON text (at most ``k`` entries)."""
    entry = F.struct("rank", *columns)
    return ranked.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("top_candidates"))


def match_statistics(matches: DataFrame) -> DataFrame:
    race = F.col("matched_race_name")
    return matches.agg(
        F.count("*").alias("total_records"),
        F.count_if("has_match").alias("local_matches"),
        F.count_if(race == "FEDERAL_RACE").alias("federal_races"),
        F.count_if(race == "STATE_RACE").alias("state_races"),
        (
            F.count("*") - F.count_if("has_match") - F.count_if(race == "FEDERAL_RACE") - F.count_if(race == "STATE_RACE")
        ).alias("no_match"),
        *[
            F.count_if(F.col("match_source") == s).alias(f"{s}_records")
            for s in ("direct", "date_range_runoff", "stateless_fallback")
        ],
        F.avg(F.when(F.col("has_match"), F.col("confidence"))).alias("average_confidence"),
    )


def confidence_buckets(matches: DataFrame, name: str = "district_name") -> DataFrame:
    """Matches by confidence, no matches and errors."""
    bucket = (
        F.when(F.col("is_matched") & (F.col("confidence") > 80), "high")
        .when(F.col("is_matched") & (F.col("confidence") > 60), "medium")
        .when(F.col("is_matched"), "low")
        .when(F.col(name).isin("NOT_MATCHED", "NO_VECTOR_STORE"), "no_match")
        .otherwise("error")
    )
    return matches.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def state_match_rates(matches: DataFrame, matched: str = "is_matched") -> DataFrame:
    return matches.groupBy("state").agg(
        F.count("*").alias("records"),
        F.count_if(matched).alias("matched"),
        F.try_divide(F.count_if(matched), F.count("*")).alias("match_rate"),
        F.avg(F.when(F.col(matched), F.col("confidence"))).alias("average_confidence"),
    )


def missing_keys(left: DataFrame, right: DataFrame, key: str = "state") -> DataFrame:
    """Keys in use that have no reference data."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")
