"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue. Its documents are shuffled by a hash of their id, and a document
finishes at the virtual time *cumulative words of its source / target of its source*. The mix
is the sequence of all documents by virtual finish time, cut at the budget. A source whose
target exceeds its size goes through its queue again, at most ``max_repeats`` times.

Nothing needs one task for one source: running sums are taken per (source, slice of the
shuffle order) and moved by the sums of the slices before; the cut is found by histograms of
fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import staged, word_count

#: Bins of one histogram of virtual finish times; two levels are read, the rest is one bin of a bin.
BINS = 2000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Per source its rank, weight and target; ``sizes`` has (source, source_size).

    Sources by code point, null last, take the weights in turn. Targets share the sum of all
    sizes; none exceeds ``max_repeats`` times the size of its source, and what is cut there is
    shared by weight among the others (water filling: the level is the largest quotient
    *rest of the total / weight of the rest* that no later source exceeds).
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * F.lit(float(max_repeats))
    rows = ranked.withColumns({"weight": weight, "cap": cap}).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - before) / rest
    rows = rows.withColumn("level", level)
    fill = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    return rows.select("source", "source_size", "rank", F.least(F.col("weight") * fill, F.col("cap")).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: str = "") -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats) of every row of ``docs``.

    ``repeats`` says how often the mix takes the document, 0 to ``max_repeats``. A null text
    has no words and is taken zero times; null sources are one source, the last; a null id
    counts as an empty one in the shuffle. Repeated rows are documents of their own. Other
    columns are ignored. An empty table gives an empty result.
    """
    light = staged(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("turn"),
    ), "mix-sizes")
    targets = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    rows = light.withColumn("slice", F.substring("turn", 1, 3))
    inside = Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    rows = rows.withColumn("inside", F.sum("size").over(inside)).alias("r")
    s, t = slices.alias("s"), targets.alias("t")
    rows = (rows.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice")))
            .join(t, F.col("r.source").eqNullSafe(F.col("t.source"))))
    rows = staged(rows.select(
        "r.doc_id", "r.source", "r.size", "r.turn", "t.source_size", "t.target", "t.rank",
        (F.col("s.offset") + F.col("r.inside")).alias("reach"),
    ), "mix-queue")
    last = _cut(rows, max_repeats)
    taken = F.lit(0)
    if last is not None:
        for lap in range(1, max_repeats + 1):
            taken = taken + F.when((F.col("size") > 0) & (_key(lap) <= last), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("repeats"))


def _finish(lap: int) -> Column:
    return (F.col("reach") + F.col("source_size") * F.lit(lap - 1)) / F.col("target")


def _key(lap: int) -> Column:
    """The place of a document in the mix; a null id comes before all others."""
    return F.struct(_finish(lap).alias("finish"), F.col("rank"), F.col("turn"), F.col("doc_id"), F.col("size"), F.lit(lap).alias("lap"))


def _cut(rows: DataFrame, max_repeats: int) -> Column | None:
    """The key of the last document that fits the budget, the sum of all sizes; null if none does."""
    laps = F.array(*[_key(lap) for lap in range(1, max_repeats + 1)])
    queue = rows.where("size > 0").select(F.inline(laps))
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    low, width, base = 0.0, 1.0 / BINS, 0
    for _ in range(2):
        place = F.least(F.greatest(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(-1)), F.lit(10 * BINS))
        bins = sorted(queue.groupBy(place.alias("bin")).agg(F.sum("size").alias("words")).where("bin >= 0").collect())
        for number, words in bins:
            if base + words > budget:
                break
            base += words
        else:
            return _last(queue)
        queue = queue.where(place == number)
        low, width = low + number * width, width / BINS
    run = F.sum("size").over(Window.orderBy(*[F.asc_nulls_first(c) for c in queue.columns]).rowsBetween(Window.unboundedPreceding, 0))
    fits = queue.withColumn("run", run).where(F.col("run") + F.lit(base) <= budget).drop("run")
    inside = _last(fits)
    if inside is not None:
        return inside
    before = rows.where("size > 0").select(F.inline(laps)).where(F.col("finish") < F.lit(low))
    return _last(before)


def _last(queue: DataFrame) -> Column | None:
    found = queue.agg(F.max(F.struct(*queue.columns)).alias("m")).first()["m"]
    if found is None:
        return None
    kinds = dict(queue.dtypes)
    return F.struct(*[F.lit(found[c]).cast(kinds[c]).alias(c) for c in queue.columns])


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Rows of equal id, source and size are interchangeable in the mix: their repeats are
    gathered and dealt out among them, so the result has as many words as the mix takes.
    """
    doc_id, text, source = how.get("doc_id", "doc_id"), how.get("text", "text"), how.get("source", "source")
    plan = mix(docs, **how).groupBy(F.xxhash64("doc_id", "source", "size").alias("_key")).agg(
        F.sort_array(F.collect_list("repeats"), asc=False).alias("_laps"))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col(doc_id), F.col(source), word_count(F.col(text))).alias("_key"), F.xxhash64(text).alias("code"))
    number = F.row_number().over(Window.partitionBy("_key").orderBy("code"))
    numbered = rows.join(plan, "_key").select("doc", F.get("_laps", number - 1).alias("laps"))
    return numbered.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("laps")))).select("doc.*")
