"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks look at some of six neighbouring words and ignore the others. Benchmark and
document hashes under the same mask are joined; around each hit the two texts are laid side
by side, and a window of ``window`` words in which three quarters are equal is a leak. So a
passage is found although single words in it were replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import let
from plenum.llm.common import if_small, staged

#: 1 reads a word, 0 ignores it. Any three replacements in a window of twelve leave a hit under
#: one of the two (see the tests), so nothing that the window accepts goes unseen.
MASKS = ("11101", "100111")
#: Items of these numbers of words, compared whole, need more masks for that (see the tests).
SHORT_LENGTHS, SHORT_MASKS = (5, 8), ("1111", "10111", "11011")
#: Hashes of up to so many benchmark places (about 40 bytes each) are broadcast; beyond, both sides are shuffled.
BROADCAST_SEEDS = 500_000


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; marks between them do not count."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def _seeds(hashes: Column, masks: tuple[str, ...]) -> Column:
    """array<array<long>>: under every mask the hashes of all places of the text."""
    def under(h: Column, number: int, mask: str) -> Column:
        read = [j for j, c in enumerate(mask) if c == "1"]
        places = F.sequence(F.lit(0), F.size(h) - len(mask))
        seed = lambda i: F.xxhash64(F.lit(number), *[F.get(h, i + j) for j in read])
        return F.when(F.size(h) >= len(mask), F.transform(places, seed)).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, lambda h: F.array(*[under(h, n, m) for n, m in enumerate(masks)]))


def _exploded(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    seeds = rows.withColumn("_s", F.explode(_seeds(F.col("hashes"), masks)))
    return seeds.select("*", F.posexplode("_s").alias("place", "seed")).drop("_s", "hashes")


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
          window: int = 12, share: float = 0.75) -> DataFrame:
    """(doc_id, text_hash, item_id, start, end, matched, item_words): leaks of benchmark items in documents.

    One row per document and item: the alignment with most equal words; ``start`` and ``end``
    are the word numbers in the document of the aligned item. Items of fewer than ``window``
    words are compared whole, those of under five words and null texts never match. Equal
    items leak together; rows that repeat id and text give one row. Other columns are ignored.
    """
    tests = staged(benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("hashes")).where(F.size("hashes") >= 5).withColumn(
        "item", F.xxhash64("hashes")), "benchmark-words")
    items = tests.dropDuplicates(["item"]).select("item", "hashes")
    short = not items.where(F.size("hashes").isin(*SHORT_LENGTHS)).isEmpty()
    masks = MASKS + SHORT_MASKS if short else MASKS
    seeds = staged(_exploded(items, masks).select("seed", "item", F.col("place").alias("item_place")).distinct(), "benchmark-seeds")
    few = seeds.count() <= BROADCAST_SEEDS
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    places = _exploded(rows.select("doc_id", "text_hash", word_hashes(F.col("text")).alias("hashes")), masks)
    hits = places.join(F.broadcast(seeds) if few else seeds, "seed")
    found = staged(hits.select("doc_id", "text_hash", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "leak-candidates")
    f = found.alias("f")
    joined = rows.alias("d").join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")))
    aligned = joined.select("d.doc_id", "d.text_hash", "f.item", "f.shift", word_hashes(F.col("d.text")).alias("own")).join(items, "item")
    equal = F.transform("hashes", lambda x, j: F.when(F.get("own", F.when(j + F.col("shift") >= 0, j + F.col("shift"))) == x, 1).otherwise(0))
    checked = aligned.select("doc_id", "text_hash", "item", "shift", F.size("hashes").alias("item_words"), equal.alias("equal"))
    span = F.least(F.lit(window), F.col("item_words"))
    sums = F.transform(F.sequence(F.lit(0), F.col("item_words") - span), lambda i: F.aggregate(F.slice("equal", i + 1, span), F.lit(0), lambda a, x: a + x))
    total = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    good = checked.select("doc_id", "text_hash", "item", "shift", "item_words", total.alias("matched"), (F.array_max(sums) >= F.ceil(span * F.lit(share))).alias("leak")).where("leak")
    best = good.groupBy("doc_id", "text_hash", "item").agg(F.min_by(F.struct("shift", "matched", "item_words"), F.struct(-F.col("matched"), F.col("shift"))).alias("b"))
    out = best.join(tests.select("item", "item_id").distinct(), "item")
    return out.select("doc_id", "text_hash", "item_id", F.greatest("b.shift", F.lit(0)).alias("start"), (F.col("b.shift") + F.col("b.item_words")).alias("end"), "b.matched", "b.item_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item leaks."""
    doc_id, text = how.get("doc_id", "doc_id"), how.get("text", "text")
    bad = staged(leaks(docs, benchmark, **how).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaking-documents")
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_code"))
    return rows.join(if_small(bad), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_code") == F.col("_hash")), "left_anti").select("doc.*")
