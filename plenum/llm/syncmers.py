"""Document fingerprints of closed syncmers, in DataFrame functions only.

Words are hashed; a run of ``k`` words is an anchor when the smallest of its inner word
hashes stands at either edge. Whether a run is an anchor depends on the run alone, so two
documents choose the same anchors in every passage that they share, wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import let
from plenum.llm.common import SPACE, staged


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    return F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def anchors(text: Column, k: int = 5) -> Column:
    """array<int>: the distinct anchors of a text by first place.

    A text of fewer than ``k`` words, or without any anchor, has one: all its words. An empty
    text has none.
    """
    def choose(h: Column) -> Column:
        def run(i: Column) -> list[Column]:
            return [F.get(h, i + j) for j in range(k)]

        def at_edge(i: Column) -> Column:
            return let(F.least(*run(i)), lambda low: (low == F.get(h, i)) | (low == F.get(h, i + (k - 1))))

        places = F.when(F.size(h) >= k, F.filter(F.sequence(F.lit(0), F.size(h) - k), at_edge)).otherwise(F.array().cast("array<int>"))
        return let(F.array_distinct(F.transform(places, lambda i: F.hash(*run(i)))), lambda found: F.when(
            (F.size(found) == 0) & (F.size(h) > 0), F.array(F.hash(h))).otherwise(found))

    return let(word_hashes(text), choose)


def anchor_places(text: Column, k: int = 5) -> Column:
    """array<struct(anchor, place)>: every anchor with the number of its first word, for positional matching."""
    def choose(h: Column) -> Column:
        def run(i: Column) -> list[Column]:
            return [F.get(h, i + j) for j in range(k)]

        places = F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - k)).otherwise(F.array().cast("array<int>"))
        kept = F.filter(places, lambda i: let(F.least(*run(i)), lambda low: (low == F.get(h, i)) | (low == F.get(h, i + (k - 1)))))
        return F.transform(kept, lambda i: F.struct(F.hash(*run(i)).alias("anchor"), i.alias("place")))

    return let(word_hashes(text), choose)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints; two empty ones are alike, an empty and another are not."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(
        both / (F.size(a) + F.size(b) - both)))


def as_text(fingerprint: Column) -> Column:
    """Eight hex digits per anchor."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def followers(keys: DataFrame) -> DataFrame:
    """(doc_id, hash, n_chars, next_id, next_hash): each document and the next by descending id.

    Equal ids go by hash, null ids stand last, the last is followed by the first. Keys are
    range partitioned; only the first key of each range is looked at across ranges.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("hash")]
    ranged = staged(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "key-ranges")
    inside = Window.partitionBy("part").orderBy(*order)
    here = F.struct("doc_id", "hash")
    rows = ranged.select("*", F.lead(here).over(inside).alias("after"), F.row_number().over(inside).alias("nth"))
    firsts = rows.where("nth = 1").select("part", here.alias("first"))
    across = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(across), F.first("first").over(whole)).alias("follow"))
    follow = F.coalesce(F.col("after"), F.col("follow"))
    return rows.join(firsts, "part").select("doc_id", "hash", "n_chars", follow["doc_id"].alias("next_id"), follow["hash"].alias("next_hash"))


def edited_pairs(docs: DataFrame, k: int = 5, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, anchors, edited_anchors, next_anchors) of every row of ``docs``.

    ``edited`` is the text whose last third is replaced by the start of the next document. A
    null text is empty. Rows that repeat id and text count as one document and share their
    result. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("hash"), body.alias("text"))
    keys = rows.groupBy("doc_id", "hash").agg(F.max(F.length("text")).alias("n_chars"), F.count("*").alias("copies"))
    keys = staged(keys, "document-keys")
    repeated = keys.agg(F.max("copies")).first()[0] or 1
    pairs = staged(followers(keys.drop("copies")), "document-pairs")
    asks = pairs.select("next_id", "next_hash", F.col("doc_id").alias("own_id"), F.col("hash").alias("own_hash"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    given = rows.join(asks, rows["doc_id"].eqNullSafe(asks["next_id"]) & (rows["hash"] == asks["next_hash"])).select(
        "own_id", "own_hash", F.substring("text", F.lit(1), F.col("need")).alias("head"), anchors(F.col("text"), k).alias("next_anchors"))
    if repeated > 1:
        given = given.dropDuplicates(["own_id", "own_hash"])
    joined = rows.join(given, rows["doc_id"].eqNullSafe(given["own_id"]) & (rows["hash"] == given["own_hash"]))
    size = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), size - F.floor(size / 3).cast("int")), "head")
    return joined.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), anchors(F.col("text"), k).alias("anchors"), "next_anchors").select(
        "*", anchors(F.col("edited"), k).alias("edited_anchors"))
