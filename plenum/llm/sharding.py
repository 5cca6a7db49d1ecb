"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups of equal texts are packed whole. Small groups first join parcels by the hash of their
text; a group above a 64th of a shard is a parcel of its own; one above half a shard is dealt
out in pieces, since no shard could hold it beside an equal share of the rest. The number of
parcels is bounded by ``shards`` alone, so the packing itself is a small table whatever the
input: each parcel, the largest first, goes where the dot product of its demand with the
residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import staged, word_count

#: Parcels of small groups per shard, and the shares of a shard above which a group is on its own or cut.
PARCELS, LARGE, CUT = 512, 1 / 64, 0.5
#: What bytes, tokens and rows count in the dot product: bytes lead, so that sizes come out nearly equal.
WEIGHTS = (1.0, 0.1, 0.1)


def pack(demand: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of every row of ``demand`` (parcels x dimensions).

    Demands are counted in weighted shares of a shard's capacity. Ties go to the lowest shard.
    """
    total = demand.sum(axis=0)
    share = demand * shards / np.where(total > 0, total, 1)
    residual, weighted = np.ones((shards, demand.shape[1])), share * np.array(weights)
    out = np.zeros(len(demand), dtype=np.int64)
    for i in np.lexsort((np.arange(len(share)), -weighted.sum(axis=1))):
        best = int(np.argmax(residual @ weighted[i]))
        out[i] = best
        residual[best] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, tokens, text_crc32, text_hash, shard, slot) of every row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 16, ``slot`` numbers the rows of a shard
    without gaps. Null and empty texts are one group of size 16 per row. Repeated rows get
    slots of their own; a null id comes first. Other columns are ignored. Empty in, empty out.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    light = staged(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), word_count(body).alias("tokens"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("text_hash"),
    ), "shard-sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = light.agg(*sums).first()
    capacity = {c: max(total[c] or 0, 1) / shards for c in ("bytes", "tokens", "rows")}
    fill = F.greatest(*[F.col(c) / F.lit(capacity[c]) for c in capacity])
    pieces = F.when(fill > CUT, F.ceil(fill * PARCELS / 8)).otherwise(1).cast("int")
    large = light.groupBy("text_hash").agg(*sums).where(fill > LARGE).select("text_hash", pieces.alias("pieces"))
    # At most 3 * 64 * shards groups can exceed a 64th of a shard in one of three dimensions.
    rows = light.join(F.broadcast(large), "text_hash", "left")
    parcel = F.when(F.col("pieces").isNull(), F.pmod("text_hash", F.lit(PARCELS * shards))).otherwise(
        F.xxhash64("text_hash", F.pmod(F.xxhash64("doc_id"), F.col("pieces"))))
    rows = rows.select("*", parcel.alias("parcel"), F.col("pieces").isNotNull().alias("own")).drop("pieces")
    parcels = sorted(rows.groupBy("own", "parcel").agg(*sums).collect(), key=lambda r: (r["own"], r["parcel"]))
    demand = np.array([[r["bytes"], r["tokens"], r["rows"]] for r in parcels], dtype=float).reshape(-1, 3)
    chosen = pack(demand, shards)
    start, used = [], [0] * shards
    for r, s in zip(parcels, chosen, strict=True):
        start.append(used[s])
        used[s] += r["rows"]
    places = spark.createDataFrame(
        [(r["own"], r["parcel"], int(s), b) for r, s, b in zip(parcels, chosen, start, strict=True)],
        "own boolean, parcel long, shard int, start long",
    )
    inside = F.row_number().over(Window.partitionBy("own", "parcel").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("inside", inside).join(F.broadcast(places), ["own", "parcel"])
    slot = (F.col("start") + F.col("inside") - 1).alias("slot")
    return placed.select("doc_id", "size", "tokens", "text_crc32", "text_hash", "shard", slot)
