"""Vectors of texts without a model service.

A text is its words, its pairs of words and the three-letter pieces of its words. Each of them has a
bucket, by a hash, and the rarer its bucket over all texts the more it weighs. A seeded hash
gives every feature a sign per dimension; the sum of the signed weights is a random projection
of the weighted counts, so the cosine of two vectors is near that of the counts. Features are an
expression; tasks hash the distinct ones of some texts with numpy, first to count in how many texts
each bucket is, then to add them up. The table of weights has at most ``BUCKETS`` rows, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.text import let
from plenum.session import cut_lineage, short_batches

#: Five hexadecimal digits of a hash.
BUCKETS = 16**5
#: Dimensions per hash: 16 digits of four bits.
SIGNS = 64
#: Features of texts that a task hashes at a time; those of one text are together.
FEATURES = 1 << 18
#: Features that are rows of signed weights at a time: 16 MB.
CHUNK = 1 << 15


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def features(text: Column | str) -> Column:
    """Words (``w``), pairs of neighbours (``p``) and three-letter pieces (``c``) of a text, repeated as they occur."""
    def of(w: Column) -> Column:
        single = F.transform(w, lambda x: F.concat(F.lit("w:"), x))
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(F.lit("p:"), a, F.lit(" "), b)))
        pieces = F.flatten(F.transform(w, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.concat(F.lit("c:"), F.substr(x, i, F.lit(3))))))
        return F.concat(single, F.coalesce(pairs, F.array().cast("array<string>")), pieces)

    return let(words(F.col(text) if isinstance(text, str) else text), of)


def _digests(texts: list[bytes], start: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The md5 of ``start`` and each text as two numbers of 64 bits."""
    both = np.frombuffer(b"".join(hashlib.md5(start + t, usedforsecurity=False).digest() for t in texts), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _buckets(high: np.ndarray) -> np.ndarray:
    """The first five hexadecimal digits."""
    return (high >> np.uint64(44)).astype(np.int64)


def _signs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64 bits of a digest: digits 6 to 13 for the lower half, 14 to 21 for the upper one."""
    return ((high >> np.uint64(12)) & np.uint64(0xFFFFFFFF)) | (((high & np.uint64(0xFFF)) << np.uint64(20) | low >> np.uint64(44)) << np.uint64(32))


def _spans(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes]]]:
    """Rows with the bounds of their features, the place of every feature among the distinct ones, and these; few features at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + FEATURES, "right")))
            part = batch.slice(low, high - low)
            found = part.column(column).flatten().cast(pa.binary()).dictionary_encode()
            yield part, np.append(0, ends[low:high] - before), found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
            low = high


def _rarity(own: DataFrame, seed: int) -> np.ndarray:
    """The weight of every bucket: what comes to the driver is at most one row per bucket, whatever the input."""
    start = f"{seed}/0/".encode()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = np.zeros(BUCKETS, np.int64), 0
        for _, bounds, place, distinct in _spans(batches, "features"):
            texts += int((np.diff(bounds) > 0).sum())
            bucket = _buckets(_digests(distinct, start)[0])[place] if len(place) else place
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            held += np.bincount(np.unique(row * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(held)
        # one more bucket holds the texts with a word
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, BUCKETS).astype(np.int32)), pa.array(np.append(held[used], texts))], ["bucket", "in_texts"])

    counts = own.select(features("text").alias("features")).mapInArrow(count, "bucket int, in_texts long")
    sums = counts.groupBy("bucket").agg(F.sum("in_texts").alias("in_texts")).toArrow()
    held = np.zeros(BUCKETS + 1, np.int64)
    held[sums["bucket"].to_numpy()] = sums["in_texts"].to_numpy()
    return np.log((held[BUCKETS] + 1) / (held[:BUCKETS] + 1)) + 1


def text_vectors(texts: DataFrame, text: str = "text", dims: int = 64, seed: int = 42) -> DataFrame:
    """(text, vector): a unit vector of ``dims`` floats for every distinct text that has a word, written once.

    Equal texts under the same seed and the same table have equal vectors. Null, blank and
    wordless texts are left out, repeated ones count once. Only the distinct texts are shuffled:
    a text's features are hashed and added up where the text is, and no text is cut.
    """
    spark = texts.sparkSession
    own = cut_lineage(texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct())
    with short_batches(spark):
        weights = spark.sparkContext.broadcast(_rarity(own, seed))

        def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, bounds, place, distinct in _spans(batches, "features"):
                out = np.zeros((len(bounds) - 1, dims))
                for block in range(-(-dims // SIGNS)):
                    high, low = _digests(distinct, f"{seed}/{block}/".encode())
                    if not block:
                        weight = weights.value[_buckets(high)]
                    signs, wide = _signs(high, low), min(SIGNS, dims - block * SIGNS)
                    _add(out[:, block * SIGNS: block * SIGNS + wide], bounds, place, weight, signs)
                some = np.flatnonzero(np.diff(bounds))
                out = out[some]
                size = np.sqrt((out * out).sum(axis=1, keepdims=True))
                unit = (out / np.where(size > 0, size, 1.0)).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * dims + 1, dims, dtype=np.int32)), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("text").take(pa.array(some)), lists], ["text", "vector"])

        rows = own.select("text", features("text").alias("features")).mapInArrow(project, T.StructType([own.schema["text"], T.StructField("vector", T.ArrayType(T.FloatType()))]))
        return cut_lineage(rows)


def _add(out: np.ndarray, bounds: np.ndarray, place: np.ndarray, weight: np.ndarray, signs: np.ndarray) -> None:
    """Add to every row of ``out`` the signed weights of its features, a bounded number of features at a time."""
    bits = np.arange(out.shape[1], dtype=np.uint64)
    for start in range(0, len(place), CHUNK):
        at = place[start: start + CHUNK]
        worth = weight[at][:, None]
        signed = np.where((signs[at][:, None] >> bits) & np.uint64(1) == 1, worth, -worth)
        first = np.maximum(bounds[:-1], start) - start
        rows = np.flatnonzero(np.minimum(bounds[1:], start + len(at)) - start > first)
        out[rows] += np.add.reduceat(signed, first[rows], axis=0)
