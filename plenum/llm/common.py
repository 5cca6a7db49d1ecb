"""Helpers shared by the operators: staged tables, words, hash samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.session import TEXT_ROWS, ensure_checkpoint_dir, short_batches, use_short_batches  # noqa: F401

#: White space as the contracts of the operators define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Later steps read the narrow written table instead of repeating costly expressions, and a
    lost executor costs no more than the tasks that it ran.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_share(key: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_lists(texts: pa.Array, rows: int = 256) -> Iterator[list[str]]:
    """The texts of an Arrow array as short lists; nulls are empty texts."""
    for start in range(0, len(texts), rows):
        yield [t or "" for t in texts.slice(start, rows).to_pylist()]


def byte_chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` whose total length stays near ``limit``; every text is in one range."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


#: Rows of two or three longs (about 40 bytes each in memory) that may be broadcast.
BROADCAST_ROWS = 2_000_000


def if_small(table: DataFrame) -> DataFrame:
    """A staged narrow table, marked for broadcast when it is counted to be small; else it is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
