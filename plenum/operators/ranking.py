"""Ordered and ranked results that do not depend on where the rows happen to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key by an explicit order.

    The filter on ``row_number`` lets Spark keep one row per key and partition before the
    shuffle, so a hot key does not reach one task whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their rank; cut per partition before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, number).where(F.col(rank) <= n)


#: Hexadecimal digits of the hash by which a sample is counted: at most 65,536 counts reach the driver.
SAMPLE_DIGITS = 4


def reproducible_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows whose keys hash lowest: the same rows under any partitioning.

    The first digits of the hash are counted, which tells up to which of them all rows are in;
    only the rows of the one that is cut are ordered, so the sample itself goes through no
    single task. Of repeated keys any row may be the one.
    """
    hashed = F.md5(F.concat_ws("-", F.col(key), F.lit(seed)))
    digits = F.substring(hashed, 1, SAMPLE_DIGITS)
    room, last = n, None
    for row in sorted(df.groupBy(digits.alias("digits")).agg(F.count("*").alias("n")).collect()):
        if room < row["n"]:
            last = row["digits"]
            break
        room -= row["n"]
    if last is None:
        return df
    cut = df.where(digits == last).orderBy(hashed, F.col(key)).limit(room)
    return df.where(digits < last).unionByName(cut)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table beside every row, as a scalar subquery."""
    packed = row.select(F.struct(*row.columns).alias("_row"))
    return df.withColumn("_row", packed.scalar()).select("*", "_row.*").drop("_row")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, whatever is done with them later.

    A filter on a plain computed column is pushed below it as a copy of the expression, and
    projections are merged; for costly text rules that repeats the work many times over.
    Columns that come out of a generator stay what they are.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
