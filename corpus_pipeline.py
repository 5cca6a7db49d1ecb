"""From documents to shards: language, near copies, benchmark leaks, mix, shards.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the docs of the next one. All but
the last return the columns of ``documents``; the last adds the placement. Null or empty texts
go in the first stage, as they have no letter; repeated rows of one text go in the second.
Empty tables pass through. Other columns of the input are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import decontaminate, jaccard, language, mixing, sharding
from plenum.llm.common import staged, use_short_batches
from plenum.llm.queries import fold_of


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; ``lang`` becomes the language found.

    Fitted on the rows with a language outside the held-out fold. Texts without a letter go.
    """
    use_short_batches(spark)
    return language.with_language(docs, language.fit_languages(docs.where(fold_of(F.col("doc_id"), 4) != 2)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id: five-word shingles, likeness 0.8 and more."""
    return jaccard.without_copies(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` leaks."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times; those it takes no time go."""
    return mixing.mixed(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot): where each document of the mix goes."""
    return sharding.shard(docs, 40).select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")


STAGES = [
    ("language", keep_known_language),
    ("near copies", drop_near_copies),
    ("benchmark leaks", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shards", place_in_shards),
]

#: Language codes, and the packing by dot products, are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
