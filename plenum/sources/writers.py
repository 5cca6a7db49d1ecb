"""Sinks: snapshots, exports, splits and resumable jobs."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.session import ensure_checkpoint_dir


def write_snapshot(df: DataFrame, folder: str, name: str, stamp: datetime) -> tuple[str, str]:
    """Write a stamped copy, and a ``latest`` copy read back from it (the plan runs once)."""
    stamped, latest = f"{folder}/{name}_{stamp:%Y%m%d_%H%M%S}", f"{folder}/{name}_latest"
    df.write.mode("overwrite").parquet(stamped)
    df.sparkSession.read.parquet(stamped).write.mode("overwrite").parquet(latest)
    return stamped, latest


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """parquet, json, csv or tsv."""
    writer = df.write.mode("overwrite")
    if fmt in ("csv", "tsv"):
        writer.option("header", True).option("escape", '"').option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    elif fmt in ("parquet", "json"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_message_export(export: DataFrame, folder: str, name: str) -> None:
    write_table(export, f"{folder}/{name}_csv", "csv")
    write_table(export, f"{folder}/{name}_json", "json")


def write_split(df: DataFrame, folder: str, category: str = "category") -> None:
    """Accepted and rejected rows in one pass, a folder per category."""
    df.write.mode("overwrite").partitionBy(category).parquet(folder)


def write_states(df: DataFrame, folder: str, skip_existing: bool = True) -> None:
    """A folder per state; states that are there already are left alone.

    The rebalance hint clusters rows by state and lets adaptive execution split a large state
    over many writers and put small ones together, by their measured sizes.
    """
    spark = df.sparkSession
    if skip_existing:
        df = df.join(finished_states(spark, folder), "state", "left_anti")
    (
        df.hint("rebalance", F.col("state"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state").parquet(folder)
    )


def finished_states(spark: SparkSession, folder: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "state string")
    return spark.read.parquet(folder).select(F.col("state").cast("string")).distinct()


def unfinished(df: DataFrame, done: DataFrame, key: str, result: str) -> DataFrame:
    """Rows without a result so far."""
    return df.join(done.where(F.col(result).isNotNull()).select(key).distinct(), key, "left_anti")


def resume(
    df: DataFrame, folder: str, key: str, result: str, compute, index: str | None = None, start: int | None = None, stop: int | None = None, slices: int = 10,
) -> DataFrame:
    """Compute only what is missing and append it; a rerun continues where the last one ended.

    ``compute`` maps a DataFrame to the same rows with ``result``. The input is read once: its
    missing rows are written to a work table in the shared checkpoint folder, a folder per slice
    by the hash of the key. Each of the ``slices`` reads its own folder and is a commit of its
    own, so a lost run costs one slice. Keys that are in the folder are left out, also those
    that a run left there without finishing; slices share no key, so none is written twice.
    """
    spark = df.sparkSession
    if index is not None:
        if start is not None:
            df = df.where(F.col(index) >= start)
        if stop is not None:
            df = df.where(F.col(index) < stop)
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files):
        df = unfinished(df, spark.read.parquet(folder), key, result)
    work = f"{ensure_checkpoint_dir(spark)}/resume-{uuid.uuid4().hex}"
    todo = df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    todo.write.partitionBy("_slice").parquet(work)
    sliced = spark.read.schema(todo.schema).parquet(work)
    for number in range(slices):
        compute(sliced.where(F.col("_slice") == number).drop("_slice")).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


ATOMISED = ["original_row_idx", "atomic_idx", "phone_number", "message_text", "campaign_source", "round", "age_group",
            "voters_gender", "voting_performance_category", "location", "ward", "primary_category",
            "secondary_category", "stance", "specific_concern"]


def atomised_export(df: DataFrame) -> DataFrame:
    """The fixed column list of the atomised export; a missing gender is empty."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "voters_gender" else F.col(c) for c in ATOMISED])


def enriched_export(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every message with its category summary; nested summaries as JSON text."""
    joined = messages.join(summaries, ["primary_category", "secondary_category"], "left")
    return joined.select(
        "poll_id", F.col("original_message_text").alias("message"), F.col("message_text").alias("atomic_message"), "phone_number",
        F.coalesce("theme", F.lit("")).alias("theme"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("analysis", "specific_concern").alias("analysis"),
        F.coalesce(F.to_json("quotes"), F.lit("[]")).alias("quotes"),
        F.concat_ws("/", "primary_category", "secondary_category").alias("category"),
        F.col("stance").alias("sentiment"), F.coalesce(F.to_json("clusters"), F.lit("[]")).alias("cluster_analysis"),
    )
