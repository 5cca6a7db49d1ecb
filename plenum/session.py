"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "plenum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    A machine-local folder is only accepted in local mode, where driver and executors share
    one machine; on a cluster an unset ``spark.checkpoint.dir`` is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="plenum-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Iterative operators call this once per round, so that a lost executor costs one round
    and the plan does not grow.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back.

    For tables of which later steps read few columns, several times: those of ``cut_lineage`` are whole rows.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows that go to a Python worker at a time where they hold whole texts.
TEXT_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def use_short_batches(spark: SparkSession) -> str:
    """Send few texts at a time to Python workers of this session; returns the setting before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(TEXT_ROWS))
    return before


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Short batches for what is written inside; the setting of the session comes back."""
    before = use_short_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
