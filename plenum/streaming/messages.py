"""Streams of message files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plenum.functions import text as tx
from plenum.operators.messages import near_duplicate
from plenum.operators.polls import NOISE


def arriving_files(spark: SparkSession, folder: str, schema: str, max_files: int | None = None) -> DataFrame:
    """New ``.csv`` files of a folder as a stream; other files are ignored."""
    reader = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", "*.csv")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(folder).select("*", F.col("_metadata.file_name").alias("source_file"))


def run_per_arrival(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start one run per batch of new files; the checkpoint keeps a file from running twice."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_exact_duplicates(stream: DataFrame, phone: str, text: str, timestamp: str, delay: str = "1 day") -> DataFrame:
    """The first message per phone and normalised text within the watermark."""
    keyed = stream.withColumn("_text", F.lower(tx.clean_text(F.col(text))))
    return keyed.withWatermark(timestamp, delay).dropDuplicatesWithinWatermark([phone, "_text"]).drop("_text")


class DuplicateState(StatefulProcessor):
    """Per phone: digests of the texts seen and the words of the last message kept.

    Both expire ``keep_ms`` after they were last written.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "digest string", "flag boolean", self.keep_ms)
        self.kept = handle.getValueState("kept", "words string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # all rows of a phone in this micro-batch, however many Arrow batches they came in
        batch = pd.concat(list(rows)).sort_values(["source_file", "source_row"])
        verdicts = []
        for text in batch["normalised"]:
            digest = (hashlib.md5(text.encode()).hexdigest(),)
            if self.seen.containsKey(digest):
                verdicts.append("duplicate")
                continue
            self.seen.updateValue(digest, (True,))
            words = frozenset(text.split())
            last = self.kept.get()
            if last is not None and near_duplicate(words, frozenset(last[0].split())):
                verdicts.append("near_duplicate")
            else:
                self.kept.update((text,))
                verdicts.append("new")
        yield pd.DataFrame(
            {"phone": [key[0]] * len(batch), "source_file": batch["source_file"].tolist(), "source_row": batch["source_row"].tolist(), "verdict": verdicts}
        )

    def close(self) -> None:
        pass


def duplicate_verdicts(stream: DataFrame, phone: str, text: str, file: str = "source_file", row: str = "source_row", keep_days: int = 365) -> DataFrame:
    """new, duplicate or near_duplicate for every message, with state per phone.

    The order of arrival is the order of the rule; inside a micro-batch it is file and row.
    What a phone sent is forgotten after ``keep_days``.
    """
    prepared = stream.select(
        F.col(phone).alias("phone"), F.col(file).alias("source_file"), F.col(row).cast("bigint").alias("source_row"),
        F.lower(tx.clean_text(F.col(text))).alias("normalised"),
    ).where("phone <> '' and normalised is not null")
    return prepared.groupBy("phone").transformWithStateInPandas(
        statefulProcessor=DuplicateState(keep_days * 86_400_000),
        outputStructType="phone string, source_file string, source_row bigint, verdict string",
        outputMode="Append", timeMode="ProcessingTime",
    )


class PollState(StatefulProcessor):
    """Per poll: who answered, who is in which cluster, and the first description of each cluster.

    Clusters are kept for every configuration, as a later batch may hold an earlier record that
    decides for another one. Only the entries that a batch touches are read and written.
    """

    def __init__(self, order_type: str) -> None:
        self.order_type = order_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        order = self.order_type
        self.phones = handle.getMapState("phones", "phone string", "flag boolean")
        self.total = handle.getValueState("total", "n long")
        self.choice = handle.getValueState("choice", f"o {order}, configuration string")
        self.members = handle.getMapState("members", "configuration string, cluster string, phone string", "flag boolean")
        self.clusters = handle.getMapState("clusters", "configuration string, cluster string", f"n long, placed boolean, o {order}, info string")

    def _answered(self, rows: pd.DataFrame) -> int:
        total = self.total.get()[0] if self.total.exists() else 0
        for phone in rows.loc[rows["answers"], "phone"].dropna().unique():
            if not self.phones.containsKey((phone,)):
                self.phones.updateValue((phone,), (True,))
                total += 1
        self.total.update((total,))
        return total

    def _configuration(self, rows: pd.DataFrame) -> str | None:
        chosen = self.choice.get() if self.choice.exists() else None
        placed = rows[rows["placed"] & rows["is_first"]]
        if len(placed):
            first = min(zip(placed["o"].tolist(), placed["configuration"], strict=True))
            if chosen is None or first[0] < chosen[0]:
                chosen = first
                self.choice.update(chosen)
        return chosen[1] if chosen else None

    def _clustered(self, rows: pd.DataFrame) -> None:
        for place, part in rows[rows["cluster"].notna()].groupby(["configuration", "cluster"]):
            n, placed, first, info = self.clusters.getValue(place) if self.clusters.containsKey(place) else (0, False, part["o"].tolist()[0], None)
            for phone in part["phone"].map(lambda p: "" if p is None else f"={p}").unique():
                if not self.members.containsKey((*place, phone)):
                    self.members.updateValue((*place, phone), (True,))
                    n += 1
            known = part[part["placed"]]
            earliest = min(zip(known["o"].tolist(), known["info"], strict=True), default=None)
            if earliest and (not placed or earliest[0] < first):
                placed, (first, info) = True, earliest
            self.clusters.updateValue(place, (n, placed, first, info))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, configuration = 0, None
        for batch in rows:
            total, configuration = self._answered(batch), self._configuration(batch)
            self._clustered(batch)
        found = [(c[1], *v) for c, v in self.clusters.iterator() if c[0] == configuration] or [(None, None, None, None, None)]
        out = pd.DataFrame(found, columns=["cluster", "n", "placed", "o", "info"], dtype=object)
        yield out.assign(poll_id=key[0], total_responses=total)[["poll_id", "total_responses", "cluster", "n", "placed", "o", "info"]]

    def close(self) -> None:
        pass


def poll_progress(stream: DataFrame, order: str = "atomic_id") -> DataFrame:
    """The state of every poll that a batch touches: a row per cluster, one without cluster where there is none."""
    kind = stream.schema[order].dataType.simpleString()
    data, info = F.col("multi_cluster_data"), ("cluster_theme", "issues_summary", "detailed_analysis", "quotes")
    entries = F.transform(F.map_entries(data), lambda e, i: F.struct(
        (i == 0).alias("is_first"), e["key"].alias("configuration"),
        F.when(e["value"]["cluster_id"] != NOISE, e["value"]["cluster_id"]).cast("string").alias("cluster"),
        F.to_json(F.struct(*[e["value"][c].alias(c) for c in info])).alias("info"),
    ))
    prepared = stream.select(
        "poll_id", F.col("phone_number").alias("phone"), F.coalesce(~F.col("is_opt_out"), F.lit(False)).alias("answers"),
        F.col(order).isNotNull().alias("placed"), F.coalesce(F.col(order), F.lit("0").cast(kind)).alias("o"), F.inline_outer(entries),
    ).withColumn("is_first", F.coalesce("is_first", F.lit(False)))
    return prepared.groupBy("poll_id").transformWithStateInPandas(
        statefulProcessor=PollState(kind), outputMode="Update", timeMode="None",
        outputStructType=f"poll_id string, total_responses long, cluster string, n long, placed boolean, o {kind}, info string",
    )


def complete_polls(
    stream: DataFrame, polls: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, minimum: int = 1, n: int = 3, order: str = "atomic_id",
) -> StreamingQuery:
    """Completion of the known polls that a batch touches, from all their records so far.

    Gives the rows that ``poll_completion`` gives over all records. What earlier batches brought
    is state, so a batch costs what it touches. A poll is one state key: its records of one
    batch go to one task, its entries stay in the state store on disk.
    """
    entry = stream.schema["multi_cluster_data"].dataType.valueType
    names = {"theme": "cluster_theme", "summary": "issues_summary", "analysis": "detailed_analysis", "quotes": "quotes"}
    fields = T.StructType([T.StructField(c, entry[c].dataType) for c in names.values()])
    cluster_id = F.col("cluster").cast(entry["cluster_id"].dataType)
    info = F.from_json("info", fields)

    def run(batch: DataFrame, epoch: int) -> None:
        ranked = F.struct((-F.col("n")).alias("less"), F.when(F.col("placed"), F.col("o")).alias("o"), cluster_id.alias("cluster_id"),
                          *[info[c].alias(name) for name, c in names.items()], F.col("n").alias("response_count"))
        listed = F.collect_list(F.when(F.col("cluster").isNotNull() & (F.col("n") >= minimum), ranked))
        # the sort never reaches the descriptions: a cluster stands once in a poll
        kept = F.slice(F.array_sort(listed, _by_rank), 1, n)
        issues = F.transform(kept, lambda c, i: F.struct((i + 1).alias("rank"), *[c[x].alias(x) for x in ("cluster_id", *names, "response_count")]))
        done = batch.groupBy("poll_id").agg(F.max("total_responses").alias("total_responses"), F.when(F.size(listed) > 0, issues).alias("issues"))
        sink(polls.select("poll_id").distinct().join(done, "poll_id").select("poll_id", "total_responses", "issues"), epoch)

    return (
        poll_progress(stream, order).writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _by_rank(a: Column, b: Column) -> Column:
    """More respondents first, then seen earlier, a cluster without a place first, then the smaller id."""
    def key(c: Column) -> Column:
        return F.struct(c["less"], c["o"], c["cluster_id"])

    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
