"""Cleaning verdicts, duplicates, splitting and selection of text messages.

A message table has a phone, a text and a position: a source file and an integer row number
in it. Row order inside the result never depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import text as tx
from plenum.operators.ranking import attach_row, computed
from plenum.session import cut_lineage

NEAR = 0.9
SURELY_NEW = 0.8
CHUNK_ROWS = 65_536


def exact_duplicates(
    df: DataFrame, phone: str, text: str, file: str, row: str, output: str = "is_exact_duplicate"
) -> DataFrame:
    """Flag all but the first message per phone with the same normalised text.

    The first positions come from an aggregate with map-side combine and are joined back on
    the unique position, so neither a hot phone nor a hot text reaches one task.
    """
    normalised = F.lower(tx.clean_text(F.col(text)))
    checked = (F.coalesce(F.col(phone), F.lit("")) != "") & (tx.strip(F.coalesce(F.col(text), F.lit(""))) != "")
    firsts = (
        df.where(checked)
        .groupBy(F.col(phone).alias("_phone"), normalised.alias("_text"))
        .agg(F.min(F.struct(F.col(file).alias("f"), F.col(row).alias("r"))).alias("_first"))
        .select(F.col("_first.f").alias(file), F.col("_first.r").alias(row), F.lit(True).alias("_is_first"))
    )
    return df.join(firsts, [file, row], "left").withColumn(
        output, checked & F.col("_is_first").isNull()
    ).drop("_is_first")


def near_duplicates(
    df: DataFrame, phone: str, text: str, file: str, row: str
) -> DataFrame:
    """Positions of messages nearly equal to the last message kept for the same phone.

    The rule is sequential, but it can be cut exactly. The word-set distance is a metric: the
    remembered message is the previous row or within 0.1 of it, so a row that is 0.2 or more
    away from the row before it is kept whatever came earlier. Each such row starts a run
    that is folded on its own; rows that are a run by themselves need no fold at all.
    """
    rows = df.select(F.col(phone).alias("_phone"), F.col(file).alias("_file"), F.col(row).alias("_row"), tx.words(tx.clean_text(F.col(text))).alias("_words"))
    return _near_positions(rows).select(F.col("file").alias(file), F.col("row").alias(row), F.lit(True).alias("is_near_duplicate"))


def _near_positions(rows: DataFrame) -> DataFrame:
    """(file, row) of the near duplicates among (_phone, _file, _row, _words)."""
    runs = _run_starts(rows.withColumn("_chunk", F.floor(F.col("_row") / CHUNK_ROWS)))
    # a run of one row cannot hold a near duplicate and leaves here
    return (
        runs.where(F.col("_in_long_run"))
        .repartition("_phone", "_run")
        .sortWithinPartitions("_phone", "_run", "_file", "_row")
        .select(
            F.concat_ws(":", "_phone", "_run._file", "_run._row").alias("run"),
            F.col("_file").alias("file"), F.col("_row").cast("bigint").alias("row"), F.col("_words").alias("words"),
        )
        .mapInPandas(_fold_runs, "file string, row bigint")
    )


def duplicate_flags(df: DataFrame, phone: str, text: str, file: str, row: str) -> DataFrame:
    """(file, row, is_near_duplicate) of the first messages per phone and normalised text.

    What is missing here repeats an earlier message of its phone. Texts are cleaned once, into
    a narrow table that is written before it is read several times; the texts of the first
    messages come out of the aggregate that finds them.
    """
    checked = (F.coalesce(F.col(phone), F.lit("")) != "") & (tx.strip(F.coalesce(F.col(text), F.lit(""))) != "")
    position = F.struct(F.col(file).alias("_file"), F.col(row).alias("_row"))
    cleaned = computed(df.where(checked).select(F.col(phone).alias("_phone"), position.alias("_at"), F.col(text).alias("_text")), _clean=tx.clean_text(F.col("_text")))
    firsts = cleaned.groupBy("_phone", F.lower("_clean").alias("_same")).agg(F.min("_at").alias("_at"), F.min_by("_clean", "_at").alias("_clean"))
    kept = cut_lineage(firsts.select("_phone", "_at._file", "_at._row", tx.words(F.col("_clean")).alias("_words")))
    near = _near_positions(kept).select(F.col("file").alias("_file"), F.col("row").alias("_row"), F.lit(True).alias("is_near_duplicate"))
    return kept.select("_file", "_row").join(near, ["_file", "_row"], "left").select(
        F.col("_file").alias(file), F.col("_row").alias(row), F.coalesce("is_near_duplicate", F.lit(False)).alias("is_near_duplicate"))


def _run_starts(rows: DataFrame) -> DataFrame:
    """The position that starts each row's run, and whether the run has more rows.

    Rows are windowed in chunks of their row number. What has to cross a chunk border goes
    through one summary row per chunk, so a phone holding a third of the table is still
    spread over many tasks.
    """
    chunk = ["_phone", "_file", "_chunk"]
    inside = Window.partitionBy(*chunk).orderBy("_row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.struct("_file", "_row")
    previous = F.lag("_words").over(inside)
    # null for the first row of a chunk: that is settled below
    starts = F.when(previous.isNotNull(), tx.jaccard(F.col("_words"), previous) <= SURELY_NEW)
    marked = rows.withColumn("_starts", starts)
    local_start = F.when(F.col("_starts"), position)
    marked = marked.withColumn("_local_run", F.max(local_start).over(so_far)).withColumn(
        "_next_starts", F.lead("_starts").over(inside)
    )
    across = Window.partitionBy("_phone").orderBy("_file", "_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    chunks = marked.groupBy(*chunk).agg(
        F.min_by("_words", "_row").alias("_head"), F.max_by("_words", "_row").alias("_tail"),
        F.min("_row").alias("_first_row"), F.max("_row").alias("_last_row"), F.max("_local_run").alias("_last_run"),
    )
    tail = F.lag("_tail").over(across)
    chunks = chunks.withColumn(
        "_head_starts", F.coalesce(tx.jaccard(F.col("_head"), tail) <= SURELY_NEW, F.lit(True))
    )
    head_position = F.when(F.col("_head_starts"), F.struct("_file", F.col("_first_row").alias("_row")))
    chunks = chunks.withColumn("_head_run", head_position)
    chunks = chunks.withColumn(
        "_open_run", F.coalesce("_head_run", F.max(F.coalesce("_last_run", "_head_run")).over(before))
    ).withColumn("_next_head_starts", F.coalesce(F.lead("_head_starts").over(across), F.lit(True)))
    joined = marked.join(
        chunks.select(*chunk, "_first_row", "_last_row", "_head_starts", "_open_run", "_next_head_starts"), chunk
    )
    is_start = F.when(F.col("_row") == F.col("_first_row"), F.col("_head_starts")).otherwise(F.col("_starts"))
    next_is_start = F.when(F.col("_row") == F.col("_last_row"), F.col("_next_head_starts")).otherwise(F.col("_next_starts"))
    return joined.select(
        "_phone", "_file", "_row", "_words", F.coalesce("_local_run", "_open_run").alias("_run"),
        (~is_start | ~next_is_start).alias("_in_long_run"),
    )


def _fold_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sorted runs holding one remembered message, whatever the length of the run."""
    run, kept = None, frozenset()
    for batch in batches:
        files, rows = [], []
        for name, file, row, words in zip(batch["run"], batch["file"], batch["row"], batch["words"]):
            current = frozenset(words)
            if name == run and near_duplicate(current, kept):
                files.append(file)
                rows.append(row)
            else:
                run, kept = name, current
        if rows:
            yield pd.DataFrame({"file": files, "row": rows})


def near_duplicate(words: frozenset, kept: frozenset) -> bool:
    if not words or not kept:
        return False
    return len(words & kept) / len(words | kept) > NEAR


def clean_messages(
    df: DataFrame,
    phone: str = "contact_phone_number",
    text: str = "message_text",
    file: str = "source_file",
    row: str = "source_row",
    min_length: int = 10,
    remove_duplicates: bool = True,
    strict_boundary: bool = False,
) -> DataFrame:
    """One verdict per message in ``removal_reason`` and the text that goes on.

    Order of the rules: empty, duplicate, empty after cleaning, opt-out without feedback,
    non-substantive, kept. Duplicates are judged on the text before the opt-out rule, so an
    opt-out still counts as the previous message of its phone.
    """
    if remove_duplicates:
        df = df.join(duplicate_flags(df, phone, text, file, row), [file, row], "left")
        blank = tx.strip(F.coalesce(F.col(text), F.lit(""))) == ""
        # a checked message that is not the first of its text has no row among the flags
        duplicate = (F.coalesce(F.col(phone), F.lit("")) != "") & ~blank & F.coalesce("is_near_duplicate", F.lit(True))
    else:
        duplicate = F.lit(False)
    df = df.withColumn("_duplicate", duplicate)
    return cleaning_verdict(df, text, F.col("_duplicate"), min_length, strict_boundary).drop(
        "_duplicate", "is_near_duplicate"
    )


def cleaning_verdict(
    df: DataFrame, text: str, duplicate: Column, min_length: int = 10, strict_boundary: bool = False
) -> DataFrame:
    # a duplicate is one whatever its text says, so its text is not worked on
    df = computed(df, _clean=F.when(duplicate, F.lit(None)).otherwise(tx.clean_text(F.coalesce(F.col(text), F.lit("")))))
    stop = tx.is_stop_message(F.col("_clean"))
    df = computed(df, _stop=stop, _feedback=F.when(stop, tx.feedback_from_stop(F.col("_clean"))))
    df = df.withColumn("_kept", F.coalesce("_feedback", "_clean"))
    reason = (
        F.when(tx.strip(F.coalesce(F.col(text), F.lit(""))) == "", "empty_message")
        .when(duplicate, "duplicate")
        .when(F.col("_clean") == "", "empty_after_cleaning")
        .when(F.col("_stop") & F.col("_feedback").isNull(), "stop_message")
        .when(tx.is_non_substantive(F.col("_kept"), min_length, strict_boundary), "non_substantive")
        .otherwise("kept")
    )
    return (
        computed(df, removal_reason=reason)
        .withColumn("cleaned_text", F.when(F.col("removal_reason") == "kept", F.col("_kept")))
        .drop("_clean", "_stop", "_feedback", "_kept")
    )


def filter_messages(df: DataFrame, text: str = "message_text", max_length: int = 5000, on_raw: bool = False) -> DataFrame:
    """Add the filter result; failing rows stay in the table with an empty filtered text."""
    df = computed(df, _heavy=tx.clean_text_heavy(F.col(text)))
    df = computed(df, filter_reasons=tx.filter_reasons(F.col(text), max_length, on_raw, F.col("_heavy")))
    return (
        df.withColumn("passed", F.size("filter_reasons") == 0)
        .withColumn("filtered_text", F.when(F.col("passed"), F.col("_heavy")).otherwise(""))
        .withColumn("is_opt_out", F.array_contains("filter_reasons", "STOP/opt-out message"))
        .drop("_heavy")
    )


Splitter = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def split_messages(
    df: DataFrame,
    text: str = "filtered_text",
    message_id: str = "message_id",
    splitter: Splitter | None = None,
    passed: str | None = "passed",
    original: str | None = "message_text",
) -> DataFrame:
    """One row per atomic message with its parent id and index.

    ``splitter`` is a pandas function from batches of texts to batches of lists. A split that
    yields nothing keeps the message whole; filtered rows pass through unsplit; texts that
    heavy cleaning emptied vanish here.
    """
    pieces = (
        F.pandas_udf(splitter, T.ArrayType(T.StringType()))(F.col(text))
        if splitter is not None
        else tx.split_sentences(F.col(text))
    )
    pieces = F.filter(F.transform(pieces, tx.strip), lambda p: p.isNotNull() & (p != ""))
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.col(text)))
    if passed is not None:
        source = F.col(original) if original else F.col(text)
        pieces = (
            F.when(~F.col(passed), F.array(source))
            .when(tx.strip(F.col(text)) == "", F.array().cast("array<string>"))
            .otherwise(pieces)
        )
    exploded = df.select(
        "*", F.posexplode(pieces).alias("atomic_index", "atomic_text")
    ).withColumnRenamed(message_id, "parent_message_id")
    atomic_id = F.concat_ws("-", F.col("parent_message_id").cast("string"), F.col("atomic_index").cast("string"))
    return exploded.withColumn("atomic_id", atomic_id)


def inbound_only(df: DataFrame, direction: str = "send_direction") -> DataFrame:
    return df.where(F.upper(F.col(direction)) == "INBOUND")


def by_sentiment(df: DataFrame, sentiment: str) -> DataFrame:
    return df.where(F.col("overall_sentiment") == sentiment)


def by_issue_stance(df: DataFrame, primary: str, stance: str, issues: str = "issues") -> DataFrame:
    wanted = primary.lower()
    return df.where(
        F.exists(issues, lambda i: (F.lower(i["primary_category"]) == wanted) & (i["stance"] == stance))
    )


def uncategorised(df: DataFrame) -> DataFrame:
    return df.where("should_be_uncategorized")


def substantive(df: DataFrame) -> DataFrame:
    return df.where("is_substantive")


def cleaning_statistics(df: DataFrame) -> DataFrame:
    """One row: totals by reason and how many kept texts were changed."""
    reason = F.col("removal_reason")
    return df.agg(
        F.count("*").alias("total_messages"),
        F.count_if(reason == "stop_message").alias("removed_stop_messages"),
        F.count_if(reason == "duplicate").alias("removed_duplicates"),
        F.count_if(reason.isin("non_substantive", "empty_message", "empty_after_cleaning")).alias(
            "removed_non_substantive"
        ),
        F.count_if(reason == "kept").alias("remaining_substantive"),
        F.count_if((reason == "kept") & (F.col("cleaned_text") != F.col("message_text"))).alias(
            "text_normalizations"
        ),
    )


def filter_statistics(df: DataFrame, campaign: str = "campaign_name", text: str = "message_text") -> DataFrame:
    """Pass rate and mean lengths per campaign and, with a null campaign, over all."""
    return df.groupingSets([[campaign], []], campaign).agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.try_divide(F.count_if("passed"), F.count("*")).alias("pass_rate"),
        F.avg(F.length(F.col(text))).alias("average_original_length"),
        F.avg(F.when(F.col("passed"), F.length("filtered_text"))).alias("average_filtered_length"),
    )


def filter_reason_counts(df: DataFrame) -> DataFrame:
    reasons = df.select(F.explode("filter_reasons").alias("reason"))
    return reasons.groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def load_summary(df: DataFrame, dimensions: list[str], text: str = "message_text") -> DataFrame:
    """Counts per value of each dimension in one pass; a null dimension row is the total."""
    named = df.select(
        *[F.coalesce(F.col(d), F.lit("Unknown")).alias(d) for d in dimensions],
        F.length(F.col(text)).alias("_length"),
    )
    sets = [[d] for d in dimensions] + [[]]
    counted = named.groupingSets(sets, *dimensions).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n"), F.round(F.avg("_length"), 1).alias("average_length")
    )
    pick = F.lit(None).cast("string")
    label = F.lit(None).cast("string")
    for d in reversed(dimensions):
        here = F.col(d).isNotNull()
        pick, label = F.when(here, F.col(d)).otherwise(pick), F.when(here, F.lit(d)).otherwise(label)
    return counted.select(label.alias("dimension"), pick.alias("value"), "n", "average_length")


def text_length_profile(df: DataFrame, text: str = "original_text", timestamp: str | None = None) -> DataFrame:
    """Minimum, maximum, mean and upper median of the text length, and timestamp coverage.

    The upper median is read off a histogram of lengths, so no sort of the rows is needed.
    """
    lengths = df.select(
        F.length(F.col(text)).alias("_length"),
        (F.col(timestamp).isNotNull() if timestamp else F.lit(False)).cast("int").alias("_timed"),
    )
    histogram = lengths.groupBy("_length").agg(F.count("*").alias("_n"), F.sum("_timed").alias("_timed"))
    totals = histogram.agg(
        F.sum("_n").alias("total_messages"),
        F.min("_length").alias("min_length"),
        F.max("_length").alias("max_length"),
        (F.sum(F.col("_length") * F.col("_n")) / F.sum("_n")).alias("mean_length"),
        (F.sum("_timed") / F.sum("_n")).alias("timestamp_coverage"),
        # bounded by the number of distinct lengths, not of rows
        F.sort_array(F.collect_list(F.struct("_length", "_n"))).alias("_bins"),
    )
    target = F.floor(F.col("total_messages") / 2)
    walk = F.aggregate(
        "_bins",
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("median")),
        lambda acc, b: F.struct(
            (acc["seen"] + b["_n"]).alias("seen"),
            F.when(acc["median"].isNotNull(), acc["median"])
            .when(acc["seen"] + b["_n"] > target, b["_length"])
            .alias("median"),
        ),
    )
    return totals.withColumn("median_length", walk["median"]).drop("_bins")


def metadata_fields(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Every key that occurs in the metadata maps."""
    return df.select(F.explode(F.map_keys(metadata)).alias("field")).distinct()


def splitting_impact(parents: DataFrame, atoms: DataFrame, message_id: str = "message_id") -> DataFrame:
    """How many parents were split, kept single or dropped, and the expansion ratio."""
    per_parent = atoms.groupBy("parent_message_id").agg(
        F.count("*").alias("_n"), F.sum(F.length("atomic_text")).alias("_chars")
    )
    made = per_parent.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("output_messages"),
        F.count_if(F.col("_n") > 1).alias("split_messages"),
        F.count_if(F.col("_n") == 1).alias("single_messages"),
        F.count("*").alias("_parents"),
        F.sum("_chars").alias("_chars"),
    )
    given = parents.agg(F.count("*").alias("input_messages"))
    return attach_row(given, made).select(
        "input_messages", "output_messages", "split_messages", "single_messages",
        (F.col("input_messages") - F.col("_parents")).alias("dropped_messages"),
        F.coalesce(F.try_divide("output_messages", "input_messages"), F.lit(0.0)).alias("expansion_ratio"),
        F.coalesce(F.try_divide("_chars", "output_messages"), F.lit(0.0)).alias("average_length"),
    )


def campaign_lengths(atoms: DataFrame, campaign: str = "campaign_name", text: str = "atomic_text") -> DataFrame:
    return atoms.groupBy(campaign).agg(
        F.count("*").alias("atomic_messages"), F.avg(F.length(F.col(text))).alias("avg_length")
    )
