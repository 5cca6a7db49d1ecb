"""Themes, per-message cluster maps, person-level metrics and poll completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.ranking import attach_row, top_n

NOISE = -1


def person_metrics(df: DataFrame, keys: list[str], row_keys: list[str], total_respondents: int | Column | None = None) -> DataFrame:
    """Respondents (source rows), mentions and coverage per cluster.

    Rows are first counted per cluster and source row, so a large cluster is spread over its
    respondents.
    """
    per_row = df.groupBy(*keys, *row_keys).agg(F.count("*").alias("_n"))
    out = per_row.groupBy(*keys).agg(
        F.count("*").alias("respondents_by_row"), F.sum("_n").alias("total_mentions"), F.max("_n").alias("max_mentions_per_respondent"),
    )
    if total_respondents is None:
        everyone = df.select(*row_keys).distinct().agg(F.count("*").alias("_all"))
        out = attach_row(out, everyone)
        total = F.col("_all")
    else:
        total = total_respondents if isinstance(total_respondents, Column) else F.lit(total_respondents)
    return (
        out.withColumn("avg_mentions_per_respondent", F.round(F.col("total_mentions") / F.col("respondents_by_row"), 2))
        .withColumn("respondent_coverage_pct", F.round(F.coalesce(F.try_divide(F.col("respondents_by_row") * 100, total), F.lit(0.0)), 2))
        .drop("_all")
    )


def cluster_maps(assignments: DataFrame, message_id: str, configuration: str, columns: list[str]) -> DataFrame:
    """Per message a map from cluster configuration to its cluster and theme.

    A message has one entry per configuration, so the lists are as short as the sweep.
    """
    entry = F.struct(F.col(configuration).cast("string").alias("key"), F.struct(*columns).alias("value"))
    return assignments.groupBy(message_id).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("multi_cluster_data")
    )


def single_message_theme(df: DataFrame) -> DataFrame:
    """A data set of one message: cluster 0 with full coverage."""
    return df.withColumns(
        {
            "cluster_id": F.lit(0), "respondents_by_row": F.lit(1), "total_mentions": F.lit(1),
            "avg_mentions_per_respondent": F.lit(1.0), "respondent_coverage_pct": F.lit(100.0),
        }
    )


def first_cluster(maps: str = "multi_cluster_data") -> Column:
    """The cluster of the first configuration of a message."""
    return F.get(F.map_values(maps), F.lit(0))


def wide_clusters(df: DataFrame, configurations: list[str], fields: dict[str, str], maps: str = "multi_cluster_data") -> DataFrame:
    """One column set per configuration; ``fields`` says how to render: value, bar, comma or json.

    A single configuration is called ``merged``.
    """
    renders = {
        "value": lambda c: c,
        "bar": lambda c: F.array_join(c, " | "),
        "comma": lambda c: F.array_join(c, ", "),
        "json": lambda c: F.when(F.size(c) > 0, F.to_json(c)).otherwise(""),
    }
    columns = []
    for configuration in configurations:
        suffix = "merged" if len(configurations) == 1 else configuration
        entry = F.try_element_at(F.col(maps), F.lit(configuration))
        columns += [renders[how](entry[name]).alias(f"{name}_{suffix}") for name, how in fields.items()]
    return df.select(*[c for c in df.columns if c != maps], *columns)


def message_export(df: DataFrame) -> DataFrame:
    """One row per atomic message; opt-outs are themed as such, noise has an empty cluster."""
    c = first_cluster()
    opt_out = F.col("is_opt_out")

    def text(value: Column) -> Column:
        return F.when(opt_out, "").otherwise(F.coalesce(value, F.lit("")))

    cluster = F.when(opt_out | (F.coalesce(c["cluster_id"], F.lit(NOISE)) == NOISE), "").otherwise(c["cluster_id"].cast("string"))
    return df.select(
        F.col("atomic_id").alias("atomicId"), F.col("phone_number").alias("phoneNumber"),
        F.coalesce(F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("receivedAt"),
        F.coalesce("original_message", "message_text").alias("originalMessage"),
        F.coalesce("atomic_message", "message_text").alias("atomicMessage"),
        F.coalesce("poll_id", "campaign_id").alias("pollId"), cluster.alias("clusterId"),
        F.when(opt_out, "Opt Out Request").otherwise(F.coalesce(c["cluster_theme"], F.lit(""))).alias("theme"),
        text(c["cluster_category"]).alias("category"), text(c["issues_summary"]).alias("summary"),
        text(c["cluster_sentiment"]).alias("sentiment"), opt_out.alias("isOptOut"),
    )


def theme_rollup(df: DataFrame, theme: str = "theme", phone: str = "phone_number", order: str = "message_id", n_samples: int = 3, n_topics: int = 5) -> DataFrame:
    """Respondents, messages, coverage, modal sentiment, confidence, topics and samples per theme.

    Modal values and bounded lists come from their own small aggregates; no theme is collected.
    """
    base = df.groupBy(theme).agg(
        F.countDistinct(phone).alias("respondents_by_phone"), F.count("*").alias("total_messages"),
        F.round(F.avg("theme_confidence"), 3).alias("avg_confidence"), F.min("category").alias("category"),
    )
    everyone = df.agg(F.countDistinct(phone).alias("_all"))
    base = attach_row(base, everyone).withColumn(
        "coverage_pct", F.round(F.coalesce(F.try_divide(F.col("respondents_by_phone") * 100, F.col("_all")), F.lit(0.0)), 2)
    ).drop("_all")
    sentiment = (
        df.groupBy(theme, "sentiment").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
        .groupBy(theme).agg(F.min_by("sentiment", F.struct(-F.col("_n"), F.col("_first"))).alias("sentiment"))
    )
    topics = df.select(theme, F.explode("key_topics").alias("_topic")).distinct()
    topics = top_n(topics, [theme], [F.col("_topic")], n_topics).groupBy(theme).agg(F.array_sort(F.collect_list("_topic")).alias("key_topics"))
    samples = top_n(df.select(theme, order, "message_text"), [theme], [F.col(order)], n_samples).groupBy(theme).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "message_text"))), lambda s: s["message_text"]).alias("sample_messages")
    )
    return base.join(sentiment, theme).join(topics, theme, "left").join(samples, theme)


def enough_respondents(rollup: DataFrame, minimum: int = 10, at_least: int = 3, respondents: str = "respondents_by_phone") -> DataFrame:
    """Themes with enough respondents; all of them when fewer than three would remain."""
    passing = rollup.agg(F.count_if(F.col(respondents) >= minimum).alias("_passing"))
    marked = attach_row(rollup, passing)
    return marked.where((F.col(respondents) >= minimum) | (F.col("_passing") < at_least)).drop("_passing")


def _configured(records: DataFrame, order: str) -> DataFrame:
    """Each record's cluster under the poll's configuration: the first key of its first record with one."""
    keyed = records.where(F.size("multi_cluster_data") > 0)
    choice = keyed.groupBy("poll_id").agg(F.min_by(F.get(F.map_keys("multi_cluster_data"), F.lit(0)), order).alias("_key"))
    # one row per poll; Spark checks the size before broadcasting
    return keyed.join(choice, "poll_id").withColumn("_c", F.try_element_at("multi_cluster_data", "_key"))


def poll_clusters(records: DataFrame, order: str = "atomic_id") -> DataFrame:
    """Distinct phones and the first description of every cluster of a poll."""
    found = _configured(records, order).where(F.col("_c").isNotNull() & (F.col("_c.cluster_id") != NOISE))
    info = F.struct(
        F.col("_c.cluster_theme").alias("theme"), F.col("_c.issues_summary").alias("summary"),
        F.col("_c.detailed_analysis").alias("analysis"), F.col("_c.quotes").alias("quotes"),
    )
    per_phone = found.select("poll_id", F.col("_c.cluster_id").alias("cluster_id"), "phone_number", F.struct(F.col(order).alias("o"), info.alias("i")).alias("_first"))
    per_phone = per_phone.groupBy("poll_id", "cluster_id", "phone_number").agg(F.min_by("_first", "_first.o").alias("_first"))
    return per_phone.groupBy("poll_id", "cluster_id").agg(
        F.count("*").alias("response_count"), F.min("_first.o").alias("first_seen"), F.min_by("_first.i", "_first.o").alias("_i")
    ).select("poll_id", "cluster_id", "response_count", "first_seen", "_i.*")


def rank_clusters(clusters: DataFrame, minimum: int = 1, n: int = 3) -> DataFrame:
    """The top clusters of each poll by respondents, the one seen first on ties."""
    return top_n(
        clusters.where(F.col("response_count") >= minimum), ["poll_id"],
        [F.desc("response_count"), F.col("first_seen"), F.col("cluster_id")], n,
    )


def poll_completion(polls: DataFrame, records: DataFrame, minimum: int = 1, n: int = 3, order: str = "atomic_id") -> DataFrame:
    """One row per known poll, also without records: respondents without opt-outs, ranked issues."""
    counted = records.groupBy("poll_id").agg(
        F.countDistinct(F.when(~F.col("is_opt_out"), F.col("phone_number"))).alias("total_responses")
    )
    ranked = rank_clusters(poll_clusters(records, order), minimum, n)
    issue = F.struct(
        "rank", "cluster_id", "theme", "summary", "analysis", "quotes", "response_count",
    )
    issues = ranked.groupBy("poll_id").agg(F.sort_array(F.collect_list(issue)).alias("issues"))
    return (
        polls.select("poll_id").distinct()
        .join(counted, "poll_id", "left").join(issues, "poll_id", "left")
        .withColumn("total_responses", F.coalesce("total_responses", F.lit(0)))
    )


def poll_events(completion: DataFrame, location: str = "") -> DataFrame:
    """The completion event of each poll as JSON."""
    issues = F.transform(
        F.coalesce(F.col("issues"), F.array().cast(completion.schema["issues"].dataType)),
        lambda i: F.struct(
            F.col("poll_id").alias("pollId"), i["rank"].alias("rank"), i["cluster_id"].alias("clusterId"), i["theme"].alias("theme"),
            i["summary"].alias("summary"), i["analysis"].alias("analysis"), i["quotes"].alias("quotes"),
            i["response_count"].alias("responseCount"),
        ),
    )
    data = F.struct(
        F.col("poll_id").alias("pollId"), F.col("total_responses").alias("totalResponses"),
        F.lit(location).alias("responsesLocation"), issues.alias("issues"),
    )
    return completion.select("poll_id", F.to_json(F.struct(F.lit("pollAnalysisComplete").alias("type"), data.alias("data"))).alias("event"))


def merge_themes(themes: DataFrame, mapping: DataFrame, cluster: str = "cluster_id", n_quotes: int = 5, n_topics: int = 10) -> DataFrame:
    """Theme statistics after merging: sums, first distinct quotes and topics, new average.

    Sums come from the members of each group, so no cluster is counted twice.
    """
    mapped = themes.join(mapping, cluster, "left").withColumn("target", F.coalesce("target", cluster))
    # members of one target: as many as clusters merged into it
    listed = F.sort_array(F.collect_list(F.struct((F.col(cluster) != F.col("target")).alias("o"), F.col(cluster).alias("c"), "quotes", "key_topics")))
    merged = mapped.groupBy("target").agg(
        F.sum("total_mentions").alias("total_mentions"), F.sum("unique_respondents").alias("unique_respondents"),
        F.max(F.when(F.col(cluster) == F.col("target"), F.col("theme"))).alias("theme"), listed.alias("_members"),
    )

    def distinct(field: str, n: int) -> Column:
        return F.slice(F.array_distinct(F.flatten(F.transform("_members", lambda m: F.coalesce(m[field], F.array())))), 1, n)

    return merged.select(
        F.col("target").alias(cluster), "theme", "total_mentions", "unique_respondents",
        F.try_divide("total_mentions", "unique_respondents").alias("avg_mentions_per_respondent"),
        distinct("quotes", n_quotes).alias("quotes"), distinct("key_topics", n_topics).alias("key_topics"),
    )


def attach_summaries(messages: DataFrame, summaries: DataFrame, keys: tuple[str, str] = ("primary_category", "secondary_category")) -> DataFrame:
    """Category summaries on every message; one row per category, so usually broadcast by Spark."""
    return messages.join(summaries, list(keys), "left")


def lineage(df: DataFrame) -> DataFrame:
    """Where an atomic message came from; the ids travel with the row."""
    return df.select("cluster_id", "atomic_id", "parent_message_id", "source_file", "source_row")
