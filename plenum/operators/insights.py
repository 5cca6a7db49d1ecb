"""Issue insights from classified messages.

``mentions`` is the shared intermediate: one row per message and issue, with the normalised
phone and the message position. Everything below aggregates it; no group is ever collected
beyond a bounded number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import fixed
from plenum.functions.names import normalise_phone, title_case
from plenum.functions.text import issue_key
from plenum.operators.ranking import top_n

SAMPLES = 5


def mentions(
    df: DataFrame,
    phone: str = "contact_phone_number",
    text: str = "message_text",
    message_id: str = "message_id",
    issues: str = "issues",
    normalise: bool = True,
) -> DataFrame:
    """Explode issues to one row per mention; rows without a phone are left out."""
    number = normalise_phone(F.col(phone), normalise)
    return (
        df.where(~F.coalesce(F.col("should_be_uncategorized"), F.lit(False)))
        .withColumn("phone", number)
        .where("phone <> ''")
        .select(
            F.col(message_id).alias("message_id"), "phone", F.col(text).alias("message_text"),
            F.col("overall_sentiment"), F.posexplode(issues).alias("issue_index", "_issue"),
        )
        .select(
            "message_id", "phone", "message_text", "overall_sentiment", "issue_index",
            issue_key(F.col("_issue")).alias("issue"), F.col("_issue.*"),
        )
    )


def _position() -> Column:
    return F.struct("message_id", "issue_index")


def _stance_count(stance: str) -> Column:
    return F.count_if(F.col("stance") == stance)


def issue_insights(m: DataFrame, mode: str = "respondent") -> DataFrame:
    """Respondents, mentions, intensity, stance counts and urgency per issue.

    The first aggregate is per issue and phone, so a hot issue is spread over its phones
    before the second one sees it.
    """
    priority = F.array_position(F.array(*[F.lit(s) for s in fixed.STANCES]), F.col("stance"))
    per_phone = m.groupBy("issue", "phone").agg(
        F.count("*").alias("_mentions"),
        F.min(F.when(priority > 0, priority).otherwise(len(fixed.STANCES))).alias("_strongest"),
        *[_stance_count(s).alias(f"_{s}") for s in fixed.STANCES],
    )
    strongest = {s: F.count_if(F.col("_strongest") == i + 1) for i, s in enumerate(fixed.STANCES)}
    totals = per_phone.groupBy("issue").agg(
        F.count("*").alias("unique_respondents"),
        F.sum("_mentions").alias("total_mentions"),
        *[strongest[s].alias(f"{s}_respondents") for s in fixed.STANCES],
        *[F.sum(f"_{s}").alias(f"{s}_mentions") for s in fixed.STANCES],
    )
    if mode == "message":
        totals = totals.withColumn("unique_respondents", F.col("total_mentions"))
        for s in fixed.STANCES:
            totals = totals.withColumn(f"{s}_respondents", F.col(f"{s}_mentions"))
        enough = 50
    else:
        enough = 30
    per_respondent = F.col("total_mentions") / F.col("unique_respondents")
    share = F.col("negative_respondents") / F.col("unique_respondents")
    reach = F.least(F.lit(1.0), F.col("unique_respondents") / enough)
    return totals.withColumn("mentions_per_respondent", F.round(per_respondent, 1)).withColumn(
        "urgency_score", (share * 0.7 + reach * 0.3) * 100
    )


def strongest_stances(m: DataFrame) -> DataFrame:
    """The strongest stance of each respondent on each issue."""
    names = F.array(*[F.lit(s) for s in fixed.STANCES])
    position = F.array_position(names, F.col("stance"))
    level = F.min(F.when(position > 0, position).otherwise(len(fixed.STANCES)))
    return m.groupBy("issue", "phone").agg(F.element_at(names, level.cast("int")).alias("strongest_stance"))


def distribution(m: DataFrame, keys: list[str], value: str, output: str) -> DataFrame:
    """A map of counts per key; meant for columns with a handful of values."""
    counts = m.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct(value, "_n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias(output))


def sample_messages(m: DataFrame, n: int = SAMPLES, width: int = 100) -> DataFrame:
    """The first messages of different phones per issue, in message order."""
    first = m.groupBy("issue", "phone").agg(
        F.min(F.struct("message_id", "issue_index", F.substring("message_text", 1, width).alias("text"))).alias("_first")
    )
    picked = top_n(first, ["issue"], [F.col("_first")], n)
    return picked.groupBy("issue").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("_first.text").alias("text")))), lambda s: s["text"]).alias(
            "sample_messages"
        )
    )


def key_concerns(m: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first distinct concerns per issue, in order of appearance."""
    first = (
        m.where("specific_concern <> ''")
        .groupBy("issue", "specific_concern")
        .agg(F.min(_position()).alias("_first"))
    )
    picked = top_n(first, ["issue"], [F.col("_first")], n)
    return picked.groupBy("issue").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "specific_concern"))), lambda s: s["specific_concern"]).alias(
            "key_concerns"
        )
    )


def compound_patterns(df: DataFrame, message_id: str = "message_id", text: str = "message_text", top: int = 20) -> DataFrame:
    """Issue combinations that occur together, with the usual stance of each member.

    Only combinations seen at least twice among the ``top`` most frequent are kept; ties go to
    the combination seen first, then to its name.
    """
    keyed = df.where(
        ~F.coalesce(F.col("should_be_uncategorized"), F.lit(False)) & (F.size("issues") >= 2)
    ).withColumn("combination", F.array_join(F.array_sort(F.transform("issues", issue_key)), " + "))
    # rank inside each partition first is not possible for a global top list, so rank counts only
    frequent = (
        keyed.groupBy("combination")
        .agg(F.count("*").alias("frequency"), F.min(message_id).alias("_first"))
        .orderBy(F.desc("frequency"), "_first", "combination")
        .limit(top)
        .where("frequency >= 2")
    )
    # at most ``top`` rows
    members = keyed.join(F.broadcast(frequent), "combination")
    stances = (
        members.select("combination", message_id, F.posexplode("issues").alias("_index", "_issue"))
        .select("combination", message_id, "_index", issue_key(F.col("_issue")).alias("issue"), F.col("_issue.stance").alias("stance"))
        .groupBy("combination", "issue", "stance")
        .agg(F.count("*").alias("_n"), F.min(F.struct(message_id, "_index")).alias("_seen"))
        .groupBy("combination", "issue")
        .agg(F.min_by("stance", F.struct(-F.col("_n"), F.col("_seen"))).alias("stance"))
        .groupBy("combination")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.concat_ws(":", "issue", "stance"))), "|"
            ).alias("common_stances")
        )
    )
    samples = (
        top_n(members, ["combination"], [F.col(message_id)], 3)
        .groupBy("combination")
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("rank", F.substring(text, 1, 150).alias("text")))),
                    lambda s: s["text"],
                ),
                "|",
            ).alias("sample_messages")
        )
    )
    return (
        frequent.drop("_first")
        .join(F.broadcast(stances), "combination")
        .join(F.broadcast(samples), "combination")
    )


def root_cause_effects(df: DataFrame, issues: str = "issues") -> DataFrame:
    """Which issues occur in one message with a root cause, as distinct pairs.

    The pairs come from two explodes of the same row's distinct categories: no join.
    """
    def keys(of: Column) -> Column:
        return F.array_distinct(F.transform(of, issue_key))

    causes = keys(F.filter(issues, lambda i: i["is_root_cause"]))
    effects = keys(F.filter(issues, lambda i: ~i["is_root_cause"]))
    return (
        df.select(F.explode(causes).alias("root_cause"), effects.alias("_effects"))
        .select("root_cause", F.explode("_effects").alias("effect"))
        .where("root_cause <> effect")
        .distinct()
    )


def root_cause_frequency(df: DataFrame, issues: str = "issues") -> DataFrame:
    roots = F.filter(issues, lambda i: i["is_root_cause"])
    return (
        df.select(F.explode(roots).alias("i"))
        .groupBy(issue_key(F.col("i")).alias("root_cause"))
        .agg(F.count("*").alias("mentions"))
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of several columns in one pass (grouping sets)."""
    counted = df.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n")
    )
    width = len(columns)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        # in a single-column set every other column is grouped away
        mine = F.col("_set") == ((1 << width) - 1) - (1 << (width - 1 - i))
        name = F.when(mine, F.lit(c)).otherwise(name)
        value = F.when(mine, F.col(c).cast("string")).otherwise(value)
    return counted.select(name.alias("dimension"), value.alias("value"), "n")


def sentiment_by_issue(m: DataFrame) -> DataFrame:
    return m.groupBy("issue", "stance").agg(F.count("*").alias("mentions"))


def hierarchy_counts(m: DataFrame) -> DataFrame:
    """Mentions per primary and secondary category, per primary, and in total."""
    return m.rollup("primary_category", "secondary_category").agg(F.count("*").alias("mentions"))


def issues_by_stance(insights: DataFrame, stance: str, n: int = 10) -> DataFrame:
    """Issues where a stance matters (two mentions or a fifth), by its share."""
    count = F.col(f"{stance}_mentions")
    share = count / F.col("total_mentions")
    return (
        insights.where((count >= 2) | ((count > 0) & (share >= 0.2)))
        .withColumn("stance_share", share)
        .orderBy(F.desc("stance_share"), "issue")
        .limit(n)
    )


def top_issues(insights: DataFrame, n: int = 10) -> DataFrame:
    return insights.orderBy(F.desc("total_mentions"), "issue").limit(n)


def _issue_title(issue: str = "issue") -> Column:
    return title_case(F.replace(F.replace(F.col(issue), F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(": ")))


def priority_issues(insights: DataFrame, n: int = 5) -> DataFrame:
    """Five or more mentions of which 70 % are negative."""
    share = F.col("negative_mentions") / F.col("total_mentions")
    text = F.concat(
        _issue_title(), F.lit(" ("), F.col("total_mentions").cast("string"), F.lit(" complaints, "),
        F.round(share * 100, 0).cast("int").cast("string"), F.lit("% negative)"),
    )
    return (
        insights.where((F.col("total_mentions") >= 5) & (share >= 0.7))
        .select(F.lit("priority").alias("kind"), text.alias("line")).orderBy("line").limit(n)
    )


def success_stories(insights: DataFrame, n: int = 3) -> DataFrame:
    text = F.concat(
        _issue_title(), F.lit(" ("), F.col("positive_mentions").cast("string"), F.lit(" positive mentions)")
    )
    return (
        insights.where("positive_mentions >= 2")
        .select(F.lit("success").alias("kind"), text.alias("line")).orderBy("line").limit(n)
    )


def immediate_actions(effects: DataFrame, n: int = 3) -> DataFrame:
    """Root causes with the number of issues they come with."""
    counted = effects.groupBy("root_cause").agg(F.count("*").alias("_n"))
    text = F.concat(
        F.lit("Address "), _issue_title("root_cause"), F.lit(" (root cause affecting "),
        F.col("_n").cast("string"), F.lit(" issues)"),
    )
    return counted.select(F.lit("immediate").alias("kind"), text.alias("line")).orderBy("line").limit(n)


def actionability(insights: DataFrame, effects: DataFrame) -> DataFrame:
    return priority_issues(insights).unionByName(success_stories(insights)).unionByName(immediate_actions(effects))


def category_synthesis(m: DataFrame, small: int = 20) -> DataFrame:
    """Messages, respondents and stance map per category, and how it would be summarised."""
    base = m.groupBy("primary_category", "secondary_category").agg(
        F.count("*").alias("message_count"), F.countDistinct("phone").alias("unique_respondents")
    )
    stances = distribution(m, ["primary_category", "secondary_category"], "stance", "stance_distribution")
    method = F.when(F.col("message_count") < small, "summary").otherwise("cluster")
    return base.join(stances, ["primary_category", "secondary_category"]).withColumn("method", method)


def category_clusters(
    m: DataFrame, cluster: str = "cluster_id", min_messages: int = 10, min_size: int = 3
) -> DataFrame:
    """Cluster sizes per category; a category too small to cluster counts as one cluster 0."""
    keys = ["primary_category", "secondary_category"]
    sizes = m.groupBy(*keys, cluster).agg(F.count("*").alias("_n"))
    valid = (F.col(cluster) != -1) & (F.col("_n") >= min_size)
    listed = F.sort_array(F.collect_list(F.when(valid, F.struct(F.col(cluster).alias("cluster_id"), F.col("_n").alias("messages")))))
    rolled = sizes.groupBy(*keys).agg(F.sum("_n").alias("message_count"), listed.alias("_clusters"))
    whole = F.array(F.struct(F.lit(0).cast("int").alias("cluster_id"), F.col("message_count").alias("messages")))
    single = (F.col("message_count") < min_messages) | (F.size("_clusters") == 0)
    return rolled.withColumn(
        "clusters", F.when(single, whole.cast("array<struct<cluster_id:int,messages:bigint>>")).otherwise(
            F.col("_clusters").cast("array<struct<cluster_id:int,messages:bigint>>"))
    ).drop("_clusters")


def validation_summary(v: DataFrame) -> DataFrame:
    """One row over all validated messages."""
    severities = F.transform("findings", lambda f: f["severity"])

    def count(kind: str) -> Column:
        return F.sum(F.size(F.filter(severities, lambda s: s == kind)))

    return v.agg(
        F.count("*").alias("total_messages"),
        F.count_if("is_valid").alias("valid_messages"),
        F.try_divide(F.count_if("is_valid"), F.count("*")).alias("validation_pass_rate"),
        count("error").alias("error_count"),
        count("warning").alias("warning_count"),
        count("suggestion").alias("suggestion_count"),
        F.count("confidence_adjustment").alias("confidence_adjustments_applied"),
        F.avg("confidence_adjustment").alias("average_confidence_adjustment"),
    )


def validation_issue_types(v: DataFrame, n: int = 5) -> DataFrame:
    return (
        v.select(F.explode("findings").alias("f"))
        .groupBy(F.col("f.issue_type").alias("issue_type"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "issue_type")
        .limit(n)
    )
