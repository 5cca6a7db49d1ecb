"""Usage, conversation, event-list and plan-task roll-ups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import fixed


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.MODEL_PRICES, "model string, input_price double, output_price double")


def usage_cost(log: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Tokens and cost per call. Only a total is split 70 to 30; unknown models get the default price.

    The fixed price list is a map literal; a ``prices`` table is joined instead, and Spark
    broadcasts it if it is small enough.
    """
    total = F.coalesce("total_tokens", F.lit(0)).cast("bigint")
    given = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    only_total = (given == 0) & (total > 0)
    guessed = F.floor(total * 0.7).cast("bigint")
    prompt = F.when(only_total, guessed).otherwise(F.coalesce("prompt_tokens", F.lit(0)))
    completion = F.when(only_total, total - guessed).otherwise(F.coalesce("completion_tokens", F.lit(0)))
    calls = log.withColumns(
        {"total_tokens": total, "prompt_tokens": prompt.cast("bigint"), "completion_tokens": completion.cast("bigint")}
    )
    default = next(p for p in fixed.MODEL_PRICES if p[0] == fixed.DEFAULT_MODEL)
    if prices is None:
        table = F.create_map(
            *[x for m, i, o in fixed.MODEL_PRICES for x in (F.lit(m), F.struct(F.lit(i).alias("input"), F.lit(o).alias("output")))]
        )
        known = F.try_element_at(table, F.lower("model"))
        calls = calls.withColumn("_in", F.coalesce(known["input"], F.lit(default[1]))).withColumn(
            "_out", F.coalesce(known["output"], F.lit(default[2]))
        )
    else:
        calls = calls.withColumn("_model", F.lower("model")).join(
            prices.select(F.lower("model").alias("_model"), F.col("input_price").alias("_i"), F.col("output_price").alias("_o")),
            "_model", "left",
        )
        calls = calls.withColumn("_in", F.coalesce("_i", F.lit(default[1]))).withColumn(
            "_out", F.coalesce("_o", F.lit(default[2]))
        ).drop("_model", "_i", "_o")
    cost = F.col("prompt_tokens") / 1_000_000 * F.col("_in") + F.col("completion_tokens") / 1_000_000 * F.col("_out")
    return calls.withColumn("cost", cost).drop("_in", "_out")


def usage_summary(costed: DataFrame, *keys: str) -> DataFrame:
    calls = F.count("*")
    return costed.groupBy(*keys).agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"), calls.alias("call_count"),
        F.sum("cost").alias("total_cost"),
        F.floor(F.sum("total_tokens") / F.greatest(calls, F.lit(1))).alias("average_tokens_per_call"),
        F.try_divide(F.sum("cost"), calls).alias("average_cost_per_call"),
    )


def estimated_tokens(text: str) -> F.Column:
    """Four characters to a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.col(text)) / 4).cast("int"))


CONVERSATION_SCHEMA = (
    "type string, message struct<content: array<struct<type:string,name:string,input:map<string,string>,text:string>>>,"
    "content string, is_error boolean, total_cost_usd double, num_turns bigint"
)


def tool_calls(log: DataFrame) -> DataFrame:
    """Calls per tool in assistant messages."""
    items = log.where("type = 'assistant'").select(F.explode("message.content").alias("c"))
    return items.where("c.type = 'tool_use'").groupBy(F.col("c.name").alias("tool")).agg(F.count("*").alias("calls"))


def conversation_summary(log: DataFrame) -> DataFrame:
    """Turns, cost and errors of a log. Cost and turns come from its result lines."""
    return log.agg(
        F.count_if(F.col("type") == "assistant").alias("assistant_messages"),
        F.count_if((F.col("type") == "tool_result") & F.coalesce("is_error", F.lit(False))).alias("errors"),
        F.coalesce(F.max(F.when(F.col("type") == "result", F.col("total_cost_usd"))), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.max(F.when(F.col("type") == "result", F.col("num_turns"))), F.lit(0)).alias("turns"),
    )


def error_previews(log: DataFrame, width: int = 200) -> DataFrame:
    bad = log.where((F.col("type") == "tool_result") & F.col("is_error"))
    return bad.select(F.regexp_replace(F.substring(F.trim("content"), 1, width), "\n", " ").alias("preview"))


def failed_checks(df: DataFrame, checks: str = "checks") -> DataFrame:
    """``name: detail`` of every failed check of a run."""
    failed = F.filter(checks, lambda c: c["passed"] == F.lit(False))
    line = F.transform(
        failed,
        lambda c: F.concat(
            F.coalesce(c["name"], F.lit("<unnamed>")),
            F.when(F.coalesce(c["detail"], F.lit("")) != "", F.concat(F.lit(": "), c["detail"])).otherwise(""),
        ),
    )
    return df.withColumn("violations", line)


def event_list_scores(runs: DataFrame, as_of: date) -> DataFrame:
    """Scores of generated event lists: count, dates, urls and titles, each 0 to 1."""
    n = F.size("tasks")
    count_score = (
        F.when(n.between(5, 8), 1.0).when(n <= 0, 0.0).when(n < 5, n / 5)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - (n - 8) / 8))
    )
    election = F.col("election_date").try_cast("date")
    dated = F.filter("tasks", lambda t: t["date"].try_cast("date").between(F.lit(as_of), election))
    linked = F.filter("tasks", lambda t: t["url"].isNull() | t["url"].startswith("http://") | t["url"].startswith("https://"))

    def titles(c: str) -> F.Column:
        return F.array_remove(F.array_distinct(F.transform(c, lambda t: F.lower(F.trim(F.coalesce(t["title"], F.lit("")))))), "")

    ours, expected = titles("tasks"), titles("expected")
    shared = F.size(F.array_intersect(ours, expected))
    overlap = F.try_divide(shared, F.size(F.array_union(ours, expected)))
    none = (F.size(ours) <= 0) | (F.size(expected) <= 0)
    return runs.select(
        "run_id", count_score.alias("count_in_range"),
        F.coalesce(F.try_divide(F.size(dated), n), F.lit(0.0)).alias("dates_in_range"),
        F.coalesce(F.try_divide(F.size(linked), n), F.lit(0.0)).alias("urls_valid"),
        F.when(none, 0.0).otherwise(overlap).alias("title_overlap"),
    )


def merge_tasks(generated: DataFrame, static: DataFrame, prefer_generated: bool = True) -> DataFrame:
    """Static tasks give way to generated ones of the same week and type; ordered by week and date."""
    keys = ["week", "flow_type"]
    if prefer_generated:
        taken = generated.select(*keys).distinct()
        on = [static[k].eqNullSafe(taken[k]) for k in keys]
        static = static.join(taken, on, "left_anti")
    merged = static.unionByName(generated, allowMissingColumns=True)
    return merged.orderBy(F.coalesce("week", F.lit(999)), F.col("date").asc_nulls_last(), "flow_type", "title")


def tasks_of_week(tasks: DataFrame, week: int) -> DataFrame:
    return tasks.where(F.col("week") == week)


def task_statistics(tasks: DataFrame) -> DataFrame:
    """One row over all tasks."""
    return tasks.agg(
        F.count("*").alias("total_tasks"), F.count("template_id").alias("with_templates"),
        F.count_if("pro_required").alias("pro_required"), F.min("date").alias("earliest"), F.max("date").alias("latest"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    """Tasks by type and by week."""
    by_type = tasks.groupBy(F.lit("flow_type").alias("dimension"), F.col("flow_type").alias("value")).agg(F.count("*").alias("n"))
    by_week = tasks.groupBy(F.lit("week").alias("dimension"), F.col("week").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return by_type.unionByName(by_week)
