"""Profiles of tables: coverage, value counts, schemas, extracts and flow counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators.ranking import attach_row


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls and type of every column from one pass over the table."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col("_rows").alias("row_count"), F.col(f"c{i}").alias("non_null_count"),
                (F.col("_rows") - F.col(f"c{i}")).alias("null_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(entries))


def column_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows where each text column says something, and its distinct values."""
    aggregates = [F.count("*").alias("_rows")]
    for c in columns:
        filled = F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c))
        aggregates += [F.count(filled).alias(f"n_{c}"), F.countDistinct(filled).alias(f"d_{c}")]
    one = df.agg(*aggregates)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("filled"),
                F.try_divide(F.col(f"n_{c}") * 100.0, "_rows").alias("coverage_pct"), F.col(f"d_{c}").alias("distinct_values"),
            )
            for c in columns
        ]
    )
    return one.select(F.inline(entries))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value").limit(n)
    )


def monthly_trend(df: DataFrame, timestamp: str, months: int = 12) -> DataFrame:
    return (
        df.where(F.col(timestamp).isNotNull())
        .groupBy(F.date_format(F.date_trunc("month", timestamp), "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("month")).limit(months)
    )


def extract_report(df: DataFrame, date_text: str) -> DataFrame:
    """Rows, columns, date range and how many dates can be read."""
    day = F.col(date_text).try_cast("date")
    return df.agg(
        F.count("*").alias("row_count"), F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count(day).alias("valid_dates"),
        F.try_divide(F.count(day), F.count("*")).alias("valid_share"),
    )


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Table and column names as rows: metadata, no data is read."""
    rows = [(name, c) for name, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def common_columns(schemas: DataFrame) -> DataFrame:
    tables = schemas.agg(F.countDistinct("table_name").alias("_tables"))
    per_column = schemas.groupBy("column_name").agg(F.countDistinct("table_name").alias("_n"))
    return attach_row(per_column, tables).where("_n = _tables").select("column_name")


def column_overlap(schemas: DataFrame) -> DataFrame:
    """Columns shared by each pair of tables, from the rows of the schemas."""
    a = schemas.withColumnRenamed("table_name", "left_table")
    b = schemas.withColumnRenamed("table_name", "right_table")
    return (
        a.join(b, "column_name").where("left_table <> right_table")
        .groupBy("left_table", "right_table")
        .agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("shared_columns"))
    )


def category_counts(df: DataFrame, category: str) -> DataFrame:
    total = F.count("*")
    return df.groupBy(F.col(category).alias("category")).agg(total.alias("n"))


def stage_flow(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows after each stage and the change to the one before; one count per stage."""
    counted = [
        df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("stage_index"), F.lit(name).alias("stage"), "rows")
        for i, (name, df) in enumerate(stages.items())
    ]
    return reduce(DataFrame.unionByName, counted)


def outcome_shares(df: DataFrame, success: str) -> DataFrame:
    ok = F.count_if(success)
    return df.agg(
        F.count("*").alias("total"), ok.alias("successful"), (F.count("*") - ok).alias("failed"),
        F.try_divide(ok, F.count("*")).alias("success_share"),
    )


def count_check(parts: list[DataFrame], merged: DataFrame) -> DataFrame:
    """Whether a merged table has as many rows as its parts."""
    expected = reduce(DataFrame.unionByName, [p.agg(F.count("*").alias("n")) for p in parts]).agg(F.sum("n").alias("expected_rows"))
    return attach_row(merged.agg(F.count("*").alias("merged_rows")), expected).withColumn(
        "complete", F.col("merged_rows") == F.col("expected_rows")
    )
