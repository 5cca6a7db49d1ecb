"""Scoped access, privacy scans and publishing checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.privacy import breaks_fence, has_dangerous_markup, pii_matches, string_leaves


def scoped(
    df: DataFrame, state: str, cities: list[str] | None = None, state_column: str = "state", city_column: str = "city",
) -> DataFrame:
    """The rows a caller may see. The filter comes first and cannot be widened later."""
    view = df.where(F.col(state_column) == state)
    return view.where(F.col(city_column).isin(cities)) if cities else view


def scoped_view(df: DataFrame, name: str, state: str, cities: list[str] | None = None, **columns: str) -> DataFrame:
    """Register the scoped rows as a view; hand out the view, not the table."""
    view = scoped(df, state, cities, **columns)
    view.createOrReplaceTempView(name)
    return view


def row_capped(df: DataFrame, max_rows: int, order: list[str]) -> DataFrame:
    """The first ``max_rows`` rows by ``order``, each with ``row_cap_hit``: were there more?

    Only a caller who wants a preview caps; no other function does. One row more than the cap
    is read to know whether it cut anything.
    """
    some = df.orderBy(*order).limit(max_rows + 1)
    flagged = some.withColumn("row_cap_hit", F.count("*").over(Window.partitionBy()) > max_rows)
    return flagged.orderBy(*order).limit(max_rows)


def scan_text(df: DataFrame, text: str, *ids: str) -> DataFrame:
    """One row per privacy hit in a text column."""
    hits = df.select(*ids, F.posexplode(pii_matches(text)).alias("match_index", "_m"))
    return hits.select(*ids, "match_index", "_m.*")


def scan_records(df: DataFrame, *ids: str) -> DataFrame:
    """Privacy hits in every string of a row, nested ones with their path."""
    leaves = df.select(*ids, F.explode(string_leaves(df, *ids)).alias("_leaf"))
    hits = leaves.select(*ids, F.col("_leaf.field_path").alias("field_path"), F.explode(pii_matches("_leaf.value")).alias("_m"))
    return hits.select(*ids, "field_path", "_m.*")


def publish_findings(df: DataFrame, *ids: str) -> DataFrame:
    """Unsafe markup and fence breakouts in every string of a row, with the path."""
    leaves = df.select(*ids, F.explode(string_leaves(df, *ids)).alias("_leaf"))
    value = F.col("_leaf.value")
    kinds = F.array_compact(
        F.array(
            F.when(has_dangerous_markup(value), F.lit("raw_html")),
            F.when(breaks_fence(value), F.lit("fence_breakout")),
        )
    )
    return leaves.select(*ids, F.col("_leaf.field_path").alias("field_path"), F.explode(kinds).alias("finding"))
