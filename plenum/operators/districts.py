"""Matching of positions and users to districts inside their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import nullif_blank
from plenum.operators.matching import Pair, block_topk
from plenum.operators.ranking import attach_row

LIST_SIZE = 13
GENERIC_RANK = 11
CITY_BOOST = 0.15


def district_topk(positions: DataFrame, districts: DataFrame, k: int = LIST_SIZE, city: str | None = None, **ids: str) -> DataFrame:
    """The most similar districts of the same state; a district named after the city gains 0.15."""
    if city is None:
        return block_topk(positions, districts, ["state"], k, **ids)
    boosted = positions.withColumn("_city", F.upper(F.coalesce(nullif_blank(city), F.lit(""))))
    named = districts.withColumn("_name", F.upper(F.col("district_name")))
    return block_topk(boosted, named, ["state"], k, pair=Pair(boost=("_city", "_name", CITY_BOOST)), **ids)


def generic_topk(districts: DataFrame, generic: DataFrame, k: int = LIST_SIZE + 1, **ids: str) -> DataFrame:
    """Per state the districts nearest to the generic query, best first.

    ``generic`` has one vector; ``k`` one above the list size is enough to find one district
    outside any list.
    """
    states = districts.select("state").distinct()
    queries = attach_row(states, generic.limit(1))
    found = block_topk(
        queries.withColumn("query_id", F.col("state")), districts, ["state"], k,
        query_id="query_id", **{key: value for key, value in ids.items() if key != "query_id"},
    )
    return found.withColumnRenamed("query_id", "state")


def inject_generic(
    ranked: DataFrame, positions: DataFrame, generic: DataFrame, query_id: str, variant: str = "best_only"
) -> DataFrame:
    """Put one generic candidate at rank 11 of lists with at least 11 entries, cut to 13.

    ``best_only`` offers the state's best generic district and drops the offer when the list
    has it already; ``best_of_rest`` offers the best one that the list lacks. Both sides are
    arrays of at most 14 entries, so the offer is an array expression, not a join of pairs.
    """
    take = 1 if variant == "best_only" else LIST_SIZE + 1
    offers = generic.where(F.col("rank") <= take).groupBy("state").agg(
        F.sort_array(F.collect_list(F.struct("rank", "candidate_id", "score"))).alias("_offers")
    )
    lists = ranked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "candidate_id", "score"))).alias("_list")
    )
    joined = (
        lists.join(positions.select(F.col(query_id).alias("query_id"), "state"), "query_id")
        .join(offers, "state", "left")
    )
    taken = F.transform("_list", lambda e: e["candidate_id"])
    fresh = F.get(F.filter("_offers", lambda o: ~F.array_contains(taken, o["candidate_id"])), F.lit(0))
    head, tail = F.slice("_list", 1, GENERIC_RANK - 1), F.slice("_list", GENERIC_RANK, LIST_SIZE)
    applies = (F.size("_list") >= GENERIC_RANK) & F.col("_fresh").isNotNull()
    merged = F.when(applies, F.slice(F.concat(head, F.array("_fresh"), tail), 1, LIST_SIZE)).otherwise(F.col("_list"))
    return (
        joined.withColumn("_fresh", fresh)
        .select("query_id", "_fresh", F.posexplode(merged).alias("_pos", "_entry"))
        .select(
            "query_id", F.col("_entry.candidate_id").alias("candidate_id"), F.col("_entry.score").alias("score"),
            (F.col("_pos") + 1).alias("rank"),
            ((F.col("_pos") + 1 == GENERIC_RANK) & (F.col("_entry.candidate_id") == F.col("_fresh.candidate_id"))
             & F.col("_fresh").isNotNull()).alias("is_generic"),
        )
    )


def district_records(
    positions: DataFrame, chosen: DataFrame, key: str = "position_id", threshold: Column | float = 60
) -> DataFrame:
    """One row per position with placeholders where there is no district to name.

    ``chosen`` has the selected district per position; a position without a row there had no
    reference data for its state.
    """
    joined = positions.join(chosen.withColumn("_found", F.lit(True)), key, "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    matched = found & F.coalesce(F.col("confidence") >= threshold, F.lit(False))

    def name(c: str) -> Column:
        return F.when(matched, F.col(c)).when(found, F.lit("NOT_MATCHED")).otherwise(F.lit("NO_VECTOR_STORE"))

    reason = F.when(
        ~found, F.concat(F.lit("No vector store available for state "), F.coalesce("state", F.lit("")))
    ).when(~matched, "Below the confidence threshold").otherwise("Best lexical score")
    return (
        joined.withColumn("is_matched", matched)
        .withColumn("reason", reason)
        .withColumn("_name", name("district_name"))
        .withColumn("_type", name("district_type"))
        .withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
        .drop("district_name", "district_type", "_found")
        .withColumnsRenamed({"_name": "district_name", "_type": "district_type"})
    )


def embedding_summary(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The ranked list as ``type - name (0.123)`` joined with a bar, and the top score."""
    line = F.concat(
        F.col("district_type"), F.lit(" - "), F.col("district_name"), F.lit(" ("),
        F.format_number("score", 3), F.lit(")"),
    )
    listed = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda e: e["line"]), " | ").alias("embeddings"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_embedding_score"),
    )


def error_rows(matches: DataFrame) -> DataFrame:
    """Rows whose matching failed and should be tried again."""
    failed = F.lower(F.col("reason")).contains("processing error") | (F.col("district_name") == "QUOTA_ERROR")
    return matches.where(F.coalesce(failed, F.lit(False)))


def patch_rows(matches: DataFrame, retried: DataFrame) -> DataFrame:
    """Overwrite rows with their retried version, by id, else database id, else name and state."""
    shared = [c for c in retried.columns if c in matches.columns]
    if "id" in shared:
        keys = ["id"]
    elif "database_id" in shared:
        keys = ["database_id"]
    else:
        keys = ["name", "state"]
    values = [c for c in shared if c not in keys]
    fresh = retried.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_new"))
    joined = matches.join(fresh, keys, "left")
    updated = [
        (F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c))
        for c in matches.columns
    ]
    return joined.select(*updated)
