"""Positions or users matched to the districts of their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import districts as ds
from plenum.operators import matching as mt
from plenum.session import cut_lineage


def match_districts(
    positions: DataFrame, districts: DataFrame, generic: DataFrame, key: str = "position_id", name: str = "name",
    city: str | None = None, variant: str = "best_only", score=None,
) -> DataFrame:
    """One row per position with its district, the ranked list as text, and placeholders.

    ``districts`` has ``district_id``, name, type, state and ``embedding``; ``generic`` one
    ``query_vector``. With ``city`` the city boost and the stricter municipal threshold apply.
    """
    ids = dict(query_id=key, candidate_id="district_id", query_vector="embedding", candidate_vector="embedding")
    ranked = ds.district_topk(positions, districts, city=city, **ids)
    offers = ds.generic_topk(districts, generic, candidate_id="district_id", query_vector="query_vector", candidate_vector="embedding")
    # at most 13 rows per position, read twice below: written once
    full = cut_lineage(ds.inject_generic(ranked, positions, offers, key, variant))
    sides = districts.select(F.col("district_id").alias("candidate_id"), "district_name", "district_type", F.col("state").alias("district_state"))
    records = positions.select(F.col(key).alias("query_id"), F.col(name).alias("_name"), "state")
    listed = full.join(sides, "candidate_id").join(records, "query_id")
    chosen = mt.select_candidate(
        listed, score if score is not None else mt.lexical_score(F.col("_name"), F.col("district_name"), F.col("state") == F.col("district_state")),
        ["query_id"], ["district_name", "district_type", "score"],
    )
    summary = ds.embedding_summary(listed, ["query_id"])
    choice = chosen.join(summary, "query_id").withColumnRenamed("query_id", key)
    threshold = mt.district_threshold("office", city) if city else 60
    return ds.district_records(positions.drop("embedding"), choice, key, threshold)
