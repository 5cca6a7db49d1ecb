"""Candidate, result and campaign records: cleaning, expansion, joins and temporal filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import names as nm
from plenum.functions.dates import excel_serial_to_date, plausible_date, plausible_timestamp, presence
from plenum.functions.text import collapse_spaces, nullif_blank, strip
from plenum.operators.ranking import keep_first


def clean_candidates(df: DataFrame) -> DataFrame:
    """Clean the name, state, office, level and party fields; rows need both names."""
    cleaned = (
        df.withColumn("first_name", nm.clean_name("first_name"))
        .withColumn("last_name", nm.clean_name("last_name"))
        .withColumn("state", nm.clean_state("state"))
        .withColumn("candidate_office", nm.clean_office("candidate_office"))
        .withColumn("official_office_name", nm.clean_office("official_office_name"))
    )
    if "office_level" in df.columns:
        cleaned = cleaned.withColumn("office_level", nm.office_level("office_level"))
    if "party_affiliation" in df.columns:
        cleaned = cleaned.withColumn("party_affiliation", nm.clean_party("party_affiliation"))
    return cleaned.where("first_name is not null and last_name is not null")


def expand_elections(
    df: DataFrame,
    primary: str = "primary_election_date",
    general: str = "general_election_date",
    runoff: str = "runoff_election_date",
    blank_others: bool = True,
) -> DataFrame:
    """One row per election date. Primary and general rows lose the other dates; runoff keeps all."""
    def entry(kind: str, day: str, keep: list[str]) -> Column:
        dates = [
            (F.col(c) if not blank_others or c in keep else F.lit(None).cast(df.schema[c].dataType)).alias(c)
            for c in (primary, general, runoff)
        ]
        return F.struct(F.lit(kind).alias("election_type"), F.col(day).alias("election_date"), *dates)

    entries = F.array(
        entry("primary", primary, [primary]),
        entry("general", general, [general]),
        entry("runoff", runoff, [primary, general, runoff]),
    )
    held = F.filter(entries, lambda e: e["election_date"].isNotNull())
    others = [c for c in df.columns if c not in (primary, general, runoff)]
    return df.select(*others, F.inline(held))


def clean_results(df: DataFrame) -> DataFrame:
    """Title-case candidates, drop rows without candidate or race, derive the state and type."""
    party = nullif_blank("candidate_party", "nan", "None")
    return (
        df.withColumn("candidate", nm.title_case(collapse_spaces(nullif_blank("candidate"))))
        .withColumn("race_name", nullif_blank("race_name"))
        .where("candidate is not null and race_name is not null")
        .withColumn("state", nm.state_of_race("race_name"))
        .where("state is not null")
        .withColumn("candidate_party", party)
        .withColumn("election_type_original", F.col("election_type"))
        .withColumn("election_type", nm.election_type("election_type"))
    )


def clean_sheet_races(df: DataFrame) -> DataFrame:
    """Races of a spreadsheet range; rows need a date, a state and a name."""
    race = F.col("race_name_with_state")
    return (
        df.select(
            excel_serial_to_date("date").alias("date"),
            nm.sheet_state(race).alias("state"),
            F.col("state_election_type").alias("state_election_type_raw"),
            nm.election_type("state_election_type", default="general").alias("election_type"),
            nm.sheet_race_name(race).alias("race_name"),
            "race_name_with_state",
            "race_name_orig",
        )
        .where("date is not null and state is not null")
        .where(strip("race_name") != "")
    )


def clean_companies(df: DataFrame) -> DataFrame:
    """Companies with an office and a state, expanded to one row per election date."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(f"properties_{c}"), F.lit(""))

    base = df.select(
        F.col("id").alias("company_id"),
        F.col("properties_candidate_name").alias("candidate_name"),
        text("candidate_office").alias("office_name"),
        text("official_office_name").alias("official_office_name"),
        text("office_level").alias("office_level"),
        nm.state_code("properties_state").alias("state"),
        text("city").alias("city"),
        text("candidate_district").alias("district"),
        text("candidate_party").alias("party"),
        F.col("properties_primary_date").try_cast("date").alias("primary_date"),
        F.col("properties_election_date").try_cast("date").alias("general_date"),
        F.col("properties_runoff_date").try_cast("date").alias("runoff_date"),
    )
    expanded = expand_elections(base.where(matchable("office_name", "official_office_name", "state")),
                                "primary_date", "general_date", "runoff_date")
    return expanded.drop("primary_date", "general_date", "runoff_date")


def matchable(office: str, official: str, state: str) -> Column:
    has_office = nullif_blank(office).isNotNull() | nullif_blank(official).isNotNull()
    return has_office & F.col(state).isNotNull()


def past_only(df: DataFrame, day: str, as_of: date) -> DataFrame:
    return df.where(F.col(day) < F.lit(as_of))


def slug_mapping(records: DataFrame, candidacies: DataFrame, slugs: DataFrame) -> DataFrame:
    """Record to candidacy to slug, with ids aligned as integer text."""
    def as_id(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0)).cast("bigint").cast("string")

    left = records.withColumn("record_id", F.col("record_id").cast("string"))
    middle = candidacies.select(
        F.col("company_id").cast("string").alias("record_id"),
        as_id("product_campaign_id").alias("product_campaign_id"),
        "full_name",
    )
    right = slugs.select(as_id("product_campaign_id").alias("product_campaign_id"), "candidate_slug")
    return left.join(middle, "record_id", "left").join(right, "product_campaign_id", "left")


def recover_slugs(mapped: DataFrame, campaigns: DataFrame, name: str = "company_name") -> DataFrame:
    """Retry rows without a slug on the slug built from their name; the rest is dropped.

    ``campaigns`` has ``candidate_slug``; duplicates there fan out like the first join did.
    """
    matched = mapped.where("candidate_slug is not null")
    open_rows = mapped.where("candidate_slug is null").withColumn("candidate_slug", nm.slug(name))
    known = campaigns.select("candidate_slug")
    recovered = open_rows.join(known, "candidate_slug")
    return matched.withColumn("recovered", F.lit(False)).unionByName(
        recovered.withColumn("recovered", F.lit(True))
    )


def temporal_match(candidates: DataFrame, results: DataFrame, day: str = "election_date", result_day: str = "election_date") -> DataFrame:
    """Keep records whose date occurs on the other side; runoffs may use the general date.

    Both sides meet on distinct dates only, which the calendar bounds.
    """
    dates = results.select(F.col(result_day).cast("date").alias("_day")).where("_day is not null").distinct()
    direct = dates.withColumn("_direct", F.lit(True))
    marked = candidates.join(direct, candidates[day].cast("date") == direct["_day"], "left").drop("_day")
    fallback = dates.withColumn("_general", F.lit(True))
    runoff_day = F.when(F.col("election_type") == "runoff", F.col("general_election_date").cast("date"))
    marked = marked.join(fallback, runoff_day == fallback["_day"], "left").drop("_day")
    direct_hit = F.coalesce("_direct", F.lit(False))
    general_hit = F.coalesce("_general", F.lit(False))
    return (
        marked.where(direct_hit | general_hit)
        .withColumn("used_general_date", ~direct_hit)
        .drop("_direct", "_general")
    )


def semi_join_dates(df: DataFrame, other: DataFrame, day: str, other_day: str) -> DataFrame:
    dates = other.select(F.col(other_day).alias("_day")).distinct()
    return df.join(dates, df[day] == dates["_day"], "left_semi")


JSON_TEXT = {
    "data": {
        "candidate_name": "name", "candidate_slug": "slug", "crm_id": "hubspotId", "current_step": "currentStep",
        "launch_status": "launchStatus", "data_party": "party", "created_by": "createdBy",
        "admin_user_email": "adminUserEmail",
    },
    "details": {
        "state": "state", "office": "office", "other_office": "otherOffice", "level": "level",
        "ballot_level": "ballotLevel", "party": "party", "partisan_type": "partisanType", "district": "district",
        "zip_code": "zip", "city": "city", "county": "county", "tier": "tier", "knows_running": "knowRun",
        "has_pledged": "pledged", "has_primary": "hasPrimary", "office_term_length": "officeTermLength",
        "occupation": "occupation", "fun_fact": "funFact", "campaign_website": "website",
        "past_experience": "pastExperience", "election_id": "electionId",
        "primary_election_id": "primaryElectionId", "position_id": "positionId", "race_id": "raceId",
    },
    "progress": {
        "p2v_status": "p2vStatus", "election_kind": "electionType", "election_location": "electionLocation",
    },
}
JSON_DATES = {
    "details": {
        "election_date": "electionDate", "filing_period_start": "filingPeriodsStart",
        "filing_period_end": "filingPeriodsEnd", "primary_election_date": "primaryElectionDate",
    },
    "progress": {"p2v_complete_date": "p2vCompleteDate"},
}
JSON_COUNTS = {"progress": {"p2v_win_number": "winNumber", "average_turnout": "averageTurnout",
                            "projected_turnout": "projectedTurnout"}}
PRESENCE = {"zip_code": [], "city": [], "county": [], "district": [], "occupation": [],
            "campaign_website": ["skipped"], "past_experience": []}


def campaign_fields(df: DataFrame, data: str = "data", details: str = "details", progress: str = "progress_data") -> DataFrame:
    """Typed fields out of three JSON text columns; nothing that cannot be read fails the row.

    Each JSON column is parsed once into a variant and the paths are read from that.
    """
    sources = {"data": data, "details": details, "progress": progress}
    parsed = df
    for name, c in sources.items():
        parsed = parsed.withColumn(f"_{name}", F.try_parse_json(F.col(c)))

    def text(source: str, path: str) -> Column:
        return F.try_variant_get(F.col(f"_{source}"), f"$.{path}", "string")

    fields = [text(s, p).alias(n) for s, paths in JSON_TEXT.items() for n, p in paths.items()]
    fields += [plausible_date(text(s, p)).alias(n) for s, paths in JSON_DATES.items() for n, p in paths.items()]
    fields += [
        text(s, p).try_cast("double").try_cast("int").alias(n) for s, paths in JSON_COUNTS.items() for n, p in paths.items()
    ]
    visited = text("data", "lastVisited").try_cast("bigint")
    fields.append(F.when(visited > 0, F.timestamp_millis(visited)).alias("last_visited_date"))
    base = [c for c in df.columns if c not in (data, details, progress)]
    created = plausible_timestamp("created_at")
    out = parsed.select(*base, *fields, created.alias("account_creation_date"),
                        plausible_timestamp("updated_at").alias("account_update_date"),
                        text("details", "electionDate").alias("_election_text"))
    flags = {f"has_{c.removeprefix('campaign_')}": presence(c, "", *empty) for c, empty in PRESENCE.items()}
    flags |= {
        "has_election_date": presence("_election_text", ""),
        "has_p2v_data": F.col("p2v_status").isNotNull().cast("int"),
        "p2v_complete": F.coalesce((F.col("p2v_status") == "Complete").cast("int"), F.lit(0)),
        "is_launched": F.coalesce((F.col("launch_status") == "launched").cast("int"), F.lit(0)),
        "admin_created": F.coalesce((F.col("created_by") == "admin").cast("int"), F.lit(0)),
        "creation_month": F.date_trunc("month", "account_creation_date"),
        "creation_year": F.year("account_creation_date"),
        "creation_month_num": F.month("account_creation_date"),
    }
    return out.withColumns(flags).drop("_election_text")


def open_campaigns(campaigns: DataFrame, progress: DataFrame, since: date = date(2024, 1, 1)) -> DataFrame:
    """Campaigns with a state and an office but no position and no race, with their progress."""
    joined = campaigns.join(
        progress.select(F.col("campaign_id").alias("id"), F.col("data").alias("progress_data")), "id", "left"
    )
    created = F.col("created_at").try_cast("timestamp")
    in_time = (created >= F.lit(since)) & F.year(created).between(2020, 2030)
    typed = campaign_fields(joined.where(in_time))

    def said(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    return typed.where(~said("position_id") & ~said("race_id") & said("state") & said("office") & (F.col("office") != "Other"))


def last_message_per_phone(messages: DataFrame, order: list[Column]) -> DataFrame:
    """The last message of each phone by an explicit order."""
    return keep_first(messages, ["phone_number"], order)


def attach_messages(atoms: DataFrame, messages: DataFrame, order: list[Column]) -> DataFrame:
    """Atomic results with the last message of their phone; atoms without one are left out."""
    last = last_message_per_phone(messages, order)
    clash = [c for c in last.columns if c in atoms.columns and c != "phone_number"]
    return atoms.where(F.coalesce("phone_number", F.lit("")) != "").join(last.drop(*clash), "phone_number")


def merge_state_files(parts: list[DataFrame], keys: tuple[str, str] = ("state", "id")) -> DataFrame:
    """All state tables in one, ordered by state and id (a range-partitioned sort)."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.orderBy(*keys)


def existing_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def infer_runoff_types(results: DataFrame) -> DataFrame:
    """Per candidate whether its runoff belongs to the primary or the general election."""
    def first(kind: str) -> Column:
        return F.min(F.when(F.col("election_type") == kind, F.col("date")))

    dates = results.groupBy("candidate_id").agg(
        first("primary").alias("_p"), first("general").alias("_g"), first("runoff").alias("_r"),
    )
    p, g, r = F.col("_p"), F.col("_g"), F.col("_r")
    kind = (
        F.when(p.isNotNull() & g.isNull(), "primary")
        .when(p.isNotNull() & g.isNotNull() & (p < r) & (r < g), "primary")
        .otherwise("general")
    )
    return dates.where(r.isNotNull()).select("candidate_id", kind.alias("runoff_type"))


def discover_runoffs(matches: DataFrame, results: DataFrame) -> DataFrame:
    """Matched records whose candidate also has a runoff, with that runoff (the latest)."""
    runoff = keep_first(
        results.where(F.col("election_type") == "runoff"), ["candidate_id"], [F.desc("date"), F.col("race_id")]
    ).select(
        "candidate_id", F.col("date").alias("runoff_date"), F.col("race_id").alias("runoff_race_id"),
        F.col("race_name").alias("runoff_race_name"), F.col("candidate").alias("runoff_candidate"),
    )
    found = runoff.join(infer_runoff_types(results), "candidate_id")
    matched = matches.where(F.col("has_match") & F.col("matched_candidate_id").isNotNull())
    return matched.join(found, matched["matched_candidate_id"] == found["candidate_id"]).drop("candidate_id")


def synthetic_runoffs(discovered: DataFrame) -> DataFrame:
    """New runoff records to be matched like any other."""
    return discovered.select(
        "candidacy_id", "first_name", "last_name", "full_name", "state", "city", "candidate_office",
        "official_office_name", "party_affiliation",
        nm.candidate_race_text("first_name", "last_name", "official_office_name", "candidate_office", "state").alias(
            "embedding_text"
        ),
        F.col("runoff_date").alias("election_date"),
        F.lit("runoff").alias("election_type"),
        F.lit(True).alias("is_synthetic_runoff"),
        F.col("matched_candidate_id").alias("discovered_from_candidate_id"),
    )


def merge_runoffs(original: DataFrame, synthetic: DataFrame, dates: tuple[str, ...] = ("election_date", "matched_date")) -> DataFrame:
    """Original and synthetic matches in one table; dates that cannot be read become null."""
    def coerced(df: DataFrame) -> DataFrame:
        present = {c: F.col(c).try_cast("timestamp") for c in dates if c in df.columns}
        return df.withColumns(present) if present else df

    marked = original.withColumn("is_synthetic_runoff", F.lit(False)).withColumn(
        "discovered_from_candidate_id", F.lit(None).cast("bigint")
    )
    return coerced(marked).unionByName(coerced(synthetic), allowMissingColumns=True)


def runoff_counts(discovered: DataFrame, top_states: int = 5) -> DataFrame:
    """Runoffs by type, and the states with most of them."""
    by_type = discovered.groupBy(F.lit("type").alias("dimension"), F.col("runoff_type").alias("value")).agg(
        F.count("*").alias("n")
    )
    by_state = (
        discovered.groupBy(F.lit("state").alias("dimension"), F.col("state").alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(top_states)
    )
    return by_type.unionByName(by_state)
