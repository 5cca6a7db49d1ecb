"""Queries on candidate, result, campaign and plan records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from plenum.catalog import sqltext as q
from plenum.catalog import views as v
from plenum.functions import dates as dt
from plenum.functions import fixed
from plenum.functions import names as nm
from plenum.operators import districts as ds
from plenum.operators import profile as pf
from plenum.operators import ranking as rk
from plenum.operators import records as rc
from plenum.operators import usage as us
from plenum.sources import readers as rd

C, R = v.candidates_sql(), v.results_sql()
AS_OF = date(1998, 8, 1)


def _clean_fields(spark, d):
    return v.candidates(spark, d).select(
        "candidacy_id", nm.clean_name("first_name").alias("first_name"), nm.clean_name("last_name").alias("last_name"),
        nm.clean_state("state").alias("state"), nm.clean_office("candidate_office").alias("office"),
        nm.office_level("office_level").alias("level"), nm.clean_party("party_affiliation").alias("party"),
    )


CLEAN_FIELDS = f"""WITH {C} SELECT candidacy_id, {q.clean_name('first_name')} AS first_name, {q.clean_name('last_name')} AS last_name,
  {q.clean_state('state')} AS state, {q.clean_office('candidate_office')} AS office, {q.office_level('office_level')} AS level,
  {q.clean_party('party_affiliation')} AS party FROM raw_candidates"""

CLEANED = f"""{C}, cleaned AS (SELECT * FROM (SELECT candidacy_id, full_name, city, primary_election_date AS p, general_election_date AS g,
  runoff_election_date AS r, {q.clean_name('first_name')} AS first_name, {q.clean_name('last_name')} AS last_name, {q.clean_state('state')} AS state,
  {q.clean_office('candidate_office')} AS candidate_office, {q.clean_office('official_office_name')} AS official_office_name,
  {q.office_level('office_level')} AS office_level, {q.clean_party('party_affiliation')} AS party_affiliation FROM raw_candidates)
  WHERE first_name IS NOT NULL AND last_name IS NOT NULL),
  expanded AS (SELECT * EXCLUDE (p, g, r), 'primary' AS election_type, p AS election_date, p AS primary_election_date, NULL::DATE AS general_election_date, NULL::DATE AS runoff_election_date
    FROM cleaned WHERE p IS NOT NULL UNION ALL SELECT * EXCLUDE (p, g, r), 'general', g, NULL, g, NULL FROM cleaned WHERE g IS NOT NULL
    UNION ALL SELECT * EXCLUDE (p, g, r), 'runoff', r, p, g, r FROM cleaned WHERE r IS NOT NULL)"""
EXPANDED_COLUMNS = ["candidacy_id", "first_name", "last_name", "state", "candidate_office", "official_office_name", "office_level",
                    "party_affiliation", "election_type", "election_date", "primary_election_date", "general_election_date", "runoff_election_date"]


def expanded(spark, d):
    return rc.expand_elections(rc.clean_candidates(v.candidates(spark, d)))


CLEAN_RESULTS_CTE = f"""{R}, results AS (SELECT * FROM (SELECT result_id, {q.title_case(q.collapse(q.nullif_blank('candidate')))} AS candidate,
  {q.nullif_blank('race_name')} AS race_name, {q.nullif_blank('candidate_party', 'nan', 'None')} AS candidate_party, is_winner, race_id, candidate_id,
  {q.election_type('election_type')} AS election_type, election_type AS election_type_original, election_date,
  {q.clean_state(f"upper(left({q.nullif_blank('race_name')}, 2))")} AS state FROM raw_results
  WHERE {q.nullif_blank('candidate')} IS NOT NULL) WHERE state IS NOT NULL)"""


def clean_results(spark, d):
    return rc.clean_results(v.results(spark, d))


def _temporal_match(spark, d):
    # some days are moved out of reach, so that the general date has to serve
    day = F.when(F.col("election_date") < "2024-12-10", F.col("election_date")).otherwise(F.date_add("election_date", 4000))
    results = clean_results(spark, d).withColumn("election_date", day)
    return rc.temporal_match(expanded(spark, d), results).select(
        "candidacy_id", "election_type", "election_date", "used_general_date"
    )


TEMPORAL_MATCH = f"""WITH {CLEANED}, {CLEAN_RESULTS_CTE}, days AS (SELECT DISTINCT CASE WHEN election_date < DATE '2024-12-10' THEN election_date ELSE election_date + 4000 END AS day FROM results)
  SELECT candidacy_id, election_type, election_date, NOT hit AS used_general_date FROM (SELECT *, election_date IN (SELECT day FROM days) AS hit,
  coalesce(election_type = 'runoff' AND general_election_date IN (SELECT day FROM days), FALSE) AS general_hit FROM expanded) WHERE hit OR general_hit"""


def _semi_join_dates(spark, d):
    # lines of small quantity have no day, so that some orders find none
    li = v.table(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 49, F.col("l_shipdate")).alias("l_shipdate"))
    o = v.table(spark, d, "orders")
    return rc.semi_join_dates(o, li, "o_orderdate", "l_shipdate").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


def _race_texts(spark, d):
    c = v.candidates(spark, d)
    return c.select(
        "candidacy_id", nm.candidate_race_text("first_name", "last_name", "official_office_name", "candidate_office", "state").alias("race_text"),
        nm.city_race_text("city", "candidate_office", "official_office_name").alias("city_text"),
        nm.district_text("party_affiliation", "office_level", "full_name").alias("district_text"),
    )


RACE_TEXTS = f"""WITH {C} SELECT candidacy_id, 'name: ' || coalesce(first_name || ' ' || last_name, '') || ' | race: ' ||
    coalesce(official_office_name, {q.strip("coalesce(state, '') || ' ' || candidate_office")}, '') AS race_text,
  CASE WHEN {q.nullif_blank('city')} IS NOT NULL THEN 'city:' || {q.nullif_blank('city')} || ' | race:' || o ELSE o END AS city_text,
  'state: ' || party_affiliation || ', district type: ' || office_level || ', district name: ' || full_name AS district_text
  FROM (SELECT *, coalesce({q.nullif_blank('candidate_office')}, {q.nullif_blank('official_office_name')}, '') AS o FROM raw_candidates)"""


def _result_texts(spark, d):
    return v.results(spark, d).select("result_id", nm.result_race_text("candidate", "race_name").alias("race_text"))


def _district_queries(spark, d):
    c = v.candidates(spark, d)
    office, state = nm.coalesce_location("candidate_office"), nm.coalesce_location("state")
    city, county = nm.coalesce_location("city", "state"), nm.coalesce_location("official_office_name")
    return c.select(
        "candidacy_id", nm.district_query_text(office, state, city, county, F.lit(None).cast("string")).alias("query_text"),
        nm.is_municipal("candidate_office").alias("is_municipal"), nm.is_federal("candidate_office").alias("is_federal"),
        nm.has_city("city").alias("has_city"), rc.matchable("candidate_office", "official_office_name", "state").alias("is_matchable"),
    )


def _loc(*xs: str) -> str:
    inner = "coalesce(" + ", ".join(q.nullif_blank(x) for x in xs) + ")"
    return f"CASE WHEN lower({inner}) <> 'none' THEN {inner} END"


DISTRICT_QUERIES = f"""WITH {C}, parts AS (SELECT *, {_loc('candidate_office')} AS o, {_loc('state')} AS s, {_loc('city', 'state')} AS c, {_loc('official_office_name')} AS n FROM raw_candidates),
  joined AS (SELECT *, concat_ws(' | ', CASE WHEN regexp_matches(lower(o), '{'|'.join(fixed.MUNICIPAL_WORDS)}') AND c IS NOT NULL THEN 'district type: ' || o || ', district name: ' || c
    ELSE 'district type: ' || o END, 'district name: ' || c, 'county: ' || n) AS t FROM parts)
  SELECT candidacy_id, CASE WHEN t <> '' THEN t ELSE 'position in ' || coalesce(s, '') END AS query_text,
  coalesce(regexp_matches(lower(candidate_office), '{'|'.join(fixed.MUNICIPAL_WORDS)}'), FALSE) AS is_municipal,
  coalesce(regexp_matches(lower(candidate_office), '{'|'.join(fixed.FEDERAL_WORDS)}'), FALSE) AS is_federal,
  lower(city) NOT IN ('none', '', 'n/a') AS has_city,
  ({q.nullif_blank('candidate_office')} IS NOT NULL OR {q.nullif_blank('official_office_name')} IS NOT NULL) AND state IS NOT NULL AS is_matchable FROM joined"""


def _election_types(spark, d):
    o = v.table(spark, d, "orders")
    raw = v.pick([*v.RESULT_TYPES, ""], F.col("o_orderkey") % (len(v.RESULT_TYPES) + 1))
    return o.select(F.col("o_orderkey").alias("result_id"), nm.election_type(raw).alias("election_type"), nm.election_type(raw, "general").alias("sheet_type"))


RAW_TYPE = v.sql_pick([*v.RESULT_TYPES, ""], f"o_orderkey % {len(v.RESULT_TYPES) + 1}")


def _small_codes(spark, d):
    c = v.table(spark, d, "customer")
    k = F.col("c_custkey")
    phone = F.concat(F.when(k % 2 == 0, "+1 (").otherwise("("), F.lpad((k % 1000).cast("string"), 3, "5"), F.lit(") 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    return c.select(
        "c_custkey", nm.state_code(v.pick(v.STATES, k % len(v.STATES))).alias("state_code"), nm.slug(F.concat("c_name", F.lit(" & Sons "), "c_mktsegment")).alias("slug"),
        nm.normalise_phone(phone).alias("phone"), dt.excel_serial_to_date(v.pick(v.SERIALS, k % len(v.SERIALS))).alias("sheet_date"),
        nm.state_of_race(F.concat(v.pick(v.STATES, k % len(v.STATES)), F.lit(" Race"))).alias("race_state"),
    )


PHONE = "CASE WHEN c_custkey % 2 = 0 THEN '+1 (' ELSE '(' END || lpad((c_custkey % 1000)::VARCHAR, 3, '5') || ') 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')"
STATE_PICK = v.sql_pick(v.STATES, f"c_custkey % {len(v.STATES)}")
SMALL_CODES = f"""SELECT c_custkey, {q.state_code(STATE_PICK)} AS state_code, {q.slug("c_name || ' & Sons ' || c_mktsegment")} AS slug, {q.phone(PHONE)} AS phone,
  DATE '1899-12-30' + (CASE WHEN regexp_full_match({q.strip('serial')}, '[0-9]+') THEN {q.strip('serial')}::INTEGER END) AS sheet_date,
  {q.clean_state(f"upper(left({STATE_PICK} || ' Race', 2))")} AS race_state
  FROM (SELECT *, {v.sql_pick(v.SERIALS, f'c_custkey % {len(v.SERIALS)}')} AS serial FROM customer)"""


def _sheet_rows(spark, d):
    k = F.col("o_orderkey")
    raw = v.table(spark, d, "orders").select(
        k.cast("string").alias("_c0"), v.pick(v.SERIALS, k % len(v.SERIALS)).alias("_c1"),
        v.pick(v.RESULT_TYPES, k % len(v.RESULT_TYPES)).alias("_c2"), v.pick(v.SHEET_RACES, k % len(v.SHEET_RACES)).alias("_c3"),
    )
    return rc.clean_sheet_races(rd.sheet_range(raw)).groupBy("date", "state", "election_type", "race_name").agg(F.count("*").alias("n"))


SHEET_ROWS = f"""SELECT date, state, election_type, race_name, count(*) AS n FROM (
  SELECT DATE '1899-12-30' + (CASE WHEN regexp_full_match({q.strip('serial')}, '[0-9]+') THEN {q.strip('serial')}::INTEGER END) AS date,
    nullif(regexp_extract(race, '^([A-Z]{{2}})\\s+', 1), '') AS state, {q.election_type('kind', 'general')} AS election_type,
    regexp_replace(regexp_replace(race, '^[A-Z]{{2}}\\s+', ''), '\\s+(?:General|Primary|Runoff|Special)$', '') AS race_name
  FROM (SELECT {v.sql_pick(v.SERIALS, f'o_orderkey % {len(v.SERIALS)}')} AS serial, {v.sql_pick(v.RESULT_TYPES, f'o_orderkey % {len(v.RESULT_TYPES)}')} AS kind,
    {v.sql_pick(v.SHEET_RACES, f'o_orderkey % {len(v.SHEET_RACES)}')} AS race FROM orders)) WHERE date IS NOT NULL AND state IS NOT NULL AND trim(race_name) <> '' GROUP BY ALL"""


def _companies(spark, d):
    k = F.col("c_custkey")
    raw = v.table(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("properties_candidate_name"), v.pick(v.OFFICES, k % len(v.OFFICES)).alias("properties_candidate_office"),
        F.when(k % 2 == 0, v.pick(v.OFFICES, k % 5)).alias("properties_official_office_name"), v.pick(v.LEVELS, k % len(v.LEVELS)).alias("properties_office_level"),
        v.pick(v.STATES, k % len(v.STATES)).alias("properties_state"), v.pick(v.CITIES, k % len(v.CITIES)).alias("properties_city"),
        F.lit(None).cast("string").alias("properties_candidate_district"), v.pick(v.PARTIES, k % len(v.PARTIES)).alias("properties_candidate_party"),
        F.when(k % 4 == 0, "2024-03-05").when(k % 4 == 1, "soon").alias("properties_primary_date"),
        F.when(k % 3 != 0, "2024-11-05").alias("properties_election_date"), F.when(k % 9 == 0, "2024-12-03").alias("properties_runoff_date"),
    )
    return rc.clean_companies(raw).select("company_id", "office_name", "state", "election_type", "election_date")


COMPANIES = f"""WITH c AS (SELECT * FROM (SELECT c_custkey AS company_id, {v.sql_pick(v.OFFICES, f'c_custkey % {len(v.OFFICES)}')} AS office_name,
    CASE WHEN c_custkey % 2 = 0 THEN {v.sql_pick(v.OFFICES, 'c_custkey % 5')} ELSE '' END AS official, {q.state_code(STATE_PICK)} AS state FROM customer)
    WHERE (trim(office_name) <> '' OR trim(official) <> '') AND state IS NOT NULL),
  e AS (SELECT *, 'primary' AS election_type, DATE '2024-03-05' AS election_date FROM c WHERE company_id % 4 = 0 UNION ALL
    SELECT *, 'general', DATE '2024-11-05' FROM c WHERE company_id % 3 <> 0 UNION ALL SELECT *, 'runoff', DATE '2024-12-03' FROM c WHERE company_id % 9 = 0)
  SELECT company_id, office_name, state, election_type, election_date FROM e"""


def _past_only(spark, d):
    return rc.past_only(v.table(spark, d, "orders"), "o_orderdate", AS_OF).groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def _calendar(spark, d):
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    election = F.date_add(day, (k % 120 - 10).cast("int"))
    o = v.table(spark, d, "orders").withColumn("day", day).withColumn("election", election)
    o = o.withColumn("primary_day", F.date_sub("election", (F.col("o_orderkey") % 90 + 1).cast("int")))
    w1, w2 = dt.opening_window("election", F.col("day")), dt.closing_window("primary_day", "election")
    return o.select(
        "o_orderkey", dt.week_before_election("day", "election").alias("week"), dt.deadline_days("day", "election").alias("deadline"),
        dt.contact_goal(k).alias("contact_goal"), F.round(dt.contact_budget(k), 4).alias("budget"),
        w1["start_date"].alias("open_start"), w1["end_date"].alias("open_end"), w2["start_date"].alias("close_start"),
        dt.plausible_date(F.date_add("day", 10_000), last="2024-12-31").alias("plausible"),
    )


CALENDAR = """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate::DATE + (o_orderkey % 120 - 10)::INTEGER AS election FROM orders),
  p AS (SELECT *, election - (o_orderkey % 90 + 1)::INTEGER AS primary_day, election - day AS d FROM o),
  s AS (SELECT *, CASE WHEN d > 52 THEN election - 49 ELSE day + 3 END AS s1, greatest(primary_day + 1, election - 49) AS s2, day + 10000 AS far FROM p)
  SELECT o_orderkey, CASE WHEN d < 0 THEN 1 ELSE (d // 7 + 1)::INTEGER END AS week, CASE WHEN d >= 0 THEN d::INTEGER END AS deadline,
  o_orderkey * 3 AS contact_goal, round(o_orderkey * 3 * 0.30::DOUBLE / 0.60::DOUBLE, 4) AS budget,
  least(CASE WHEN s1 >= election THEN day ELSE s1 END, election) AS open_start, election AS open_end,
  least(CASE WHEN s2 >= election THEN primary_day + 1 ELSE s2 END, election) AS close_start,
  CASE WHEN far BETWEEN DATE '2020-01-01' AND DATE '2024-12-31' THEN far END AS plausible FROM s"""

EVENTS = ["Campaign launch party", "Write a social media post", "Town hall meeting", "Filing deadline", "Door knocking", "Candidate forum debate"]
DESCRIPTIONS = ["Candidate intro text", "Election day reminder", "Contrast on experience", "Mail ballot chase", "General outreach"]


def _task_routing(spark, d):
    o = v.table(spark, d, "orders")
    k = F.col("o_orderkey")
    event, text = v.pick(EVENTS, k % len(EVENTS)), v.pick(DESCRIPTIONS, k % len(DESCRIPTIONS))
    return o.select("o_orderkey", dt.template_theme(text).alias("template_theme"), dt.event_routing(event).alias("r")).select("o_orderkey", "template_theme", "r.*")


def _routing_sql() -> str:
    themes = " ".join(f"WHEN regexp_matches(lower(t), {v.quoted('|'.join(w))}) THEN '{th}'" for w, th in fixed.THEME_WORDS)

    def column(i: int, name: str) -> str:
        cases = " ".join(f"WHEN regexp_matches(lower(e), {v.quoted('|'.join(w))}) THEN {v.quoted(r[i])}" for w, r in fixed.EVENT_WORDS)
        return f"CASE {cases} ELSE {v.quoted(fixed.EVENT_DEFAULT[i])} END AS {name}"

    return f"""SELECT o_orderkey, CASE {themes} ELSE '{fixed.THEME_DEFAULT}' END AS template_theme, {column(0, 'flow_type')}, {column(1, 'cta')}, {column(2, 'theme')}
      FROM (SELECT o_orderkey, {v.sql_pick(EVENTS, f'o_orderkey % {len(EVENTS)}')} AS e, {v.sql_pick(DESCRIPTIONS, f'o_orderkey % {len(DESCRIPTIONS)}')} AS t FROM orders)"""


def _parse_dates(spark, d):
    """Plan dates written in four ways, and one that cannot be read."""
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, F.upper(F.date_format(day, "MMMM d"))).when(k % 5 == 1, F.concat(F.lit("["), F.date_format(day, "MMM d"), F.lit("]")))
        .when(k % 5 == 2, F.date_format(day, "M/d")).when(k % 5 == 3, F.date_format(day, "MMMM d, yyyy")).otherwise("sometime soon")
    )
    election = F.make_date(F.year(day), F.lit(11), F.lit(3))
    return v.table(spark, d, "orders").select("o_orderkey", dt.parse_campaign_date(text, election, day).alias("task_date"))


PARSE_DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN make_date(year(o_orderdate), 11, 3) - 30 ELSE o_orderdate::DATE END AS task_date FROM orders"


def _campaign_json(spark, d):
    k = F.col("c_custkey")

    def text(*pairs):
        return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))

    campaigns = v.table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 19 == 0, "2031-01-01 00:00:00").when(k % 7 == 0, "2023-06-01 08:00:00").otherwise("2024-05-06 07:08:09").alias("created_at"),
        F.lit("2024-06-01 00:00:00").alias("updated_at"),
        text(("name", F.col("c_name")), ("launchStatus", F.when(k % 2 == 0, "launched")), ("lastVisited", (k * 86_400_000).cast("string"))).alias("data"),
        text(
            ("state", F.when(k % 3 != 0, v.pick(v.STATES, k % len(v.STATES)))), ("office", F.when(k % 8 == 0, "Other").otherwise("Mayor")),
            ("positionId", F.when(k % 5 == 0, "p1")), ("electionDate", F.when(k % 4 == 0, "2035-01-01").otherwise("2024-11-05")),
            ("website", F.when(k % 6 == 0, "skipped").otherwise("https://x.org")), ("zip", F.when(k % 2 == 1, "90210")),
        ).alias("details"),
    )
    progress = v.table(spark, d, "customer").where(k % 2 == 0).select(
        k.alias("campaign_id"), text(("p2vStatus", F.when(k % 4 == 0, "Complete").otherwise("Waiting")), ("winNumber", F.concat(k.cast("string"), F.lit(".0")))).alias("data")
    )
    return rc.open_campaigns(campaigns, progress).select(
        "id", "candidate_name", "state", "election_date", "p2v_win_number", "has_zip_code", "has_website", "has_election_date", "p2v_complete", "is_launched",
        F.date_format("last_visited_date", "yyyy-MM-dd").alias("last_visited"), "creation_year",
    )


CAMPAIGN_JSON = f"""SELECT c_custkey AS id, c_name AS candidate_name, {STATE_PICK} AS state,
  CASE WHEN c_custkey % 4 <> 0 THEN DATE '2024-11-05' END AS election_date, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::INTEGER END AS p2v_win_number,
  (c_custkey % 2 = 1)::INTEGER AS has_zip_code, (c_custkey % 6 <> 0)::INTEGER AS has_website, 1::INTEGER AS has_election_date,
  (c_custkey % 4 = 0)::INTEGER AS p2v_complete, (c_custkey % 2 = 0)::INTEGER AS is_launched,
  CASE WHEN c_custkey > 0 THEN strftime(DATE '1970-01-01' + c_custkey::INTEGER, '%Y-%m-%d') END AS last_visited, 2024::INTEGER AS creation_year
  FROM customer WHERE c_custkey % 19 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND {STATE_PICK} <> '' AND c_custkey % 8 <> 0 AND c_custkey % 5 <> 0"""


def _slug_views(spark, d):
    o, c = v.table(spark, d, "orders"), v.table(spark, d, "customer")
    records = o.select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") % 3000).cast("string"), 9, "0")).alias("company_name"))
    k = F.col("o_orderkey")
    candidacies = o.where(k % 3 != 0).select(
        k.alias("company_id"), F.when(k % 7 == 0, "bad id").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("product_campaign_id"),
        F.lit("x").alias("full_name"),
    ).withColumn("product_campaign_id", F.col("product_campaign_id").try_cast("double"))
    slugs = c.select(F.col("c_custkey").alias("product_campaign_id"), nm.slug("c_name").alias("candidate_slug")).where("product_campaign_id > 0")
    return records, candidacies, slugs


def _slug_mapping(spark, d):
    return rc.slug_mapping(*_slug_views(spark, d)).select("record_id", "candidate_slug")


SLUGGED = f"""r AS (SELECT o_orderkey AS record_id, 'Customer#' || lpad((o_custkey % 3000)::VARCHAR, 9, '0') AS company_name, o_custkey FROM orders),
  s AS (SELECT c_custkey AS pid, {q.slug('c_name')} AS candidate_slug FROM customer WHERE c_custkey > 0),
  m AS (SELECT r.record_id::VARCHAR AS record_id, r.company_name, s.candidate_slug FROM r LEFT JOIN s ON r.record_id % 3 <> 0 AND r.record_id % 7 <> 0 AND s.pid = r.o_custkey)"""


def _recover_slugs(spark, d):
    records, candidacies, slugs = _slug_views(spark, d)
    mapped = rc.slug_mapping(records, candidacies, slugs)
    recovered = rc.recover_slugs(mapped, slugs)
    return rk.keep_first(recovered, ["record_id"], [F.col("recovered"), F.col("candidate_slug")]).select("record_id", "candidate_slug", "recovered")


RECOVER_SLUGS = f"""WITH {SLUGGED} SELECT record_id, candidate_slug, FALSE AS recovered FROM m WHERE candidate_slug IS NOT NULL UNION ALL
  SELECT m.record_id, s.candidate_slug, TRUE FROM m JOIN s ON m.candidate_slug IS NULL AND s.candidate_slug = {q.slug('m.company_name')}"""


def _keep_first(spark, d):
    o = v.table(spark, d, "orders")
    return rk.keep_first(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def _last_message(spark, d):
    """Atomic results (here: lineitems) with the last message (order) of their phone (customer)."""
    o = v.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("phone_number"), F.col("o_orderkey").alias("message_id"), "o_orderdate")
    owners = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("phone_number"))
    li = v.table(spark, d, "lineitem").join(owners, "l_orderkey").select("phone_number", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("atomic_id"))
    return rc.attach_messages(li, o, [F.desc("o_orderdate"), F.desc("message_id")]).groupBy("phone_number", "message_id").agg(F.count("*").alias("atoms"))


LAST_MESSAGE = """SELECT phone_number, message_id, count(*) AS atoms FROM (SELECT o_custkey::VARCHAR AS phone_number FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN
  (SELECT o_custkey::VARCHAR AS phone_number, o_orderkey AS message_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  USING (phone_number) GROUP BY ALL"""


def _runoff_results(spark, d):
    return clean_results(spark, d).withColumn("date", F.col("election_date")).where(F.col("election_type").isin("primary", "general", "runoff"))


def _runoff_types(spark, d):
    return rc.infer_runoff_types(_runoff_results(spark, d))


RUNOFF_CTE = f"""{CLEAN_RESULTS_CTE}, held AS (SELECT candidate_id, min(election_date) FILTER (election_type = 'primary') AS p, min(election_date) FILTER (election_type = 'general') AS g,
  min(election_date) FILTER (election_type = 'runoff') AS r FROM results GROUP BY 1),
  kinds AS (SELECT candidate_id, CASE WHEN p IS NOT NULL AND g IS NULL THEN 'primary' WHEN p IS NOT NULL AND g IS NOT NULL AND p < r AND r < g THEN 'primary' ELSE 'general' END AS runoff_type
    FROM held WHERE r IS NOT NULL)"""


def _matches_view(spark, d):
    return rc.clean_candidates(v.candidates(spark, d)).withColumn("has_match", F.col("candidacy_id") % 4 != 0).withColumn(
        "matched_candidate_id", F.when(F.col("candidacy_id") % 9 != 0, F.col("candidacy_id"))
    ).withColumn("election_date", F.col("primary_election_date").cast("string"))


def _discover_runoffs(spark, d):
    return rc.discover_runoffs(_matches_view(spark, d), _runoff_results(spark, d)).select(
        "candidacy_id", "matched_candidate_id", "runoff_type", "runoff_date", "runoff_race_id", "state"
    )


DISCOVERED = f"""{CLEANED}, {RUNOFF_CTE}, last_runoff AS (SELECT candidate_id, election_date AS runoff_date, race_id AS runoff_race_id, candidate FROM results WHERE election_type = 'runoff'
    QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY election_date DESC, race_id) = 1),
  discovered AS (SELECT c.*, c.candidacy_id AS matched_candidate_id, k.runoff_type, l.runoff_date, l.runoff_race_id FROM cleaned c JOIN last_runoff l ON l.candidate_id = c.candidacy_id
    JOIN kinds k ON k.candidate_id = c.candidacy_id WHERE c.candidacy_id % 4 <> 0 AND c.candidacy_id % 9 <> 0)"""


def _synthetic_runoffs(spark, d):
    s = rc.synthetic_runoffs(rc.discover_runoffs(_matches_view(spark, d), _runoff_results(spark, d)))
    return s.select("candidacy_id", "embedding_text", "election_date", "election_type", "is_synthetic_runoff", "discovered_from_candidate_id")


SYNTHETIC_RUNOFFS = f"""WITH {DISCOVERED} SELECT candidacy_id, 'name: ' || first_name || ' ' || last_name || ' | race: ' ||
  coalesce(official_office_name, {q.strip("coalesce(state, '') || ' ' || candidate_office")}, '') AS embedding_text, runoff_date AS election_date,
  'runoff' AS election_type, TRUE AS is_synthetic_runoff, matched_candidate_id AS discovered_from_candidate_id FROM discovered"""


def _merge_runoffs(spark, d):
    matches = _matches_view(spark, d)
    merged = rc.merge_runoffs(matches, rc.synthetic_runoffs(rc.discover_runoffs(matches, _runoff_results(spark, d))))
    return merged.select("candidacy_id", F.col("election_date").cast("date").alias("election_date"), "is_synthetic_runoff", "discovered_from_candidate_id", "has_match")


MERGE_RUNOFFS = f"""WITH {DISCOVERED} SELECT candidacy_id, p AS election_date, FALSE AS is_synthetic_runoff, NULL::BIGINT AS discovered_from_candidate_id, candidacy_id % 4 <> 0 AS has_match
  FROM cleaned UNION ALL SELECT candidacy_id, runoff_date, TRUE, matched_candidate_id, NULL FROM discovered"""


def _runoff_counts(spark, d):
    return rc.runoff_counts(rc.discover_runoffs(_matches_view(spark, d), _runoff_results(spark, d)))


RUNOFF_COUNTS = f"""WITH {DISCOVERED} SELECT 'type' AS dimension, runoff_type AS value, count(*) AS n FROM discovered GROUP BY ALL UNION ALL
  (SELECT 'state', state, count(*) AS n FROM discovered GROUP BY ALL ORDER BY n DESC, state NULLS FIRST LIMIT 5)"""


def _patch_errors(spark, d):
    k = F.col("o_orderkey")
    matches = v.table(spark, d, "orders").select(
        k.alias("id"), (k % 10).alias("database_id"), F.when(k % 11 == 0, "QUOTA_ERROR").otherwise("A").alias("district_name"),
        F.when(k % 13 == 0, "Processing Error: x").otherwise("fine").alias("reason"), F.lit(1.5).alias("confidence"),
    )
    retried = ds.error_rows(matches).withColumns({"district_name": F.lit("fixed"), "reason": F.lit("retried")}).where(F.col("id") % 3 != 0)
    return ds.patch_rows(matches, retried)


PATCH_ERRORS = """SELECT o_orderkey AS id, o_orderkey % 10 AS database_id, 1.5::DOUBLE AS confidence,
  CASE WHEN again THEN 'fixed' WHEN o_orderkey % 11 = 0 THEN 'QUOTA_ERROR' ELSE 'A' END AS district_name,
  CASE WHEN again THEN 'retried' WHEN o_orderkey % 13 = 0 THEN 'Processing Error: x' ELSE 'fine' END AS reason
  FROM (SELECT *, (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AND o_orderkey % 3 <> 0 AS again FROM orders)"""


def _state_tables(spark, d):
    o = v.table(spark, d, "orders")
    return [o.where(F.col("o_orderpriority") == p).select(F.col("o_orderpriority").alias("state"), F.col("o_orderkey").alias("id"))
            for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]


def _merge_states(spark, d):
    parts = _state_tables(spark, d)
    return rc.merge_state_files(parts)


def _count_check(spark, d):
    parts = _state_tables(spark, d)
    return pf.count_check(parts, rc.merge_state_files(parts))


def _sample(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return rk.reproducible_sample(o, "o_orderkey", 100)


def _load_rows(spark, d):
    n = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"))
    return rd.load_rows(n, states=["MACHINERY", "BUILDING"])


def _tasks(spark, d):
    k = F.col("o_orderkey")
    base = v.table(spark, d, "orders").select(
        F.concat(F.lit("task "), k.cast("string")).alias("title"), v.pick(["text", "robocall", "events", "education"], k % 4).alias("flow_type"),
        (F.floor(k / 50) + 1).cast("int").alias("week"), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), (k % 3 == 0).alias("pro_required"),
        F.when(k % 2 == 0, "t").alias("template_id"), k.alias("k"),
    )
    return base.where(k % 7 == 0).drop("k"), base.where(k % 7 != 0).drop("k")


TASKS = """t AS (SELECT o_orderkey AS k, 'task ' || o_orderkey AS title, (['text', 'robocall', 'events', 'education'])[o_orderkey % 4 + 1] AS flow_type,
  (o_orderkey // 50 + 1)::INTEGER AS week, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderkey % 3 = 0 AS pro_required,
  CASE WHEN o_orderkey % 2 = 0 THEN 't' END AS template_id FROM orders), g AS (SELECT * FROM t WHERE k % 7 = 0), s AS (SELECT * FROM t WHERE k % 7 <> 0)"""


def _merge_tasks(spark, d):
    return us.merge_tasks(*_tasks(spark, d)).select("title", "flow_type", "week")


def _task_statistics(spark, d):
    return us.task_statistics(us.merge_tasks(*_tasks(spark, d)))


def _task_counts(spark, d):
    return us.task_counts(us.merge_tasks(*_tasks(spark, d)))


def _tasks_of_week(spark, d):
    return us.tasks_of_week(us.merge_tasks(*_tasks(spark, d)), 3).select("title", "week")


MERGED_TASKS = f"{TASKS}, merged AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.week = s.week AND g.flow_type = s.flow_type) UNION ALL SELECT * FROM g)"

def _projection(spark, d):
    """The fixed output columns, of which only some exist."""
    return rc.existing_columns(v.candidates(spark, d), ["candidacy_id", "not_there", "state", "full_name"])


def _table_scan(spark, d):
    """All columns of a table known by name."""
    v.table(spark, d, "orders").createOrReplaceTempView("warehouse_orders")
    return rd.extract_table(spark, "warehouse_orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _sampled(spark, d):
    """A third of the customers by a hash of their key."""
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"))
    return rd.load_rows(c, sample_fraction=1 / 3)


def _text_column(spark, d):
    """The column found to hold the text, and how many of its values are there."""
    e = v.table(spark, d, "conversations").withColumn("message", F.lit(None).cast("string"))
    name = rd.find_text_column(e)
    return e.agg(F.lit(name).alias("text_column"), F.count(name).alias("filled"), F.count("*").alias("n"))


def _described(spark, d):
    """Columns of a table with their types, beside its row count."""
    o = v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rd.describe(o).withColumn("n", F.lit(rd.table_count(o)))


QUERIES = {
    "table_scan": (_table_scan, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
    "sampled_scan": (_sampled, "SELECT c_custkey AS id, c_mktsegment AS state FROM customer WHERE ('0x' || substr(md5(c_custkey || '-42'), 1, 8))::BIGINT < 1431655765"),
    "text_column": (_text_column, "SELECT 'text' AS text_column, count(text) AS filled, count(*) AS n FROM conversations"),
    "described_table": (_described, "SELECT unnest(['o_orderkey', 'o_orderstatus']) AS col_name, unnest(['bigint', 'string']) AS data_type, (SELECT count(*)::INTEGER FROM orders) AS n"),
    "output_projection": (_projection, f"WITH {C} SELECT candidacy_id, state, full_name FROM raw_candidates"),
    "clean_candidate_fields": (_clean_fields, CLEAN_FIELDS),
    "expand_elections": (lambda s, d: expanded(s, d).select(*EXPANDED_COLUMNS), f"WITH {CLEANED} SELECT {', '.join(EXPANDED_COLUMNS)} FROM expanded"),
    "clean_results": (lambda s, d: clean_results(s, d), f"WITH {CLEAN_RESULTS_CTE} SELECT * FROM results"),
    "temporal_match": (_temporal_match, TEMPORAL_MATCH),
    "semi_join_dates": (_semi_join_dates, "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderdate IN (SELECT CASE WHEN l_quantity > 49 THEN l_shipdate END FROM lineitem) GROUP BY 1"),
    "race_texts": (_race_texts, RACE_TEXTS),
    "result_texts": (_result_texts, f"WITH {R} SELECT result_id, 'name: ' || candidate || ' | race: ' || race_name AS race_text FROM raw_results"),
    "district_query_texts": (_district_queries, DISTRICT_QUERIES),
    "election_types": (_election_types, f"SELECT o_orderkey AS result_id, {q.election_type(RAW_TYPE)} AS election_type, {q.election_type(RAW_TYPE, 'general')} AS sheet_type FROM orders"),
    "codes_and_phones": (_small_codes, SMALL_CODES),
    "sheet_races": (_sheet_rows, SHEET_ROWS),
    "sheet_companies": (_companies, COMPANIES),
    "past_only": (_past_only, "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderdate < DATE '1998-08-01' GROUP BY 1"),
    "campaign_calendar": (_calendar, CALENDAR),
    "task_routing": (_task_routing, _routing_sql()),
    "campaign_dates": (_parse_dates, PARSE_DATES),
    "campaign_json": (_campaign_json, CAMPAIGN_JSON),
    "slug_mapping": (_slug_mapping, f"WITH {SLUGGED} SELECT record_id, candidate_slug FROM m"),
    "recover_slugs": (_recover_slugs, RECOVER_SLUGS),
    "keep_first": (_keep_first, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1"),
    "attach_last_message": (_last_message, LAST_MESSAGE),
    "runoff_types": (_runoff_types, f"WITH {RUNOFF_CTE} SELECT * FROM kinds"),
    "discover_runoffs": (_discover_runoffs, f"WITH {DISCOVERED} SELECT candidacy_id, matched_candidate_id, runoff_type, runoff_date, runoff_race_id, state FROM discovered"),
    "synthetic_runoffs": (_synthetic_runoffs, SYNTHETIC_RUNOFFS),
    "merge_runoffs": (_merge_runoffs, MERGE_RUNOFFS),
    "runoff_counts": (_runoff_counts, RUNOFF_COUNTS),
    "patch_error_rows": (_patch_errors, PATCH_ERRORS),
    "merge_state_tables": (_merge_states, "SELECT o_orderpriority AS state, o_orderkey AS id FROM orders"),
    "merge_count_check": (_count_check, "SELECT count(*) AS merged_rows, count(*) AS expected_rows, TRUE AS complete FROM orders"),
    "reproducible_sample": (_sample, "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || '-42'), o_orderkey LIMIT 100"),
    "state_scan": (_load_rows, "SELECT c_custkey AS id, c_mktsegment AS state FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')"),
    "merge_tasks": (_merge_tasks, f"WITH {MERGED_TASKS} SELECT title, flow_type, week FROM merged"),
    "task_statistics": (_task_statistics, f"WITH {MERGED_TASKS} SELECT count(*) AS total_tasks, count(template_id) AS with_templates, count(*) FILTER (pro_required) AS pro_required, min(date) AS earliest, max(date) AS latest FROM merged"),
    "task_counts": (_task_counts, f"WITH {MERGED_TASKS} SELECT 'flow_type' AS dimension, flow_type AS value, count(*) AS n FROM merged GROUP BY ALL UNION ALL SELECT 'week', week::VARCHAR, count(*) FROM merged GROUP BY ALL"),
    "tasks_of_week": (_tasks_of_week, f"WITH {MERGED_TASKS} SELECT title, week FROM merged WHERE week = 3"),
}
