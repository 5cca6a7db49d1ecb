"""Civic records derived from the shared tables, once as DataFrames and once as SQL.

Every view grows with its table: a row of ``events`` is a text message, a row of ``customer``
a candidate, a row of ``orders`` an election result, a row of ``embeddings`` a vector record.
The word lists only decide what the rows say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PHRASES = [
    "Property taxes are way too high on Main Street",
    "STOP",
    "Stop the warehouses please",
    "The truck traffic from the warehouse is ruining our roads",
    "Thanks",
    "My water bill doubled this year!!",
    "We need e-bike lanes downtown",
    "Please add police enforcement for e-scooter riders",
    "I love the new park, “great” job",
    "wrong number",
    "no sidewalks on main street",
    "tax!",
    "The   president should   resign",
    "Call me at 555-123-4567 or mail joe@example.com about zoning",
    "Data center noise is bad and the property tax is worse",
    "Hello there",
    "👍 to \"Thanks for sharing your thoughts\"",
    "😀",
    "I need a business permit for my bakery. The office never answers; can you help?",
    "The school construction blocks traffic every morning\n\n\nplease fix it",
    "unsubscribe me from this list unsubscribe",
    "See https://example.org/agenda?item=4 for the housing plan",
    "good morning council",
    "ok",
    "   ",
    "Fix the potholes on Elm and on Oak and on Pine and on Birch and near the library",
    "Fix the potholes on Elm and on Oak and on Pine and on Birch and near the school library",
    "don't text me again",
    "How will you vote on the budget and the new library???",
    "I moved out last year, I live in Florida now",
]
FIRST_NAMES = ["o'CONNOR", "O'CONNOR", "mary", "ann", "J", "R2D2", "  Jo   Ann.", "JOHN", "susan", "V", "Élodie", "laura-jean",
               "nan", "", "Stanley", "marco"]
LAST_NAMES = ["smith-jones", "DE LA CRUZ", "Lee", "mcdonald", "\"Nguyen\"", "o'neil", "IV", "garcía", "Verla", "Brown 3rd",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ", "Young"]
STATES = ["CA", "tx", " NY ", "FL", "ZZ", "DC", "Ohio", "", "wa", "Il", "New York", "GA"]
OFFICES = ["city council", "Mayor", "school board", "  State   Senate", "County COMMISSIONER", "US House", "None", "District attorney",
           "Board of education", "alderman", "", "Sheriff"]
LEVELS = ["FEDERAL", "Federal-Download", "state", "Interstate", "statewide office", "City", "TOWN", "county/city",
          "water district", "", "Local", "Township trustee"]
PARTIES = ["nonpartisan", "Nonparisan", "Non Partisan", "Libertarian Party", "Democratic", " Republican ", "nan", "None", "",
           "independent"]
CITIES = ["Springfield", "none", "", "Oakland", "N/A", "Dover", "Salem"]
RESULT_TYPES = ["Primary Runoff", "General Election", "runoff", "Special", "PRIMARY", "General Runoff"]
SHEET_RACES = ["CA Governor General", "TX City Council Primary", "Mayor of Dover", "NY  Board of Education Special", "FL ",
               "GA Sheriff Runoff", "ca lower case General"]
SERIALS = ["45231", "45300.0", "", "abc", "44927", " 45000 "]
BLOCK_STATES = ["CA", "TX", "NY", "FL", "WA"]
VECTOR_TYPES = ["primary", "general", "runoff"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_pick(values: list[str], index: str) -> str:
    return "([" + ", ".join(quoted(v) for v in values) + f"])[({index})::BIGINT + 1]"


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Text messages: phone, position, campaign, direction, text."""
    e = table(spark, folder, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    user, event = F.col("user_id"), F.col("event_id")
    number = F.lpad(user.cast("string"), 7, "0")
    phone = (
        F.when(event % 3 == 0, F.concat(F.lit("1555"), number))
        .when(event % 3 == 1, F.concat(F.lit("(555) "), number))
        .otherwise(F.concat(F.lit("555"), number))
    )
    n = len(PHRASES)
    text = pick(PHRASES, k % n)
    text = F.when(event % 5 == 0, F.concat(text, F.lit(" "), pick(PHRASES, (k * 3 + user) % n))).otherwise(text)
    return e.select(
        event.alias("message_id"), F.concat(F.lit("batch_"), (event % 4).cast("string"), F.lit(".csv")).alias("source_file"),
        event.alias("source_row"), F.when(event % 97 == 0, "").otherwise(phone).alias("contact_phone_number"),
        F.concat(F.lit("poll-"), (user % 5).cast("string")).alias("campaign_name"),
        F.when(user % 4 != 0, F.concat(F.lit("carrier-"), (user % 4).cast("string"))).alias("carrier"),
        F.when(F.col("event_type") == "error", "OUTBOUND").when(event % 2 == 0, "inbound").otherwise("INBOUND").alias("send_direction"),
        F.when(event % 10 == 0, "MMS").otherwise("SMS").alias("message_type"),
        F.col("ts").alias("sent_at"), text.alias("message_text"),
    )


def messages_sql() -> str:
    n = len(PHRASES)
    first = sql_pick(PHRASES, f"k % {n}")
    second = sql_pick(PHRASES, f"(k * 3 + user_id) % {n}")
    return f"""messages AS (
  SELECT event_id AS message_id, 'batch_' || (event_id % 4) || '.csv' AS source_file, event_id AS source_row,
    CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 3 = 0 THEN '1555' || number
         WHEN event_id % 3 = 1 THEN '(555) ' || number ELSE '555' || number END AS contact_phone_number,
    'poll-' || (user_id % 5) AS campaign_name,
    CASE WHEN user_id % 4 <> 0 THEN 'carrier-' || (user_id % 4) END AS carrier,
    CASE WHEN event_type = 'error' THEN 'OUTBOUND' WHEN event_id % 2 = 0 THEN 'inbound' ELSE 'INBOUND' END AS send_direction,
    CASE WHEN event_id % 10 = 0 THEN 'MMS' ELSE 'SMS' END AS message_type, ts AS sent_at,
    CASE WHEN event_id % 5 = 0 THEN {first} || ' ' || {second} ELSE {first} END AS message_text
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, lpad(user_id::VARCHAR, 7, '0') AS number FROM events))"""


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Issue mentions: an event is one person's stance on an issue."""
    e = table(spark, folder, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    value = F.col("value")
    stance = F.when(value < 10, "negative").when(value < 30, "requesting").when(value < 70, "positive").otherwise("neutral")
    primary = F.concat(F.lit("area_"), (k % 3).cast("string"))
    return e.select(
        F.col("event_id").alias("message_id"), F.col("user_id").cast("string").alias("phone"),
        F.concat(F.lit("message "), F.col("event_id").cast("string"), F.lit(" about "), F.col("event_type")).alias("message_text"),
        F.when(value < 30, "frustrated_urgent").otherwise("appreciative_positive").alias("overall_sentiment"),
        F.lit(0).alias("issue_index"), F.concat_ws("/", primary, "event_type").alias("issue"),
        primary.alias("primary_category"), F.col("event_type").alias("secondary_category"), stance.alias("stance"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("concern "), (k % 7).cast("string"))).alias("specific_concern"),
        (k % 4 == 0).alias("is_root_cause"), F.col("ts").alias("sent_at"),
    )


MENTIONS_SQL = """mentions AS (
  SELECT event_id AS message_id, user_id::VARCHAR AS phone, 'message ' || event_id || ' about ' || event_type AS message_text,
    CASE WHEN value < 30 THEN 'frustrated_urgent' ELSE 'appreciative_positive' END AS overall_sentiment,
    'area_' || (k % 3) || '/' || event_type AS issue, 'area_' || (k % 3) AS primary_category, event_type AS secondary_category,
    CASE WHEN value < 10 THEN 'negative' WHEN value < 30 THEN 'requesting' WHEN value < 70 THEN 'positive' ELSE 'neutral' END AS stance,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'concern ' || (k % 7) END AS specific_concern, k % 4 = 0 AS is_root_cause, ts AS sent_at
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events))"""


def issue_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with several issues: what one person said on one day, an issue per event type."""
    e = table(spark, folder, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    per_issue = e.groupBy("user_id", F.dayofmonth("ts").alias("day"), "event_type").agg(F.max("value").alias("v"), F.max(k).alias("k"))
    stance = F.when(F.col("v") < 30, "negative").when(F.col("v") < 60, "requesting").when(F.col("v") < 90, "positive").otherwise("neutral")
    issue = F.struct(
        F.lit("area").alias("primary_category"), F.col("event_type").alias("secondary_category"), stance.alias("stance"),
        F.concat(F.lit("concern "), (F.col("k") % 7).cast("string")).alias("specific_concern"),
        (F.col("k") % 4 == 0).alias("is_root_cause"),
    )
    # at most one entry per event type
    return per_issue.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(issue)).alias("issues")).select(
        (F.col("user_id") * 100 + F.col("day")).alias("message_id"), F.col("user_id").cast("string").alias("phone"),
        F.concat(F.lit("person "), F.col("user_id").cast("string"), F.lit(" day "), F.col("day").cast("string"), F.lit("?")).alias("message_text"),
        "issues", F.lit(False).alias("should_be_uncategorized"),
    )


ISSUE_MESSAGES_SQL = """issue_rows AS (
  SELECT user_id * 100 + day AS message_id, user_id, day, 'person ' || user_id || ' day ' || day || '?' AS message_text,
    'area/' || event_type AS issue, event_type,
    CASE WHEN v < 30 THEN 'negative' WHEN v < 60 THEN 'requesting' WHEN v < 90 THEN 'positive' ELSE 'neutral' END AS stance,
    'concern ' || (k % 7) AS specific_concern, k % 4 = 0 AS is_root_cause
  FROM (SELECT user_id, day(ts) AS day, event_type, max(value) AS v, max(regexp_extract(props, '([0-9]+)', 1)::BIGINT) AS k
        FROM events GROUP BY ALL))"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Raw candidate records."""
    c = table(spark, folder, "customer")
    key = F.col("c_custkey")

    def day(first: str, step: Column, held: Column) -> Column:
        return F.when(held, F.date_add(F.lit(first).cast("date"), step.cast("int")))

    return c.select(
        key.alias("candidacy_id"), pick(FIRST_NAMES, key % len(FIRST_NAMES)).alias("first_name"),
        pick(LAST_NAMES, F.floor(key / 5) % len(LAST_NAMES)).alias("last_name"), F.col("c_name").alias("full_name"),
        F.when(key % 13 != 0, pick(STATES, F.floor(key / 3) % len(STATES))).alias("state"),
        pick(CITIES, key % len(CITIES)).alias("city"), pick(OFFICES, F.floor(key / 7) % len(OFFICES)).alias("candidate_office"),
        F.when(key % 3 == 0, pick(OFFICES, F.floor(key / 2) % len(OFFICES))).alias("official_office_name"),
        pick(LEVELS, F.floor(key / 11) % len(LEVELS)).alias("office_level"), pick(PARTIES, key % len(PARTIES)).alias("party_affiliation"),
        day("2024-03-05", key % 3 * 7, key % 4 != 0).alias("primary_election_date"),
        day("2024-11-05", key % 2 * 7, key % 5 != 0).alias("general_election_date"),
        day("2024-12-03", key % 3 * 7, key % 6 == 0).alias("runoff_election_date"),
    )


def candidates_sql() -> str:
    k = "c_custkey"
    return f"""raw_candidates AS (
  SELECT {k} AS candidacy_id, {sql_pick(FIRST_NAMES, f'{k} % {len(FIRST_NAMES)}')} AS first_name,
    {sql_pick(LAST_NAMES, f'({k} // 5) % {len(LAST_NAMES)}')} AS last_name, c_name AS full_name,
    CASE WHEN {k} % 13 <> 0 THEN {sql_pick(STATES, f'({k} // 3) % {len(STATES)}')} END AS state,
    {sql_pick(CITIES, f'{k} % {len(CITIES)}')} AS city, {sql_pick(OFFICES, f'({k} // 7) % {len(OFFICES)}')} AS candidate_office,
    CASE WHEN {k} % 3 = 0 THEN {sql_pick(OFFICES, f'({k} // 2) % {len(OFFICES)}')} END AS official_office_name,
    {sql_pick(LEVELS, f'({k} // 11) % {len(LEVELS)}')} AS office_level, {sql_pick(PARTIES, f'{k} % {len(PARTIES)}')} AS party_affiliation,
    CASE WHEN {k} % 4 <> 0 THEN DATE '2024-03-05' + ({k} % 3 * 7)::INTEGER END AS primary_election_date,
    CASE WHEN {k} % 5 <> 0 THEN DATE '2024-11-05' + ({k} % 2 * 7)::INTEGER END AS general_election_date,
    CASE WHEN {k} % 6 = 0 THEN DATE '2024-12-03' + ({k} % 3 * 7)::INTEGER END AS runoff_election_date
  FROM customer)"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Raw election results."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    name = F.concat(pick(FIRST_NAMES, key % len(FIRST_NAMES)), F.lit("  "), pick(LAST_NAMES, F.floor(key / 5) % len(LAST_NAMES)))
    kind = key % len(RESULT_TYPES)
    first = F.when(kind == 0, "2024-03-05").when(kind == 4, "2024-03-05").when(kind == 2, "2024-12-03").when(kind == 5, "2024-12-03").otherwise("2024-11-05")
    return o.select(
        key.alias("result_id"), F.when(key % 29 == 0, "  ").otherwise(name).alias("candidate"),
        F.concat(pick(STATES, F.floor(key / 3) % len(STATES)), F.lit(" "), pick(OFFICES, F.floor(key / 7) % len(OFFICES))).alias("race_name"),
        pick(PARTIES, key % len(PARTIES)).alias("candidate_party"), (F.col("o_orderstatus") == "F").alias("is_winner"),
        (key % 5000).alias("race_id"), F.col("o_custkey").alias("candidate_id"),
        pick(RESULT_TYPES, kind).alias("election_type"), F.date_add(first.cast("date"), (key % 3 * 7).cast("int")).alias("election_date"),
    )


def results_sql() -> str:
    k = "o_orderkey"
    kind = f"{k} % {len(RESULT_TYPES)}"
    return f"""raw_results AS (
  SELECT {k} AS result_id, CASE WHEN {k} % 29 = 0 THEN '  ' ELSE {sql_pick(FIRST_NAMES, f'{k} % {len(FIRST_NAMES)}')} || '  ' ||
      {sql_pick(LAST_NAMES, f'({k} // 5) % {len(LAST_NAMES)}')} END AS candidate,
    {sql_pick(STATES, f'({k} // 3) % {len(STATES)}')} || ' ' || {sql_pick(OFFICES, f'({k} // 7) % {len(OFFICES)}')} AS race_name,
    {sql_pick(PARTIES, f'{k} % {len(PARTIES)}')} AS candidate_party, o_orderstatus = 'F' AS is_winner, {k} % 5000 AS race_id,
    o_custkey AS candidate_id, {sql_pick(RESULT_TYPES, kind)} AS election_type,
    (CASE WHEN {kind} IN (0, 4) THEN DATE '2024-03-05' WHEN {kind} IN (2, 5) THEN DATE '2024-12-03' ELSE DATE '2024-11-05' END)
      + ({k} % 3 * 7)::INTEGER AS election_date
  FROM orders)"""


def vector_records(spark: SparkSession, folder: str) -> DataFrame:
    """Vector records with a block: date and state by label, type by id; some have no state."""
    e = table(spark, folder, "embeddings")
    v, label = F.col("vec_id"), F.col("label").cast("bigint")
    held = F.date_add(F.lit("2024-03-05").cast("date"), (label % 3 * 7).cast("int"))
    return e.select(
        v.alias("vec_id"), "embedding", "label", F.when(v % 17 != 0, pick(BLOCK_STATES, label % len(BLOCK_STATES))).alias("state"),
        pick(VECTOR_TYPES, v % len(VECTOR_TYPES)).alias("election_type"), held.alias("election_date"),
        F.when(v % 4 == 0, held).alias("general_election_date"), F.when(v % 4 == 1, F.date_sub(held, 7)).alias("primary_election_date"),
        F.concat(F.lit("district "), (v % 9).cast("string"), F.lit(" of "), pick(CITIES, v % len(CITIES))).alias("district_name"),
        pick(CITIES, (v + 2) % len(CITIES)).alias("city"),
    )


def vector_records_sql() -> str:
    return f"""vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS embedding, label, CASE WHEN vec_id % 17 <> 0 THEN {sql_pick(BLOCK_STATES, f'label % {len(BLOCK_STATES)}')} END AS state,
    {sql_pick(VECTOR_TYPES, f'vec_id % {len(VECTOR_TYPES)}')} AS election_type,
    DATE '2024-03-05' + (label % 3 * 7)::INTEGER AS election_date,
    CASE WHEN vec_id % 4 = 0 THEN DATE '2024-03-05' + (label % 3 * 7)::INTEGER END AS general_election_date,
    CASE WHEN vec_id % 4 = 1 THEN DATE '2024-03-05' + (label % 3 * 7 - 7)::INTEGER END AS primary_election_date,
    'district ' || (vec_id % 9) || ' of ' || {sql_pick(CITIES, f'vec_id % {len(CITIES)}')} AS district_name,
    {sql_pick(CITIES, f'(vec_id + 2) % {len(CITIES)}')} AS city
  FROM embeddings)"""
