"""Queries on vector search, selection, calibration, districts and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import record_queries as rq
from plenum.catalog import sqltext as q
from plenum.catalog import views as v
from plenum.functions import fixed
from plenum.functions import vectors as vec
from plenum.functions.text import nullif_blank
from plenum.operators import districts as ds
from plenum.operators import matching as mt
from plenum.operators import quotes as qt
from plenum.operators.ranking import attach_row
from plenum.operators.vector_index import pruned_topk
from plenum.plans import district_matching as dm
from plenum.plans import race_matching as rm
from plenum.session import written

V = v.vector_records_sql()
IDS = dict(query_id="vec_id", candidate_id="vec_id", query_vector="embedding", candidate_vector="embedding")
COS = "round(list_cosine_similarity(a.embedding, b.embedding), 9)"


def _rounded(df):
    return df.select("query_id", "candidate_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _topk_sql(condition: str, k: int, score: str = COS, order: str = "DESC", keep: str = "s > 0", extra: str = "", source: str = "vectors a JOIN vectors b") -> str:
    return f"""WITH {V}{extra}, pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, {score} AS s FROM {source} ON {condition})
  SELECT query_id, candidate_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s {order}, candidate_id) AS rank FROM pairs WHERE {keep} QUALIFY rank <= {k}"""


def _direct(spark, d):
    r = v.vector_records(spark, d)
    return _rounded(mt.direct_candidates(r, r, **IDS))


DIRECT = _topk_sql("a.election_date = b.election_date AND a.state = b.state AND a.election_type = b.election_type AND a.election_type <> 'runoff'", 10)


def _pruned(spark, d):
    """The direct search by parts around pivots; the result is the same."""
    r = v.vector_records(spark, d)
    direct = r.where(nullif_blank("state").isNotNull() & (F.col("election_type") != "runoff"))
    return _rounded(pruned_topk(direct, r, mt.RACE_BLOCK, 10, **IDS, tile=64)[0])


def _by_label(spark, d):
    """The nearest other records of the same label."""
    r = v.vector_records(spark, d)
    return _rounded(mt.block_topk(r, r, ["label"], 10, pair=mt.Pair(same_id=False), **IDS))


def _stateless(spark, d):
    r = v.vector_records(spark, d)
    return _rounded(mt.stateless_candidates(r, r, **IDS))


STATELESS = _topk_sql("a.state IS NULL AND a.election_date = b.election_date AND a.election_type = b.election_type AND a.election_type <> 'runoff'", 10)


def _runoff(spark, d):
    r = v.vector_records(spark, d)
    return _rounded(mt.runoff_candidates(r, r, **IDS))


RUNOFF = _topk_sql(
    """a.state = b.state AND b.election_date >= a.base_date AND ((a.g AND b.election_type IN ('general', 'runoff')) OR (NOT a.g AND a.p AND b.election_type IN ('primary', 'runoff'))
    OR (NOT a.g AND NOT a.p AND b.election_type IN ('primary', 'general', 'runoff')))""", 10,
    extra=""", held AS (SELECT state, election_date AS base_date, bool_or(election_type = 'general') AS g, bool_or(election_type = 'primary') AS p FROM vectors GROUP BY ALL),
  asked AS (SELECT r.*, coalesce(h.g, FALSE) AS g, coalesce(h.p, FALSE) AS p FROM (SELECT *, coalesce(general_election_date, primary_election_date, election_date) AS base_date FROM vectors
    WHERE election_type = 'runoff' AND state IS NOT NULL) r LEFT JOIN held h ON h.state = r.state AND h.base_date = r.base_date)""", source="asked a JOIN vectors b")


def _l2(spark, d):
    r = v.vector_records(spark, d)
    return _rounded(mt.block_topk(r, r, ["election_date", "state", "election_type"], 5, metric="l2", pair=mt.Pair(same_id=False), **IDS))


L2 = _topk_sql("a.election_date = b.election_date AND a.state = b.state AND a.election_type = b.election_type AND a.vec_id <> b.vec_id", 5,
               "round(list_distance(a.embedding, b.embedding) ** 2, 9)", "ASC", "TRUE")


def _district_city(spark, d):
    r = v.vector_records(spark, d).where("state is not null")
    return _rounded(ds.district_topk(r, r, city="city", **IDS))


BOOSTED = "round(least(1.0::DOUBLE, list_cosine_similarity(a.embedding, b.embedding) + CASE WHEN trim(a.city) <> '' AND contains(upper(b.district_name), upper(trim(a.city))) THEN 0.15::DOUBLE ELSE 0 END), 9)"


def _generic(spark, d):
    """The first vector stands for the generic query."""
    return v.vector_records(spark, d).where("vec_id = 0").select(F.col("embedding").alias("query_vector"))


def _inject(spark, d, variant):
    r = v.vector_records(spark, d).where("state is not null")
    ranked = ds.district_topk(r, r, **IDS)
    offers = ds.generic_topk(r, _generic(spark, d), candidate_id="vec_id", query_vector="query_vector", candidate_vector="embedding")
    out = ds.inject_generic(ranked, r, offers, "vec_id", variant)
    return out.select("query_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"), "is_generic")


def _inject_sql(variant: str) -> str:
    take = "AND rank = 1" if variant == "best_only" else ""
    return f"""WITH {V}, usable AS (SELECT * FROM vectors WHERE state IS NOT NULL),
  listed AS (SELECT a.vec_id AS query_id, a.state, b.vec_id AS candidate_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank
    FROM usable a JOIN usable b ON a.state = b.state WHERE {COS} > 0 QUALIFY rank <= 13),
  generic AS (SELECT b.state, b.vec_id AS candidate_id, row_number() OVER (PARTITION BY b.state ORDER BY {COS} DESC, b.vec_id) AS rank
    FROM (SELECT * FROM vectors WHERE vec_id = 0) a, usable b WHERE {COS} > 0 QUALIFY rank <= 14),
  fresh AS (SELECT l.query_id, g.candidate_id FROM (SELECT query_id, any_value(state) AS state, count(*) AS n FROM listed GROUP BY 1) l JOIN generic g USING (state)
    WHERE n >= 11 {take} AND NOT EXISTS (SELECT 1 FROM listed x WHERE x.query_id = l.query_id AND x.candidate_id = g.candidate_id) QUALIFY row_number() OVER (PARTITION BY l.query_id ORDER BY g.rank) = 1),
  merged AS (SELECT query_id, candidate_id, CASE WHEN rank >= 11 AND query_id IN (SELECT query_id FROM fresh) THEN rank + 1 ELSE rank END AS rank, FALSE AS is_generic FROM listed
    UNION ALL SELECT query_id, candidate_id, 11, TRUE FROM fresh)
  SELECT query_id, candidate_id, rank, is_generic FROM merged WHERE rank <= 13"""


def _vector_algebra(spark, d):
    r = v.vector_records(spark, d)
    shifted = r.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = r.join(shifted, "vec_id")
    return j.select("vec_id", F.round(vec.cosine("embedding", "other"), 6).alias("cosine"), F.round(vec.dot("embedding", "other"), 6).alias("dot"),
                    F.round(vec.squared_distance("embedding", "other"), 6).alias("squared"), F.round(vec.norm(vec.l2_normalise("embedding")), 6).alias("unit_norm"))


VECTOR_ALGEBRA = f"""WITH {V} SELECT a.vec_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine, round(list_inner_product(a.embedding, b.embedding), 6) AS dot,
  round(list_distance(a.embedding, b.embedding) ** 2, 6) AS squared, 1.0::DOUBLE AS unit_norm FROM vectors a JOIN vectors b ON a.vec_id = b.vec_id + 1"""


def _calibration(spark, d):
    """Calibrated confidences of candidate names against result names that share an id."""
    c = v.candidates(spark, d).select("candidacy_id", "first_name", "last_name")
    r = v.results(spark, d).select(F.col("candidate_id").alias("candidacy_id"), "result_id", "candidate")
    given = F.when(F.col("result_id") % 17 == 0, 0.0).otherwise(60.0 + F.col("result_id") % 41)
    out = c.join(r, "candidacy_id").withColumn("given", given)
    out = out.withColumn("confidence", mt.calibrate("given", "first_name", "last_name", "candidate"))
    return out.select("result_id", "confidence", mt.accept("confidence", 70).alias("accepted"), mt.accept("confidence", 60).alias("accepted_sheet"))


def _calibration_sql() -> str:
    male, female = "|".join(fixed.MALE_NAMES), "|".join(fixed.FEMALE_NAMES)
    return f"""WITH {v.candidates_sql()}, {v.results_sql()}, j AS (SELECT result_id, trim(lower(first_name)) AS f, trim(lower(last_name)) AS l, lower(candidate) AS m,
      CASE WHEN result_id % 17 = 0 THEN 0.0::DOUBLE ELSE 60.0::DOUBLE + result_id % 41 END AS given FROM raw_candidates JOIN raw_results ON candidate_id = candidacy_id),
    g AS (SELECT *, CASE WHEN (regexp_matches(f, '{male}') AND regexp_matches(m, '{female}')) OR (regexp_matches(f, '{female}') AND regexp_matches(m, '{male}')) THEN greatest(0, given - 25) ELSE given END AS a,
      CASE WHEN NOT contains(m, f) AND NOT contains(m, l) THEN 15 WHEN NOT contains(m, f) OR NOT contains(m, l) THEN 8 ELSE 0 END AS pen FROM j),
    c AS (SELECT result_id, CASE WHEN given = 0 THEN 0::DOUBLE WHEN pen > 0 THEN greatest(0, a - pen) ELSE a END AS confidence FROM g)
    SELECT result_id, confidence, confidence >= 70 AS accepted, confidence >= 60 AS accepted_sheet FROM c"""


def race_inputs(spark, d):
    """Cleaned candidate and result records with vectors from the embedding table."""
    e = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    size = e.agg(F.count("*").alias("n_vectors"))
    c = attach_row(rq.expanded(spark, d), size)
    c = c.withColumn("record_id", F.concat_ws("-", "candidacy_id", "election_type")).withColumn("vec_id", F.col("candidacy_id") % F.col("n_vectors"))
    r = attach_row(rq.clean_results(spark, d), size).withColumn("vec_id", F.col("result_id") % F.col("n_vectors"))
    # the matcher reads both sides on several paths: they are tables, not plans
    return tuple(written(side.join(e, "vec_id").drop("vec_id", "n_vectors"), name) for side, name in ((c, "candidates"), (r, "results")))


def _race_matching(spark, d):
    c, r = race_inputs(spark, d)
    m = rm.match_races(c, r, "record_id")
    return m.select("record_id", "has_match", F.round("confidence", 4).alias("confidence"), "match_source", "result_id", "matched_race_name", "matched_candidate")


def _race_sql() -> str:
    cos = "round(list_cosine_similarity(a.embedding, b.embedding), 9)"
    columns = "a.record_id, a.first_name, a.last_name, b.result_id, b.candidate, b.race_name"
    # the database counts bytes, Spark characters: give accented letters one byte
    lev = "translate(lower(coalesce({0}, '')), 'éí', '#%')"
    left, right = lev.format("concat_ws(' ', first_name, last_name)"), lev.format("candidate")
    male, female = "|".join(fixed.MALE_NAMES), "|".join(fixed.FEMALE_NAMES)
    return f"""WITH {rq.CLEANED}, {rq.CLEAN_RESULTS_CTE}, e AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), n AS (SELECT count(*) AS n FROM e),
  c AS (SELECT x.*, candidacy_id || '-' || election_type AS record_id, e.embedding FROM expanded x, n JOIN e ON e.vec_id = x.candidacy_id % n.n),
  r AS (SELECT x.*, e.embedding FROM results x, n JOIN e ON e.vec_id = x.result_id % n.n),
  settled AS (SELECT * FROM c WHERE coalesce(office_level IN ('FEDERAL', 'STATE'), FALSE)), o AS (SELECT * FROM c WHERE NOT coalesce(office_level IN ('FEDERAL', 'STATE'), FALSE)),
  held AS (SELECT state, election_date AS base_date, bool_or(election_type = 'general') AS g, bool_or(election_type = 'primary') AS p FROM r GROUP BY ALL),
  ro AS (SELECT x.*, coalesce(h.g, FALSE) AS g, coalesce(h.p, FALSE) AS p FROM (SELECT *, coalesce(general_election_date, primary_election_date, election_date) AS base_date FROM o WHERE election_type = 'runoff' AND state IS NOT NULL) x
    LEFT JOIN held h ON h.state = x.state AND h.base_date = x.base_date),
  pairs AS (SELECT {columns}, 'direct' AS match_source, {cos} AS s FROM o a JOIN r b ON a.election_date = b.election_date AND a.state = b.state AND a.election_type = b.election_type WHERE a.election_type <> 'runoff'
    UNION ALL SELECT {columns}, 'stateless_fallback', {cos} FROM o a JOIN r b ON a.election_date = b.election_date AND a.election_type = b.election_type WHERE a.state IS NULL AND a.election_type <> 'runoff'
    UNION ALL SELECT {columns}, 'date_range_runoff', {cos} FROM ro a JOIN r b ON a.state = b.state AND b.election_date >= a.base_date AND
      ((a.g AND b.election_type IN ('general', 'runoff')) OR (NOT a.g AND a.p AND b.election_type IN ('primary', 'runoff')) OR (NOT a.g AND NOT a.p AND b.election_type IN ('primary', 'general', 'runoff')))),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY s DESC, result_id) AS rank FROM pairs WHERE s > 0 QUALIFY rank <= 10),
  scored AS (SELECT *, round(CASE WHEN greatest(length({left}), length({right})) > 0 THEN (1.0::DOUBLE - levenshtein({left}, {right}) / greatest(length({left}), length({right}))) * 100 ELSE 0 END, 4) AS score FROM ranked),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, rank) = 1),
  g AS (SELECT *, trim(lower(first_name)) AS f, trim(lower(last_name)) AS l, lower(candidate) AS m FROM best),
  clash AS (SELECT *, CASE WHEN (regexp_matches(f, '{male}') AND regexp_matches(m, '{female}')) OR (regexp_matches(f, '{female}') AND regexp_matches(m, '{male}')) THEN greatest(0, score - 25) ELSE score END AS a,
    CASE WHEN NOT contains(m, f) AND NOT contains(m, l) THEN 15 WHEN NOT contains(m, f) OR NOT contains(m, l) THEN 8 ELSE 0 END AS pen FROM g),
  final AS (SELECT *, CASE WHEN score = 0 THEN 0 WHEN pen > 0 THEN greatest(0, a - pen) ELSE a END AS confidence FROM clash)
  SELECT o.record_id, coalesce(f.confidence >= 70, FALSE) AS has_match, round(coalesce(f.confidence, 0.0)::DOUBLE, 4) AS confidence, coalesce(f.match_source, 'no_match') AS match_source,
    CASE WHEN f.confidence >= 70 THEN f.result_id END AS result_id, CASE WHEN f.confidence >= 70 THEN f.race_name END AS matched_race_name, CASE WHEN f.confidence >= 70 THEN f.candidate END AS matched_candidate
  FROM o LEFT JOIN final f USING (record_id) UNION ALL
  SELECT record_id, FALSE, 100.0, NULL, NULL, office_level || '_RACE', NULL FROM settled"""


RACE_MATCHING = _race_sql()


def _match_statistics(spark, d):
    c, r = race_inputs(spark, d)
    return mt.match_statistics(rm.match_races(c, r, "record_id")).withColumn("average_confidence", F.round("average_confidence", 4))


MATCH_STATISTICS = f"""SELECT count(*) AS total_records, count(*) FILTER (has_match) AS local_matches, count(*) FILTER (matched_race_name = 'FEDERAL_RACE') AS federal_races,
  count(*) FILTER (matched_race_name = 'STATE_RACE') AS state_races, count(*) FILTER (NOT has_match AND coalesce(matched_race_name, '') NOT IN ('FEDERAL_RACE', 'STATE_RACE')) AS no_match,
  count(*) FILTER (match_source = 'direct') AS direct_records, count(*) FILTER (match_source = 'date_range_runoff') AS date_range_runoff_records,
  count(*) FILTER (match_source = 'stateless_fallback') AS stateless_fallback_records, round(avg(confidence) FILTER (has_match), 4) AS average_confidence FROM ({RACE_MATCHING})"""


def _level_split(spark, d):
    open_records, settled = mt.split_by_level(rq.expanded(spark, d))
    a = open_records.select("candidacy_id", "election_type", F.lit(None).cast("string").alias("matched_race_name"), F.lit(None).cast("string").alias("reason"))
    return a.unionByName(settled.select("candidacy_id", "election_type", "matched_race_name", "reason"))


LEVEL_SPLIT = f"""WITH {rq.CLEANED} SELECT candidacy_id, election_type, CASE WHEN office_level IN ('FEDERAL', 'STATE') THEN office_level || '_RACE' END AS matched_race_name,
  CASE office_level WHEN 'FEDERAL' THEN 'Federal race (pre-filtered by office_level field)' WHEN 'STATE' THEN 'State race (pre-filtered by office_level field)' END AS reason FROM expanded"""


def _candidate_lists(spark, d):
    """Ranked lists as JSON; the similarity is left out of the text so that both sides print alike."""
    r = v.vector_records(spark, d)
    ranked = mt.direct_candidates(r, r, **IDS)
    return mt.candidate_list_json(ranked, ["query_id"], ["candidate_id"])


CANDIDATE_LISTS = f"""SELECT query_id, '[' || string_agg('{{"rank":' || rank || ',"candidate_id":' || candidate_id || '}}', ',' ORDER BY rank) || ']' AS top_candidates FROM ({DIRECT}) GROUP BY query_id"""


def district_inputs(spark, d):
    r = v.vector_records(spark, d)
    positions = r.select(F.col("vec_id").alias("position_id"), F.concat(F.lit("District "), (F.col("vec_id") % 11).cast("string"), F.lit(" of "), "city").alias("name"),
                         F.when(F.col("vec_id") % 23 == 0, "PR").otherwise(F.col("state")).alias("state"), v.pick(v.OFFICES, F.col("vec_id") % len(v.OFFICES)).alias("office"), "city", "embedding")
    districts = r.where("state is not null").select(F.col("vec_id").alias("district_id"), "district_name", F.col("election_type").alias("district_type"), "state", "embedding")
    return positions, districts, _generic(spark, d)


def _district_matching(spark, d):
    m = dm.match_districts(*district_inputs(spark, d))
    return m.select("position_id", "district_name", "is_matched", F.round("confidence", 4).alias("confidence"), F.round("top_embedding_score", 6).alias("top_embedding_score"))


def _user_matching(spark, d):
    """Users with a city: city boost, the best generic district that a list lacks, stricter for municipal offices."""
    m = dm.match_districts(*district_inputs(spark, d), city="city", variant="best_of_rest")
    return m.select("position_id", "district_name", "is_matched", F.round("confidence", 4).alias("confidence"), F.round("top_embedding_score", 6).alias("top_embedding_score"))


def _district_sql(city: bool = False) -> str:
    name, other = "lower(p.name)", "lower(d.district_name)"
    like, offers, first = (BOOSTED, 14, "QUALIFY row_number() OVER (PARTITION BY l.position_id ORDER BY g.rank) = 1") if city else (COS, 1, "")
    office = v.sql_pick(v.OFFICES, f"vec_id % {len(v.OFFICES)}")
    least = "CASE WHEN regexp_matches(lower(p.office), 'council|mayor|alderman|commissioner') AND trim(p.city) = '' THEN 70 ELSE 60 END" if city else "60"
    return f"""WITH {V}, d AS (SELECT vec_id AS district_id, district_name, state, embedding FROM vectors WHERE state IS NOT NULL),
  p AS (SELECT vec_id AS position_id, 'District ' || (vec_id % 11) || ' of ' || city AS name, CASE WHEN vec_id % 23 = 0 THEN 'PR' ELSE state END AS state, embedding, city, {office} AS office FROM vectors),
  listed AS (SELECT a.position_id, a.state, b.district_id, {like} AS s, row_number() OVER (PARTITION BY a.position_id ORDER BY {like} DESC, b.district_id) AS rank FROM p a JOIN d b ON a.state = b.state WHERE {like} > 0 QUALIFY rank <= 13),
  generic AS (SELECT b.state, b.district_id, row_number() OVER (PARTITION BY b.state ORDER BY {COS} DESC, b.district_id) AS rank FROM (SELECT * FROM vectors WHERE vec_id = 0) a, d b WHERE {COS} > 0 QUALIFY rank <= {offers}),
  fresh AS (SELECT l.position_id, g.district_id FROM (SELECT position_id, any_value(state) AS state, count(*) AS n FROM listed GROUP BY 1) l JOIN generic g USING (state)
    WHERE n >= 11 AND NOT EXISTS (SELECT 1 FROM listed x WHERE x.position_id = l.position_id AND x.district_id = g.district_id) {first}),
  merged AS (SELECT position_id, district_id, CASE WHEN rank >= 11 AND position_id IN (SELECT position_id FROM fresh) THEN rank + 1 ELSE rank END AS rank, s FROM listed UNION ALL SELECT position_id, district_id, 11, NULL FROM fresh),
  scored AS (SELECT m.*, d.district_name, round((1.0::DOUBLE - levenshtein({name}, {other}) / greatest(length({name}), length({other}))) * 100, 4) AS score
    FROM merged m JOIN d USING (district_id) JOIN p USING (position_id) WHERE rank <= 13),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY score DESC, rank) = 1), tops AS (SELECT position_id, s FROM listed WHERE rank = 1)
  SELECT p.position_id, CASE WHEN b.score >= {least} THEN b.district_name WHEN b.score IS NOT NULL THEN 'NOT_MATCHED' ELSE 'NO_VECTOR_STORE' END AS district_name, coalesce(b.score >= {least}, FALSE) AS is_matched,
    round(coalesce(b.score, 0.0), 4) AS confidence, round(t.s, 6) AS top_embedding_score FROM p LEFT JOIN best b USING (position_id) LEFT JOIN tops t USING (position_id)"""


DISTRICTS = _district_sql()
USERS = _district_sql(city=True)


def _buckets(spark, d):
    return mt.confidence_buckets(dm.match_districts(*district_inputs(spark, d)))


def _state_rates(spark, d):
    m = mt.state_match_rates(dm.match_districts(*district_inputs(spark, d)))
    return m.select("state", "records", "matched", F.round("match_rate", 6).alias("match_rate"), F.round("average_confidence", 4).alias("average_confidence"))


STATE_RATES = f"""SELECT state, count(*) AS records, count(*) FILTER (is_matched) AS matched, round(count(*) FILTER (is_matched) / count(*), 6) AS match_rate,
  round(avg(confidence) FILTER (is_matched), 4) AS average_confidence FROM ({DISTRICTS}) m JOIN (SELECT vec_id AS position_id, CASE WHEN vec_id % 23 = 0 THEN 'PR' ELSE state END AS state FROM (WITH {V} SELECT * FROM vectors)) USING (position_id) GROUP BY state"""


def _missing(spark, d):
    positions, districts, _ = district_inputs(spark, d)
    return mt.missing_keys(positions.where("state is not null"), districts)


def _quotes(spark, d):
    """The first sentence of every turn of a conversation, to be found again among all its turns."""
    c = v.table(spark, d, "conversations")
    messages = c.select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("message_id"), F.col("role").alias("phone_number"), F.col("text").alias("message_text"))
    quotes = c.select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("quote_id"), F.split("text", r"\. ")[0].alias("quote"))
    return messages, quotes


def _contained(spark, d):
    messages, quotes = _quotes(spark, d)
    out = qt.attribute_quotes(quotes, messages, one_per_phone=False).where("matched_by = 'contains'")
    return out.select("cluster_id", "quote_id", "message_id", "phone_number")


CONTAINED = f"""WITH m AS (SELECT conv_id, turn, role, lower(text) AS t FROM conversations), qs AS (SELECT conv_id, turn AS quote_id, {q.strip("lower(split_part(text, '. ', 1))")} AS quote FROM conversations)
  SELECT qs.conv_id AS cluster_id, quote_id, m.turn AS message_id, role AS phone_number FROM qs JOIN m ON m.conv_id = qs.conv_id AND contains(t, quote) QUALIFY row_number() OVER (PARTITION BY qs.conv_id, quote_id ORDER BY m.turn) = 1"""


def _one_per_phone(spark, d):
    messages, quotes = _quotes(spark, d)
    return qt.attribute_quotes(quotes, messages, fallback="first").select("cluster_id", "quote_id", "phone_number", "matched_by")


#: Every quote stands in its own turn, so each is found by containment; one quote per speaker.
ATTRIBUTED = f"""SELECT cluster_id, quote_id, phone_number, 'contains' AS matched_by FROM ({CONTAINED})
  QUALIFY row_number() OVER (PARTITION BY cluster_id, phone_number ORDER BY quote_id) = 1"""


def _claims(spark, d):
    p = v.table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    heading = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    kinds = F.array(F.struct(F.lit("title").alias("kind"), title.alias("quote")), F.struct(F.lit("missed heading").alias("kind"), F.concat(heading, F.lit(" zzz")).alias("quote")))
    return p.select("page_id", F.inline(kinds)), p.select("page_id", "html")


def _verify(spark, d):
    claims, pages = _claims(spark, d)
    return qt.verify_quotes(claims, pages, key="page_id", explain_misses=False).select("page_id", "kind", "match")


def _normal_sql(x: str) -> str:
    x = q.replace(x, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    x = q.replace(x, r"</?[a-zA-Z][^>]*>", " ")
    for a, b in [("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
        x = f"replace({x}, {v.quoted(a)}, {v.quoted(b)})"
    x = f"translate(lower({x}), '—–−‘’“” ', '---''''\"\" ')"
    return q.strip(q.replace(x, r"[\s\x0B\x1C-\x1F\x{85}\p{Z}.-]+", " "))


VERIFY = f"""WITH c AS (SELECT page_id, 'title' AS kind, regexp_extract(html, '<title>([^<]*)</title>', 1) AS quote FROM pages UNION ALL
    SELECT page_id, 'missed heading', regexp_extract(html, '<h1>([^<]*)</h1>', 1) || ' zzz' FROM pages), p AS (SELECT page_id, {_normal_sql('html')} AS body FROM pages)
  SELECT page_id, kind, {_normal_sql('quote')} <> '' AND contains(body, {_normal_sql('quote')}) AS match FROM c JOIN p USING (page_id)"""


def _verify_explained(spark, d):
    claims, pages = _claims(spark, d)
    return qt.verify_quotes(claims, pages, key="page_id").groupBy("match", F.floor(F.col("similarity") * 10).alias("tenth")).agg(F.count("*").alias("n"))


#: The longest block of a miss: the longest piece of the quote that the page contains.
EXPLAINED = f"""WITH c AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS quote FROM pages UNION ALL
    SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) || ' zzz' FROM pages), p AS (SELECT page_id, {_normal_sql('html')} AS body FROM pages),
  t AS (SELECT row_number() OVER () AS claim, {_normal_sql('quote')} AS q, body FROM c JOIN p USING (page_id)),
  sizes AS (SELECT claim, q, body, unnest(range(1, length(q) + 1)) AS size FROM t WHERE NOT (q <> '' AND contains(body, q))),
  pieces AS (SELECT claim, body, size, q, unnest(range(1, length(q) - size + 2)) AS place FROM sizes),
  best AS (SELECT claim, max(size) FILTER (contains(body, substr(q, place, size))) AS size FROM pieces GROUP BY claim),
  scored AS (SELECT q <> '' AND contains(body, q) AS match, CASE WHEN q <> '' AND contains(body, q) THEN 1.0::DOUBLE ELSE coalesce(best.size / length(q), 0.0::DOUBLE) END AS similarity
    FROM t LEFT JOIN best USING (claim))
  SELECT match, CAST(floor(similarity * 10) AS BIGINT) AS tenth, count(*) AS n FROM scored GROUP BY ALL"""


def _source_confidence(spark, d):
    o = v.table(spark, d, "orders")
    s = o.select((F.col("o_orderkey") % 4000).alias("atom_id"), (F.col("o_orderstatus") != "P").alias("verified"),
                 F.when(F.col("o_orderpriority") == "1-URGENT", "government_record").otherwise("web").alias("type"), (F.col("o_orderkey") % 9 == 0).cast("int").alias("n_disagreements"))
    return qt.source_confidence(s)


SOURCE_CONFIDENCE = """WITH s AS (SELECT o_orderkey % 4000 AS atom_id, o_orderstatus <> 'P' AS verified, o_orderpriority = '1-URGENT' AS gov, (o_orderkey % 9 = 0)::INTEGER AS dis FROM orders),
  a AS (SELECT atom_id, count(*) FILTER (verified) AS n, bool_or(verified AND gov) AS g, max(dis) AS dis FROM s GROUP BY 1),
  l AS (SELECT *, greatest(CASE WHEN n >= 2 AND g THEN 3 WHEN n >= 2 THEN 2 WHEN n = 1 THEN 1 ELSE 0 END - dis, 0) AS level FROM a)
  SELECT atom_id, n AS verified_sources, (['unknown', 'low', 'medium', 'high'])[level + 1] AS confidence, level > 0 AS keep_answer FROM l"""

QUERIES = {
    "block_topk_direct": (_direct, DIRECT),
    "block_topk_pruned": (_pruned, DIRECT),
    "block_topk_by_label": (_by_label, _topk_sql("a.label = b.label AND a.vec_id <> b.vec_id", 10)),
    "block_topk_stateless": (_stateless, STATELESS),
    "runoff_range_topk": (_runoff, RUNOFF),
    "block_nearest_l2": (_l2, L2),
    "district_topk": (lambda s, d: _rounded(ds.district_topk(v.vector_records(s, d).where("state is not null"), v.vector_records(s, d), **IDS)), _topk_sql("a.state = b.state", 13)),
    "district_topk_city_boost": (_district_city, _topk_sql("a.state = b.state", 13, BOOSTED)),
    "inject_generic_best": (lambda s, d: _inject(s, d, "best_only"), _inject_sql("best_only")),
    "inject_generic_rest": (lambda s, d: _inject(s, d, "best_of_rest"), _inject_sql("best_of_rest")),
    "vector_algebra": (_vector_algebra, VECTOR_ALGEBRA),
    "confidence_calibration": (_calibration, _calibration_sql()),
    "race_matching": (_race_matching, RACE_MATCHING),
    "match_statistics": (_match_statistics, MATCH_STATISTICS),
    "office_level_split": (_level_split, LEVEL_SPLIT),
    "candidate_list_json": (_candidate_lists, CANDIDATE_LISTS),
    "district_matching": (_district_matching, DISTRICTS),
    "user_matching": (_user_matching, USERS),
    "confidence_buckets": (_buckets, f"SELECT CASE WHEN is_matched AND confidence > 80 THEN 'high' WHEN is_matched AND confidence > 60 THEN 'medium' WHEN is_matched THEN 'low' ELSE 'no_match' END AS bucket, count(*) AS n FROM ({DISTRICTS}) GROUP BY 1"),
    "state_match_rates": (_state_rates, STATE_RATES),
    "missing_reference_states": (_missing, f"WITH {V} SELECT 'PR' AS state WHERE EXISTS (SELECT 1 FROM vectors WHERE vec_id % 23 = 0)"),
    "attribute_contained_quotes": (_contained, CONTAINED),
    "attribute_quotes": (_one_per_phone, ATTRIBUTED),
    "verify_quotes": (_verify, VERIFY),
    "verify_quotes_explained": (_verify_explained, EXPLAINED),
    "source_confidence": (_source_confidence, SOURCE_CONFIDENCE),
}
