"""Queries on issue insights, themes and polls."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import rule_queries as rq
from plenum.catalog import sqltext as q
from plenum.catalog import text_queries as tq
from plenum.catalog import views as v
from plenum.operators import insights as ins
from plenum.operators import messages as ms
from plenum.operators import polls as pl
from plenum.operators import rules
from plenum.plans import message_insights as mi
from plenum.sources import writers as wr

N, I = v.MENTIONS_SQL, v.ISSUE_MESSAGES_SQL
RANKED = "CASE stance WHEN 'negative' THEN 1 WHEN 'requesting' THEN 2 WHEN 'positive' THEN 3 ELSE 4 END"
STANCES = ("negative", "requesting", "positive", "neutral")
INSIGHTS = f"""{N}, strongest AS (SELECT issue, phone, min({RANKED}) AS level, count(*) AS n FROM mentions GROUP BY ALL),
  by_person AS (SELECT issue, count(*) AS unique_respondents, sum(n)::BIGINT AS total_mentions, {', '.join(f"count(*) FILTER (level = {i + 1}) AS {s}_respondents" for i, s in enumerate(STANCES))} FROM strongest GROUP BY issue),
  by_mention AS (SELECT issue, {', '.join(f"count(*) FILTER (stance = '{s}') AS {s}_mentions" for s in STANCES)} FROM mentions GROUP BY issue),
  insights AS (SELECT *, round(total_mentions / unique_respondents, 1) AS mentions_per_respondent,
    (negative_respondents / unique_respondents * 0.7::DOUBLE + least(1.0::DOUBLE, unique_respondents / 30) * 0.3::DOUBLE) * 100 AS urgency_score FROM by_person JOIN by_mention USING (issue))"""


def _insights(spark, d, mode="respondent"):
    out = ins.issue_insights(v.mentions(spark, d), mode)
    return out.withColumn("urgency_score", F.round("urgency_score", 6))


INSIGHTS_MESSAGE = f"""WITH {N}, m AS (SELECT issue, count(*) AS total_mentions, {', '.join(f"count(*) FILTER (stance = '{s}') AS {s}_mentions" for s in STANCES)} FROM mentions GROUP BY issue)
  SELECT *, total_mentions AS unique_respondents, {', '.join(f'{s}_mentions AS {s}_respondents' for s in STANCES)}, 1.0::DOUBLE AS mentions_per_respondent,
  round((negative_mentions / total_mentions * 0.7::DOUBLE + least(1.0::DOUBLE, total_mentions / 50) * 0.3::DOUBLE) * 100, 6) AS urgency_score FROM m"""


def _stances(spark, d):
    return ins.strongest_stances(v.mentions(spark, d))


def _distribution(spark, d):
    m = v.mentions(spark, d)
    a, b = ins.distribution(m, ["issue"], "stance", "stances"), ins.distribution(m, ["issue"], "overall_sentiment", "sentiments")
    return a.join(b, "issue").select("issue", F.to_json("stances").alias("stances"), F.to_json("sentiments").alias("sentiments"))


def _map_sql(column: str) -> str:
    return f"(SELECT issue, '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' AS t FROM (SELECT issue, {column} AS k, count(*) AS n FROM mentions GROUP BY ALL) GROUP BY issue)"


def _samples(spark, d):
    m = v.mentions(spark, d)
    joined = ins.sample_messages(m).join(ins.key_concerns(m), "issue", "left")
    return joined.select("issue", F.array_join("sample_messages", "|").alias("samples"), F.array_join("key_concerns", "|").alias("concerns"))


SAMPLES = f"""WITH {N}, first AS (SELECT issue, phone, min(message_id) AS i FROM mentions GROUP BY ALL), picked AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY issue ORDER BY i) <= 5),
  s AS (SELECT issue, string_agg(left(message_text, 100), '|' ORDER BY i) AS samples FROM picked JOIN mentions USING (issue) WHERE message_id = i GROUP BY issue),
  c AS (SELECT issue, string_agg(specific_concern, '|' ORDER BY i) AS concerns FROM (SELECT * FROM (SELECT issue, specific_concern, min(message_id) AS i FROM mentions WHERE specific_concern <> '' GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY issue ORDER BY i) <= 5) GROUP BY issue)
  SELECT issue, samples, concerns FROM s LEFT JOIN c USING (issue)"""


def _compound(spark, d):
    return ins.compound_patterns(v.issue_messages(spark, d))


COMPOUND = f"""WITH {I}, keyed AS (SELECT message_id, any_value(message_text) AS message_text, string_agg(issue, ' + ' ORDER BY issue) AS combination FROM issue_rows GROUP BY 1 HAVING count(*) >= 2),
  frequent AS (SELECT * FROM (SELECT combination, count(*) AS frequency, min(message_id) AS first FROM keyed GROUP BY 1 ORDER BY frequency DESC, first, combination LIMIT 20) WHERE frequency >= 2),
  members AS (SELECT k.* FROM keyed k JOIN frequent USING (combination)),
  modal AS (SELECT combination, issue, stance FROM (SELECT combination, issue, stance, count(*) AS n, min(message_id) AS seen FROM members JOIN issue_rows USING (message_id) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY combination, issue ORDER BY n DESC, seen) = 1),
  st AS (SELECT combination, string_agg(issue || ':' || stance, '|' ORDER BY issue) AS common_stances FROM modal GROUP BY 1),
  sm AS (SELECT combination, string_agg(left(message_text, 150), '|' ORDER BY message_id) AS sample_messages FROM (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY combination ORDER BY message_id) <= 3) GROUP BY 1)
  SELECT combination, frequency, common_stances, sample_messages FROM frequent JOIN st USING (combination) JOIN sm USING (combination)"""
EFFECTS = f"{I}, effects AS (SELECT DISTINCT c.issue AS root_cause, e.issue AS effect FROM issue_rows c JOIN issue_rows e USING (message_id) WHERE c.is_root_cause AND NOT e.is_root_cause AND c.issue <> e.issue)"


def _actionability(spark, d):
    return ins.actionability(ins.issue_insights(v.mentions(spark, d)), ins.root_cause_effects(v.issue_messages(spark, d)))


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(replace(replace({x}, '_', ' '), '/', ': '), '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(r[1]) || lower(r[2:])), '')"


ACTIONABILITY = f"""WITH {INSIGHTS}, {EFFECTS},
  a AS (SELECT 'priority' AS kind, {_title('issue')} || ' (' || total_mentions || ' complaints, ' || round(negative_mentions / total_mentions * 100)::INTEGER || '% negative)' AS line FROM insights
    WHERE total_mentions >= 5 AND negative_mentions / total_mentions >= 0.7 ORDER BY line LIMIT 5),
  b AS (SELECT 'success', {_title('issue')} || ' (' || positive_mentions || ' positive mentions)' AS line FROM insights WHERE positive_mentions >= 2 ORDER BY line LIMIT 3),
  c AS (SELECT 'immediate', 'Address ' || {_title('root_cause')} || ' (root cause affecting ' || count(*) || ' issues)' AS line FROM effects GROUP BY root_cause ORDER BY line LIMIT 3)
  SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""


def _by_stance(spark, d):
    insights = ins.issue_insights(v.mentions(spark, d))
    out = None
    for s, n in (("negative", 10), ("positive", 5), ("requesting", 10)):
        part = ins.issues_by_stance(insights, s, n).select(F.lit(s).alias("stance"), "issue", F.round("stance_share", 6).alias("stance_share"))
        out = part if out is None else out.unionByName(part)
    return out


BY_STANCE = f"WITH {INSIGHTS} " + " UNION ALL ".join(
    f"(SELECT '{s}' AS stance, issue, round({s}_mentions / total_mentions, 6) AS stance_share FROM insights WHERE {s}_mentions >= 2 OR ({s}_mentions > 0 AND {s}_mentions / total_mentions >= 0.2) "
    f"ORDER BY {s}_mentions / total_mentions DESC, issue LIMIT {n})" for s, n in (("negative", 10), ("positive", 5), ("requesting", 10)))


def _synthesis(spark, d):
    out = ins.category_synthesis(v.mentions(spark, d))
    return out.withColumn("stance_distribution", F.to_json("stance_distribution"))


SYNTHESIS = f"""WITH {N} SELECT primary_category, secondary_category, count(*) AS message_count, count(DISTINCT phone) AS unique_respondents, any_value(t) AS stance_distribution,
  CASE WHEN count(*) < 20 THEN 'summary' ELSE 'cluster' END AS method FROM mentions JOIN {_map_sql('stance')} USING (issue) GROUP BY 1, 2"""


def _category_clusters(spark, d):
    m = v.mentions(spark, d).withColumn("cluster_id", (F.length("specific_concern") - 10).cast("int") + (F.col("message_id") % 5).cast("int"))
    out = ins.category_clusters(m, min_messages=10)
    lines = F.transform("clusters", lambda c: F.concat_ws(":", c["cluster_id"].cast("string"), c["messages"].cast("string")))
    return out.select("primary_category", "secondary_category", "message_count", F.array_join(lines, ",").alias("clusters"))


CATEGORY_CLUSTERS = f"""WITH {N}, sized AS (SELECT primary_category, secondary_category, length(specific_concern) - 10 + message_id % 5 AS c, count(*) AS n FROM mentions GROUP BY ALL),
  rolled AS (SELECT primary_category, secondary_category, sum(n)::BIGINT AS message_count, string_agg(CASE WHEN c <> -1 AND n >= 3 THEN c || ':' || n END, ',' ORDER BY c) AS t FROM sized GROUP BY 1, 2)
  SELECT primary_category, secondary_category, message_count, CASE WHEN message_count < 10 OR t IS NULL THEN '0:' || message_count ELSE t END AS clusters FROM rolled"""


def _person_metrics(spark, d):
    return pl.person_metrics(v.mentions(spark, d), ["issue"], ["phone"])


PERSON_METRICS = f"""WITH {N}, p AS (SELECT issue, phone, count(*) AS n FROM mentions GROUP BY ALL), a AS (SELECT count(DISTINCT phone) AS people FROM mentions)
  SELECT issue, count(*) AS respondents_by_row, sum(n)::BIGINT AS total_mentions, max(n) AS max_mentions_per_respondent, round(sum(n) / count(*), 2) AS avg_mentions_per_respondent,
  round(count(*) * 100 / any_value(people), 2) AS respondent_coverage_pct FROM p, a GROUP BY issue"""


def _themed(spark, d):
    m = v.mentions(spark, d)
    topics = F.array(F.col("primary_category"), F.col("specific_concern"))
    return m.select("message_id", F.col("phone").alias("phone_number"), "message_text", F.col("secondary_category").alias("theme"), F.col("stance").alias("sentiment"),
                    F.lit("civic").alias("category"), (F.col("message_id") % 10 / 10).alias("theme_confidence"), topics.alias("key_topics"))


def _theme_rollup(spark, d):
    r = pl.theme_rollup(_themed(spark, d))
    return r.withColumns({"key_topics": F.array_join("key_topics", ","), "sample_messages": F.array_join("sample_messages", "|")})


THEMED = f"{N}, themed AS (SELECT message_id, phone AS phone_number, message_text, secondary_category AS theme, stance AS sentiment, message_id % 10 / 10 AS conf, [primary_category, specific_concern] AS topics FROM mentions)"
THEME_ROLLUP = f"""WITH {THEMED}, everyone AS (SELECT count(DISTINCT phone_number) AS people FROM themed),
  base AS (SELECT theme, count(DISTINCT phone_number) AS respondents_by_phone, count(*) AS total_messages, round(avg(conf), 3) AS avg_confidence, 'civic' AS category FROM themed GROUP BY theme),
  modal AS (SELECT theme, sentiment FROM (SELECT theme, sentiment, count(*) AS n, min(message_id) AS f FROM themed GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY theme ORDER BY n DESC, f) = 1),
  topic AS (SELECT theme, string_agg(t, ',' ORDER BY t) AS key_topics FROM (SELECT * FROM (SELECT DISTINCT theme, unnest(topics) AS t FROM themed) QUALIFY row_number() OVER (PARTITION BY theme ORDER BY t) <= 5) GROUP BY theme),
  sample AS (SELECT theme, string_agg(message_text, '|' ORDER BY message_id) AS sample_messages FROM (SELECT * FROM themed QUALIFY row_number() OVER (PARTITION BY theme ORDER BY message_id) <= 3) GROUP BY theme)
  SELECT theme, respondents_by_phone, total_messages, avg_confidence, category, round(respondents_by_phone * 100 / people, 2) AS coverage_pct, sentiment, key_topics, sample_messages
  FROM base CROSS JOIN everyone JOIN modal USING (theme) JOIN topic USING (theme) JOIN sample USING (theme)"""


def _enough(spark, d):
    counts = _themed(spark, d).groupBy("theme").agg(F.countDistinct("phone_number").alias("respondents_by_phone"))
    few, many = pl.enough_respondents(counts, 10**9), pl.enough_respondents(counts, 10, at_least=3)
    return few.withColumn("minimum", F.lit("unreachable")).unionByName(many.withColumn("minimum", F.lit("ten")))


ENOUGH = f"""WITH {THEMED}, c AS (SELECT theme, count(DISTINCT phone_number) AS respondents_by_phone FROM themed GROUP BY 1)
  SELECT *, 'unreachable' AS minimum FROM c UNION ALL SELECT *, 'ten' FROM c WHERE respondents_by_phone >= 10 OR (SELECT count(*) FROM c WHERE respondents_by_phone >= 10) < 3"""


def records(spark, d):
    """Unified poll records: a poll per primary area, a cluster per issue, opt-outs without clusters."""
    m = v.mentions(spark, d)
    k = F.col("message_id")
    cluster = F.when(k % 11 == 0, -1).otherwise(F.ascii("secondary_category") % 7)
    quotes = F.array(F.struct(F.concat(F.lit("quote "), F.col("secondary_category")).alias("quote"), F.lit("555").alias("phone_number")))
    entry = F.struct(
        cluster.cast("int").alias("cluster_id"), F.concat(F.lit("theme "), cluster.cast("string")).alias("cluster_theme"), F.lit("civic").alias("cluster_category"),
        F.concat(F.lit("summary "), k.cast("string")).alias("issues_summary"), F.lit("analysis").alias("detailed_analysis"), F.col("stance").alias("cluster_sentiment"), quotes.alias("quotes"),
    )
    opt_out = k % 13 == 0
    return m.select(
        k.alias("atomic_id"), F.col("primary_category").alias("poll_id"), F.col("phone").alias("phone_number"), "message_text", "sent_at", opt_out.alias("is_opt_out"),
        F.lit("camp").alias("campaign_id"), F.lit(None).cast("string").alias("original_message"), F.lit(None).cast("string").alias("atomic_message"),
        F.when(~opt_out, F.create_map(F.lit("15"), entry)).alias("multi_cluster_data"),
    )


RECORDS = f"""{N}, records AS (SELECT message_id AS atomic_id, primary_category AS poll_id, phone AS phone_number, message_text, sent_at, stance, secondary_category,
  message_id % 13 = 0 AS is_opt_out, CASE WHEN message_id % 11 = 0 THEN -1 ELSE ascii(secondary_category) % 7 END AS cluster_id FROM mentions),
  clusters AS (SELECT poll_id, cluster_id, count(DISTINCT phone_number) AS response_count, min(atomic_id) AS first_seen FROM records WHERE NOT is_opt_out AND cluster_id <> -1 GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY poll_id ORDER BY response_count DESC, first_seen, cluster_id) AS rank FROM clusters WHERE response_count >= 10 QUALIFY rank <= 3)"""


def _polls(spark, d):
    known = records(spark, d).select("poll_id").distinct()
    return known.unionByName(known.select(F.concat("poll_id", F.lit("_silent")).alias("poll_id")))


def _poll_completion(spark, d):
    c = pl.poll_completion(_polls(spark, d), records(spark, d), minimum=10)
    line = F.transform("issues", lambda i: F.concat_ws(":", i["rank"].cast("string"), i["cluster_id"].cast("string"), i["response_count"].cast("string"), i["summary"]))
    return c.select("poll_id", "total_responses", F.coalesce(F.array_join(line, "|"), F.lit("")).alias("issues"))


POLL_COMPLETION = f"""WITH {RECORDS}, polls AS (SELECT DISTINCT poll_id FROM records UNION ALL SELECT DISTINCT poll_id || '_silent' FROM records),
  counted AS (SELECT poll_id, count(DISTINCT phone_number) FILTER (NOT is_opt_out) AS total_responses FROM records GROUP BY 1),
  issues AS (SELECT poll_id, string_agg(rank || ':' || cluster_id || ':' || response_count || ':summary ' || first_seen, '|' ORDER BY rank) AS issues FROM ranked GROUP BY 1)
  SELECT poll_id, coalesce(total_responses, 0) AS total_responses, coalesce(issues, '') AS issues FROM polls LEFT JOIN counted USING (poll_id) LEFT JOIN issues USING (poll_id)"""


def _poll_events(spark, d):
    e = pl.poll_events(pl.poll_completion(_polls(spark, d), records(spark, d), minimum=10), "s3://x")
    g = lambda p: F.get_json_object("event", p)
    return e.select("poll_id", g("$.type").alias("type"), g("$.data.totalResponses").cast("bigint").alias("responses"), g("$.data.issues[0].clusterId").cast("bigint").alias("first_cluster"),
                    g("$.data.issues[0].quotes[0].phone_number").alias("first_quote_phone"))


POLL_EVENTS = POLL_COMPLETION.replace("SELECT poll_id, coalesce(total_responses, 0) AS total_responses, coalesce(issues, '') AS issues FROM polls",
    "SELECT poll_id, 'pollAnalysisComplete' AS type, coalesce(total_responses, 0) AS responses, r.cluster_id::BIGINT AS first_cluster, CASE WHEN r.cluster_id IS NOT NULL THEN '555' END AS first_quote_phone "
    "FROM polls LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (poll_id)")


def _message_export(spark, d):
    return pl.message_export(records(spark, d))


MESSAGE_EXPORT = f"""WITH {RECORDS} SELECT atomic_id AS "atomicId", phone_number AS "phoneNumber", strftime(sent_at, '%Y-%m-%dT%H:%M:%S') AS "receivedAt", message_text AS "originalMessage",
  message_text AS "atomicMessage", poll_id AS "pollId", CASE WHEN is_opt_out OR cluster_id = -1 THEN '' ELSE cluster_id::VARCHAR END AS "clusterId",
  CASE WHEN is_opt_out THEN 'Opt Out Request' ELSE 'theme ' || cluster_id END AS theme, CASE WHEN is_opt_out THEN '' ELSE 'civic' END AS category,
  CASE WHEN is_opt_out THEN '' ELSE 'summary ' || atomic_id END AS summary, CASE WHEN is_opt_out THEN '' ELSE stance END AS sentiment, is_opt_out AS "isOptOut" FROM records"""


def _wide(spark, d):
    fields = {"cluster_id": "value", "cluster_theme": "value", "quotes": "json"}
    r = records(spark, d).select("atomic_id", "multi_cluster_data")
    return pl.wide_clusters(r, ["15"], fields)


WIDE = f"""WITH {RECORDS} SELECT atomic_id, CASE WHEN NOT is_opt_out THEN cluster_id::INTEGER END AS cluster_id_merged, CASE WHEN NOT is_opt_out THEN 'theme ' || cluster_id END AS cluster_theme_merged,
  CASE WHEN NOT is_opt_out THEN '[{{"quote":"quote ' || secondary_category || '","phone_number":"555"}}]' ELSE '' END AS quotes_merged FROM records"""


def _cluster_maps(spark, d):
    m = v.mentions(spark, d).select("message_id", F.explode(F.array(F.lit(5), F.lit(10))).alias("configuration"))
    m = m.withColumn("cluster_id", F.col("message_id") % F.col("configuration")).withColumn("theme", F.concat(F.lit("t"), F.col("cluster_id").cast("string")))
    return pl.cluster_maps(m, "message_id", "configuration", ["cluster_id", "theme"]).select("message_id", F.to_json("multi_cluster_data").alias("clusters"))


CLUSTER_MAPS = """SELECT event_id AS message_id, '{"10":{"cluster_id":' || event_id % 10 || ',"theme":"t' || event_id % 10 || '"},"5":{"cluster_id":' || event_id % 5 || ',"theme":"t' || event_id % 5 || '"}}' AS clusters FROM events"""


def _enriched(spark, d):
    m = v.mentions(spark, d).select(F.lit("p").alias("poll_id"), F.col("message_text").alias("original_message_text"), "message_text", F.col("phone").alias("phone_number"),
                                    "primary_category", "secondary_category", "stance", "specific_concern")
    # one category is summarised under another name, so that its mentions find no summary
    other = F.when(F.col("secondary_category") == "error", "no such").otherwise(F.col("secondary_category"))
    sizes = v.mentions(spark, d).withColumn("secondary_category", other).groupBy("primary_category", "secondary_category").agg(F.count("*").alias("n"))
    summaries = sizes.select("primary_category", "secondary_category", F.lit("theme").alias("theme"), F.concat(F.col("n").cast("string"), F.lit(" messages")).alias("summary"),
                             F.lit("deep").alias("analysis"), F.array(F.lit("q1")).alias("quotes"), F.array(F.struct(F.col("n").alias("message_count"))).alias("clusters"))
    return wr.enriched_export(m, summaries).groupBy("category", "theme", "summary", "quotes", "cluster_analysis", "sentiment").agg(F.count("*").alias("n"), F.min("analysis").alias("analysis"))


ENRICHED = f"""WITH {N}, s AS (SELECT primary_category, CASE WHEN secondary_category = 'error' THEN 'no such' ELSE secondary_category END AS secondary_category, count(*) AS c FROM mentions GROUP BY ALL)
  SELECT issue AS category, CASE WHEN c IS NULL THEN '' ELSE 'theme' END AS theme, coalesce(c || ' messages', '') AS summary, CASE WHEN c IS NULL THEN '[]' ELSE '["q1"]' END AS quotes,
  CASE WHEN c IS NULL THEN '[]' ELSE '[{{"message_count":' || c || '}}]' END AS cluster_analysis, stance AS sentiment, count(*) AS n, min(CASE WHEN c IS NULL THEN specific_concern ELSE 'deep' END) AS analysis
  FROM mentions LEFT JOIN s USING (primary_category, secondary_category) GROUP BY issue, c, stance"""


def _issue_report(spark, d):
    r = mi.issue_report(v.messages(spark, d))
    return r.select("issue", "unique_respondents", "total_mentions", F.round("urgency_score", 4).alias("urgency_score"), F.array_join("sample_messages", "|").alias("samples"), F.array_join("key_concerns", "|").alias("concerns"))


INBOUND_VERDICTS = tq.VERDICTS.replace("messages AS (", "all_messages AS (", 1).replace(
    v.messages_sql().split("messages AS (", 1)[1], v.messages_sql().split("messages AS (", 1)[1] + ",\n  messages AS (SELECT * FROM all_messages WHERE upper(send_direction) = 'INBOUND')", 1)
FOUND = f"""mentions AS (SELECT i.message_id, {q.phone('k.contact_phone_number')} AS phone, k.message_text, p || '/' || s AS issue, st AS stance, c AS specific_concern,
    row_number() OVER (PARTITION BY i.message_id ORDER BY pos) AS idx FROM issues i JOIN kept_messages k USING (message_id) WHERE {q.phone('k.contact_phone_number')} <> '')"""
MESSAGE_INSIGHTS = f"""WITH {INBOUND_VERDICTS}, kept_messages AS (SELECT message_id, contact_phone_number, kept AS message_text FROM verdicts WHERE removal_reason = 'kept'),
  {rq.classified_sql('kept_messages', with_given=False)}, {INSIGHTS.replace(N, FOUND)},
  firsts AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY issue, phone ORDER BY message_id, idx) = 1),
  sm AS (SELECT issue, string_agg(left(message_text, 100), '|' ORDER BY message_id, idx) AS samples FROM (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY issue ORDER BY message_id, idx) <= 5) GROUP BY issue),
  fc AS (SELECT * FROM mentions WHERE specific_concern <> '' QUALIFY row_number() OVER (PARTITION BY issue, specific_concern ORDER BY message_id, idx) = 1),
  kc AS (SELECT issue, string_agg(specific_concern, '|' ORDER BY message_id, idx) AS concerns FROM (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY issue ORDER BY message_id, idx) <= 5) GROUP BY issue)
  SELECT issue, unique_respondents, total_mentions, round(urgency_score, 4) AS urgency_score, samples, concerns FROM insights LEFT JOIN sm USING (issue) LEFT JOIN kc USING (issue)"""

def _issue_mentions(spark, d):
    """One row per message and issue, with the phone brought to one form."""
    m = v.issue_messages(spark, d).withColumn("overall_sentiment", rules.overall_sentiment("issues"))
    m = m.withColumn("phone", F.concat(F.lit("+1 (555) 000-"), F.lpad("phone", 4, "0")))
    return ins.mentions(m, phone="phone").select("message_id", "phone", "issue", "stance", "is_root_cause", F.col("issue_index").cast("bigint").alias("issue_index"))


ISSUE_MENTIONS = f"""WITH {I} SELECT message_id, '555000' || lpad(user_id::VARCHAR, 4, '0') AS phone, issue, stance, is_root_cause,
  row_number() OVER (PARTITION BY message_id ORDER BY event_type) - 1 AS issue_index FROM issue_rows"""


def _lineage(spark, d):
    """Atomic messages back to their message, file and line."""
    atoms = ms.split_messages(ms.filter_messages(v.messages(spark, d))).withColumn("cluster_id", F.col("atomic_index"))
    return pl.lineage(atoms)


LINEAGE = f"""WITH {tq.SPLIT_CTE} SELECT atomic_index AS cluster_id, parent_message_id || '-' || atomic_index AS atomic_id, parent_message_id, source_file, source_row
  FROM atoms JOIN messages ON message_id = parent_message_id"""


def _atomised(spark, d):
    m = v.mentions(spark, d)
    unknown = {c: F.lit("Unknown") for c in ("round", "age_group", "voting_performance_category", "location", "ward")}
    m = m.withColumns({"original_row_idx": F.col("message_id"), "atomic_idx": F.lit(0), "phone_number": F.col("phone"), "campaign_source": F.lit("c"),
                       "voters_gender": F.when(F.col("message_id") % 2 == 0, "F"), **unknown})
    return wr.atomised_export(m).select("original_row_idx", "phone_number", "voters_gender", "ward", "primary_category", "stance", "specific_concern")


ATOMISED = f"""WITH {N} SELECT message_id AS original_row_idx, phone AS phone_number, CASE WHEN message_id % 2 = 0 THEN 'F' ELSE '' END AS voters_gender, 'Unknown' AS ward,
  primary_category, stance, specific_concern FROM mentions"""

QUERIES = {
    "issue_mentions": (_issue_mentions, ISSUE_MENTIONS),
    "lineage_trace": (_lineage, LINEAGE),
    "atomised_export": (_atomised, ATOMISED),
    "issue_insights": (_insights, f"WITH {INSIGHTS} SELECT * EXCLUDE (urgency_score), round(urgency_score, 6) AS urgency_score FROM insights"),
    "issue_insights_by_message": (lambda s, d: _insights(s, d, "message"), INSIGHTS_MESSAGE),
    "strongest_stances": (_stances, f"WITH {N} SELECT issue, phone, (['negative', 'requesting', 'positive', 'neutral'])[min({RANKED})] AS strongest_stance FROM mentions GROUP BY ALL"),
    "stance_distributions": (_distribution, f"WITH {N} SELECT issue, a.t AS stances, b.t AS sentiments FROM {_map_sql('stance')} a JOIN {_map_sql('overall_sentiment')} b USING (issue)"),
    "sample_messages": (_samples, SAMPLES),
    "compound_patterns": (_compound, COMPOUND),
    "root_cause_effects": (lambda s, d: ins.root_cause_effects(v.issue_messages(s, d)), f"WITH {EFFECTS} SELECT * FROM effects"),
    "sentiment_by_issue": (lambda s, d: ins.sentiment_by_issue(v.mentions(s, d)), f"WITH {N} SELECT issue, stance, count(*) AS mentions FROM mentions GROUP BY ALL"),
    "hierarchy_counts": (lambda s, d: ins.hierarchy_counts(v.mentions(s, d)), f"WITH {N} SELECT primary_category, secondary_category, count(*) AS mentions FROM mentions GROUP BY ROLLUP (primary_category, secondary_category)"),
    "issues_by_stance": (_by_stance, BY_STANCE),
    "top_issues": (lambda s, d: ins.top_issues(ins.issue_insights(v.mentions(s, d))).select("issue", "total_mentions"), f"WITH {N} SELECT issue, count(*) AS total_mentions FROM mentions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "actionability": (_actionability, ACTIONABILITY),
    "category_synthesis": (_synthesis, SYNTHESIS),
    "category_clusters": (_category_clusters, CATEGORY_CLUSTERS),
    "person_metrics": (_person_metrics, PERSON_METRICS),
    "theme_rollup": (_theme_rollup, THEME_ROLLUP),
    "enough_respondents": (_enough, ENOUGH),
    "poll_clusters": (lambda s, d: pl.poll_clusters(records(s, d)).select("poll_id", "cluster_id", "response_count", "first_seen", "summary"),
                      f"WITH {RECORDS} SELECT poll_id, cluster_id::INTEGER AS cluster_id, response_count, first_seen, 'summary ' || first_seen AS summary FROM clusters"),
    "rank_clusters": (lambda s, d: pl.rank_clusters(pl.poll_clusters(records(s, d)), 10).select("poll_id", "cluster_id", F.col("rank").cast("bigint").alias("rank")),
                      f"WITH {RECORDS} SELECT poll_id, cluster_id::INTEGER AS cluster_id, rank FROM ranked"),
    "poll_completion": (_poll_completion, POLL_COMPLETION),
    "poll_events": (_poll_events, POLL_EVENTS),
    "message_export": (_message_export, MESSAGE_EXPORT),
    "wide_cluster_export": (_wide, WIDE),
    "cluster_maps": (_cluster_maps, CLUSTER_MAPS),
    "enriched_export": (_enriched, ENRICHED),
    "message_insights": (_issue_report, MESSAGE_INSIGHTS),
}
