"""Queries on rule-based classification and its validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import sqltext as q
from plenum.catalog import views as v
from plenum.functions import fixed
from plenum.functions import text as tx
from plenum.operators import insights as ins
from plenum.operators import messages as ms
from plenum.operators import rules
from plenum.session import cut_lineage

M = v.messages_sql()
T = "lower(message_text)"


def _hit(patterns: list[str]) -> str:
    return q.matches(T, tx.any_of(patterns))


def _reason_sql() -> str:
    s = q.strip(T)
    return "CASE " + " ".join(f"WHEN {q.matches(s, tx.any_of(p))} THEN {v.quoted(r)}" for r, p in fixed.UNCATEGORIZED_RULES) + " END"


def _given():
    """Issues that some messages already carry: police, general taxes, or business."""
    def one(p, s, st, c):
        return F.struct(F.lit(p).alias("primary_category"), F.lit(s).alias("secondary_category"), F.lit(st).alias("stance"),
                        F.lit(c).alias("specific_concern"), F.lit(False).alias("is_root_cause"))
    k = F.col("message_id")
    return F.array_compact(F.array(
        F.when(k % 3 == 0, one("public_safety", "police", "negative", "police problem is bad")),
        F.when(k % 4 == 0, one("government_operations", "budget_and_taxes", "positive", "taxes too high")),
        F.when(k % 5 == 0, one("economic_development", "jobs_and_business", "requesting", "angry business love")),
    ))


def classified(spark, d):
    return rules.classify(v.messages(spark, d).withColumn("given", _given()), issues="given")


def classified_sql(source: str = "messages", with_given: bool = True) -> str:
    required, n = [], 10
    for rule in fixed.CATEGORY_RULES:
        for p, s, st, c, root in rule["required"]:
            required.append(f"SELECT message_id, message_text, reason, '{p}' AS p, '{s}' AS s, '{st}' AS st, {v.quoted(c)} AS c, {root} AS root, {n} AS pos FROM reasoned WHERE {_hit(rule['triggers'])}")
            n += 1
    tax = _hit(fixed.CATEGORY_RULES[1]["triggers"])
    ebike, force = _hit(fixed.EBIKE_TRIGGERS), _hit(fixed.ENFORCEMENT_WORDS)
    p, s, st, c, root = fixed.BUSINESS_PERMIT_ISSUE
    return f"""reasoned AS (SELECT *, {_reason_sql()} AS reason FROM {source}),
  given AS (SELECT message_id, message_text, reason, u.p, u.s, u.st, u.c, FALSE AS root, u.pos FROM reasoned, (VALUES
    (3, 'public_safety', 'police', 'negative', 'police problem is bad', 0), (4, 'government_operations', 'budget_and_taxes', 'positive', 'taxes too high', 1),
    (5, 'economic_development', 'jobs_and_business', 'requesting', 'angry business love', 2)) AS u(m, p, s, st, c, pos) WHERE {with_given} AND message_id % u.m = 0),
  required AS ({' UNION ALL '.join(required)}),
  added AS (SELECT * FROM given UNION ALL SELECT * FROM required),
  ruled AS (SELECT * FROM added WHERE NOT (p = 'government_operations' AND s = 'budget_and_taxes' AND {tax})
    AND NOT (contains(s, 'police') AND {ebike} AND NOT {force})),
  refined AS (SELECT * FROM ruled UNION ALL SELECT message_id, message_text, reason, '{p}', '{s}', '{st}', '{c}', {root}, 99 FROM reasoned r
    WHERE {q.matches(T, fixed.BUSINESS_PERMIT_PATTERN)} AND EXISTS (SELECT 1 FROM ruled x WHERE x.message_id = r.message_id AND (contains(x.p, 'economic_development') OR contains(x.s, 'business')))
    AND NOT EXISTS (SELECT 1 FROM ruled x WHERE x.message_id = r.message_id AND contains(x.s, 'zoning_and_permits'))),
  issues AS (SELECT * FROM refined WHERE reason IS NULL),
  per_message AS (SELECT r.message_id, r.message_text, r.reason, count(i.p) AS n, coalesce(bool_or(st = 'positive'), FALSE) AS positive, coalesce(bool_or(st = 'negative'), FALSE) AS negative,
    coalesce(bool_or(st = 'requesting'), FALSE) AS requesting, coalesce(bool_or(contains(c, 'angry')), FALSE) AS angry,
    coalesce(string_agg(p || '/' || s || ':' || st || '(' || c || ')', '|' ORDER BY pos), '') AS issues_text, coalesce(string_agg(CASE WHEN root THEN p || '/' || s END, '|' ORDER BY pos), '') AS root_causes,
    length({q.strip('r.message_text')}) AS len FROM reasoned r LEFT JOIN issues i USING (message_id) GROUP BY r.message_id, r.message_text, r.reason),
  classified AS (SELECT *, CASE WHEN n = 0 THEN 'other' WHEN positive AND negative THEN 'constructive_detailed' WHEN positive THEN 'appreciative_positive'
    WHEN angry THEN 'angry_confrontational' ELSE 'frustrated_urgent' END AS overall_sentiment,
    CASE WHEN len < 20 OR n = 0 THEN 'minimal_response' ELSE 'substantive' END AS message_quality,
    least(0.95::DOUBLE, 0.7::DOUBLE + n * 0.1::DOUBLE + least(len, 200) / 1000) AS confidence_score FROM per_message),
  typed AS (SELECT *, CASE WHEN positive THEN 'support_appreciation' WHEN requesting AND contains(message_text, '?') THEN 'question_request' WHEN requesting THEN 'policy_feedback'
    WHEN n > 0 AND message_quality = 'substantive' THEN 'policy_feedback' ELSE 'general_complaint' END AS content_type FROM classified)"""


CLASSIFIED = f"{M}, {classified_sql()}"


def _classify(spark, d):
    return classified(spark, d).select(
        "message_id", "uncategorized_reason", tx.issue_strings("issues").alias("issues_text"), tx.root_cause_strings("issues").alias("root_causes"),
        "overall_sentiment", "message_quality", "content_type", F.round("confidence_score", 6).alias("confidence_score"),
    )


CLASSIFY = f"""WITH {CLASSIFIED} SELECT message_id, reason AS uncategorized_reason, issues_text, root_causes, overall_sentiment, message_quality, content_type,
  round(confidence_score, 6) AS confidence_score FROM typed"""


def _required(spark, d):
    m = v.messages(spark, d)
    return m.select(
        "message_id", F.array_join(F.transform(rules.required_issues("message_text"), tx.issue_key), "|").alias("required"),
        F.array_join(rules.avoided_categories("message_text"), "|").alias("avoided"),
    )


def _required_sql() -> str:
    parts = [
        f"CASE WHEN {_hit(r['triggers'])} THEN {v.quoted('|'.join(f'{p}/{s}' for p, s, *_ in r['required']))} END" for r in fixed.CATEGORY_RULES
    ]
    return f"""WITH {M} SELECT message_id, concat_ws('|', {', '.join(parts)}) AS required,
      CASE WHEN {_hit(fixed.CATEGORY_RULES[1]['triggers'])} THEN 'government_operations/budget_and_taxes' ELSE '' END AS avoided FROM messages"""


def _given_messages(spark, d):
    """Messages whose given issues are taken as the classification, to be validated."""
    m = v.messages(spark, d).withColumn("issues", _given().cast(rules.ISSUE_TYPE))
    return m.withColumn("should_be_uncategorized", F.col("message_id") % 6 == 0).withColumn("confidence_score", F.lit(0.9))


def _findings(spark, d):
    f = rules.validate(_given_messages(spark, d)).select("message_id", F.explode("findings").alias("f"))
    return f.select("message_id", "f.*").groupBy("message_id", "severity", "issue_type", "description").agg(F.count("*").alias("n"))


def findings_sql() -> str:
    missing, avoided = [], "government_operations/budget_and_taxes"
    for r in fixed.CATEGORY_RULES:
        for p, s, *_ in r["required"]:
            missing.append(f"SELECT message_id, 'error' AS severity, 'missing_required_category' AS issue_type, 'Missing required category: {p}/{s}' AS description FROM b WHERE {_hit(r['triggers'])}")
    truck = q.matches(T, "|".join(fixed.TRUCK_WORDS))
    return f"""{M}, b AS (SELECT *, {_reason_sql()} AS reason, message_id % 3 = 0 AS police, message_id % 4 = 0 AS taxes, message_id % 5 = 0 AS business, message_id % 6 = 0 AS flagged FROM messages),
  findings AS (SELECT message_id, 'error' AS severity, 'classification_rule_violation' AS issue_type, 'Property tax misclassified as general budget/taxes' AS description FROM b
      WHERE {q.matches(T, 'property' + chr(92) + 's+tax')} AND taxes
    UNION ALL SELECT message_id, 'error', 'classification_rule_violation', 'E-bike/scooter incorrectly categorized as police issue without enforcement context' FROM b
      WHERE {_hit(fixed.EBIKE_TRIGGERS)} AND police AND NOT {_hit(fixed.ENFORCEMENT_WORDS)}
    UNION ALL SELECT message_id, 'error', 'missed_uncategorized', 'Message should be uncategorized: ' || reason FROM b WHERE reason IS NOT NULL AND NOT flagged
    UNION ALL SELECT message_id, 'warning', 'uncategorized_with_issues', 'Message marked uncategorized but has identified issues' FROM b WHERE flagged AND (police OR taxes OR business)
    UNION ALL {' UNION ALL '.join(missing)}
    UNION ALL SELECT message_id, 'warning', 'avoided_category_used', 'Used category that should be avoided: {avoided}' FROM b WHERE taxes AND {_hit(fixed.CATEGORY_RULES[1]['triggers'])}
    UNION ALL SELECT message_id, 'suggestion', 'missing_root_cause', 'Truck/warehouse complaint should include zoning as root cause' FROM b WHERE {truck}
    UNION ALL SELECT message_id, 'warning', 'stance_concern_mismatch', 'Positive stance but negative concern: taxes too high' FROM b WHERE taxes),
  validated AS (SELECT b.message_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'suggestion') AS suggestions
    FROM b LEFT JOIN findings f USING (message_id) GROUP BY b.message_id),
  adjusted AS (SELECT *, CASE WHEN errors > 0 THEN greatest(0.1::DOUBLE, 0.9::DOUBLE - errors * 0.2::DOUBLE) WHEN warnings > 0 THEN greatest(0.3::DOUBLE, 0.9::DOUBLE - 0.1::DOUBLE) END AS adjustment FROM validated)"""


FINDINGS = findings_sql()


def _validation_summary(spark, d):
    s = ins.validation_summary(rules.validate(_given_messages(spark, d)))
    return s.withColumns({c: F.round(c, 6) for c in ("validation_pass_rate", "average_confidence_adjustment")})


VALIDATION_SUMMARY = f"""WITH {FINDINGS} SELECT count(*) AS total_messages, count(*) FILTER (errors = 0) AS valid_messages, round(count(*) FILTER (errors = 0) / count(*), 6) AS validation_pass_rate,
  sum(errors)::BIGINT AS error_count, sum(warnings)::BIGINT AS warning_count, sum(suggestions)::BIGINT AS suggestion_count, count(adjustment) AS confidence_adjustments_applied,
  round(avg(adjustment), 6) AS average_confidence_adjustment FROM adjusted"""


def _unknown_categories(spark, d):
    return rules.unknown_categories(v.issue_messages(spark, d).unionByName(classified(spark, d).select(
        "message_id", F.col("contact_phone_number").alias("phone"), "message_text", "issues", "should_be_uncategorized")))


def _taxonomy_use(spark, d):
    """How often every category of the fixed tree is used by the classified messages."""
    used = classified(spark, d).select(F.explode("issues").alias("i")).groupBy(tx.issue_key(F.col("i")).alias("category")).agg(F.count("*").alias("mentions"))
    return rules.taxonomy(spark).select("category", "description").join(used, "category", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


TAXONOMY_VALUES = ", ".join(f"({v.quoted(f'{p}/{s}')}, {v.quoted(text)})" for p, children in fixed.TAXONOMY.items() for s, text in children.items())


def _selectors(spark, d):
    c = classified(spark, d).withColumn("is_substantive", F.col("message_quality") == "substantive")
    # classified once: four selections read the few columns that are written here
    c = cut_lineage(c.select("message_id", "overall_sentiment", "issues", "should_be_uncategorized", "is_substantive"))
    picks = {
        "sentiment": ms.by_sentiment(c, "frustrated_urgent"), "stance": ms.by_issue_stance(c, "Housing_And_Development", "negative"),
        "uncategorised": ms.uncategorised(c), "substantive": ms.substantive(c),
    }
    out = None
    for name, df in picks.items():
        part = df.select("message_id", F.lit(name).alias("selector"))
        out = part if out is None else out.unionByName(part)
    return out


SELECTORS = f"""WITH {CLASSIFIED} SELECT message_id, 'sentiment' AS selector FROM typed WHERE overall_sentiment = 'frustrated_urgent'
  UNION ALL SELECT DISTINCT message_id, 'stance' FROM issues WHERE p = 'housing_and_development' AND st = 'negative'
  UNION ALL SELECT message_id, 'uncategorised' FROM typed WHERE reason IS NOT NULL UNION ALL SELECT message_id, 'substantive' FROM typed WHERE message_quality = 'substantive'"""


def _root_frequency(spark, d):
    return ins.root_cause_frequency(classified(spark, d))


def _quality_counts(spark, d):
    return ins.value_counts(classified(spark, d), ["overall_sentiment", "message_quality", "content_type"])


QUALITY_COUNTS = f"WITH {CLASSIFIED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM typed GROUP BY ALL" for c in ("overall_sentiment", "message_quality", "content_type"))

QUERIES = {
    "classify_messages": (_classify, CLASSIFY),
    "required_and_avoided": (_required, _required_sql()),
    "validate_messages": (_findings, f"WITH {FINDINGS} SELECT message_id, severity, issue_type, description, count(*) AS n FROM findings GROUP BY ALL"),
    "validation_summary": (_validation_summary, VALIDATION_SUMMARY),
    "validation_issue_types": (
        lambda s, d: ins.validation_issue_types(rules.validate(_given_messages(s, d))),
        f"WITH {FINDINGS} SELECT issue_type, count(*) AS n FROM findings GROUP BY 1 ORDER BY n DESC, issue_type LIMIT 5"),
    "unknown_categories": (_unknown_categories, f"WITH {v.ISSUE_MESSAGES_SQL} SELECT issue AS category, count(*) AS mentions FROM issue_rows GROUP BY 1"),
    "taxonomy_use": (_taxonomy_use, f"WITH {CLASSIFIED}, used AS (SELECT p || '/' || s AS category, count(*) AS mentions FROM issues GROUP BY 1) "
                     f"SELECT t.category, t.description, coalesce(mentions, 0) AS mentions FROM (VALUES {TAXONOMY_VALUES}) AS t(category, description) LEFT JOIN used USING (category)"),
    "message_selectors": (_selectors, SELECTORS),
    "root_cause_frequency": (_root_frequency, f"WITH {CLASSIFIED} SELECT p || '/' || s AS root_cause, count(*) AS mentions FROM issues WHERE root GROUP BY 1"),
    "quality_counts": (_quality_counts, QUALITY_COUNTS),
}
