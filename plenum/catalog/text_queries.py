"""Queries on message and document text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.catalog import sqltext as q
from plenum.catalog import views as v
from plenum.functions import fixed
from plenum.functions import privacy as pv
from plenum.functions import text as tx
from plenum.functions.broken_json import parse_broken_json
from plenum.operators import guards
from plenum.operators import messages as ms

M = v.messages_sql()
ALLOWED = [".example.com", "thther.example.org"]


def _clean_text(spark, d):
    return v.messages(spark, d).select("message_id", tx.clean_text("message_text").alias("cleaned"))


def _clean_documents(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.clean_text("text")).alias("light_md5"), F.md5(tx.clean_text_heavy("text")).alias("heavy_md5"))


def _clean_text_heavy(spark, d):
    return v.messages(spark, d).select("message_id", tx.clean_text_heavy("message_text").alias("cleaned"))


def _message_flags(spark, d):
    t = F.col("message_text")
    return v.messages(spark, d).select(
        "message_id", tx.is_stop_message(t).alias("is_stop"), tx.feedback_from_stop(t).alias("feedback"),
        tx.is_opt_out(t).alias("is_opt_out"), tx.is_non_substantive(t).alias("is_non_substantive"),
        tx.starts_with_emoji(t).alias("starts_with_emoji"), tx.has_civic_relevance(t).alias("has_civic_relevance"),
    )


MESSAGE_FLAGS = f"""WITH {M} SELECT message_id, {q.is_stop('message_text')} AS is_stop, {q.feedback('message_text')} AS feedback,
  {q.is_opt_out('message_text')} AS is_opt_out, {q.non_substantive('message_text')} AS is_non_substantive,
  {q.matches(q.strip('message_text'), f'^[{fixed.EMOJI}]')} AS starts_with_emoji,
  {q.matches('lower(message_text)', '|'.join(fixed.CIVIC_KEYWORDS))} AS has_civic_relevance FROM messages"""


def _text_lengths(spark, d):
    docs = v.table(spark, d, "documents").withColumn("c", tx.length_check("text"))
    return docs.select("doc_id", "c.*")


TEXT_LENGTHS = f"""SELECT doc_id, length(text)::INTEGER AS original_length, n::INTEGER AS cleaned_length, n >= 15 AS meets_min, n <= 5000 AS meets_max
  FROM (SELECT *, length({q.clean_text_heavy('text')}) AS n FROM documents)"""


def _filter_messages(spark, d):
    return ms.filter_messages(v.messages(spark, d)).select(
        "message_id", F.array_join("filter_reasons", ";").alias("reasons"), "passed", "filtered_text", "is_opt_out"
    )


FILTERED = f"""{M}, filtered AS (SELECT *, NOT (too_long OR is_opt_out) AS passed FROM (
  SELECT *, length(heavy) > 5000 AS too_long, {q.is_opt_out('message_text')} AS is_opt_out
  FROM (SELECT *, {q.clean_text_heavy('message_text')} AS heavy FROM messages)))"""
FILTER_MESSAGES = f"""WITH {FILTERED} SELECT message_id, CASE WHEN is_opt_out THEN 'STOP/opt-out message' ELSE '' END AS reasons, passed,
  CASE WHEN passed THEN heavy ELSE '' END AS filtered_text, is_opt_out FROM filtered"""


def _filter_statistics(spark, d):
    s = ms.filter_statistics(ms.filter_messages(v.messages(spark, d)))
    return s.select(
        F.coalesce("campaign_name", F.lit("all")).alias("campaign_name"), "total", "passed", F.round("pass_rate", 6).alias("pass_rate"),
        F.round("average_original_length", 4).alias("average_original_length"),
        F.round("average_filtered_length", 4).alias("average_filtered_length"),
    )


FILTER_STATISTICS = f"""WITH {FILTERED} SELECT coalesce(campaign_name, 'all') AS campaign_name, count(*) AS total,
  count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate,
  round(avg(length(message_text)), 4) AS average_original_length, round(avg(length(heavy)) FILTER (passed), 4) AS average_filtered_length
  FROM filtered GROUP BY GROUPING SETS ((campaign_name), ())"""


def _filter_reasons(spark, d):
    docs = v.table(spark, d, "documents").withColumnRenamed("text", "message_text")
    return ms.filter_reason_counts(ms.filter_messages(docs))


FILTER_REASONS = f"""WITH h AS (SELECT {q.clean_text_heavy('text')} AS heavy, {q.is_opt_out('text')} AS opt FROM documents)
  SELECT reason, count(*) AS n FROM (SELECT 'Too long' AS reason FROM h WHERE length(heavy) > 5000 UNION ALL
  SELECT 'STOP/opt-out message' FROM h WHERE opt) GROUP BY reason"""


def _exact_duplicates(spark, d):
    flagged = ms.exact_duplicates(v.messages(spark, d), "contact_phone_number", "message_text", "source_file", "source_row")
    return flagged.select("message_id", "is_exact_duplicate")


CHECKED = f"""{M}, checked AS (SELECT *, lower({q.clean_text('message_text')}) AS norm,
  contact_phone_number <> '' AND {q.strip('message_text')} <> '' AS usable FROM messages),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY usable, contact_phone_number, norm ORDER BY source_file, source_row) AS rn FROM checked)"""
EXACT_DUPLICATES = f"WITH {CHECKED} SELECT message_id, usable AND rn > 1 AS is_exact_duplicate FROM numbered"

# one step per message of a phone: the fold is sequential in SQL too
NEAR = f"""RECURSIVE {CHECKED},
  survivors AS (SELECT *, row_number() OVER (PARTITION BY contact_phone_number ORDER BY source_file, source_row) AS step,
    list_distinct(list_filter(regexp_split_to_array(norm, '\\s+'), lambda w: w <> '')) AS words FROM numbered WHERE usable AND rn = 1),
  fold AS (
    SELECT message_id, contact_phone_number, step, words AS kept, FALSE AS near FROM survivors WHERE step = 1
    UNION ALL
    SELECT message_id, contact_phone_number, step, CASE WHEN near THEN kept ELSE words END, near FROM (
      SELECT s.message_id, s.contact_phone_number, s.step, s.words, f.kept,
        len(s.words) > 0 AND len(f.kept) > 0 AND
        len(list_intersect(s.words, f.kept)) / (len(s.words) + len(f.kept) - len(list_intersect(s.words, f.kept))) > 0.9 AS near
      FROM fold f JOIN survivors s ON s.contact_phone_number = f.contact_phone_number AND s.step = f.step + 1)),
  duplicates AS (SELECT message_id FROM numbered WHERE usable AND rn > 1 UNION SELECT message_id FROM fold WHERE near)"""


def _near_duplicates(spark, d):
    df = v.messages(spark, d)
    flagged = ms.exact_duplicates(df, "contact_phone_number", "message_text", "source_file", "source_row")
    usable = flagged.where((F.col("contact_phone_number") != "") & (tx.strip("message_text") != "") & ~F.col("is_exact_duplicate"))
    return ms.near_duplicates(usable, "contact_phone_number", "message_text", "source_file", "source_row").select("source_file", "source_row")


NEAR_DUPLICATES = f"WITH {NEAR} SELECT source_file, source_row FROM fold JOIN messages USING (message_id) WHERE near"


def _clean_messages(spark, d):
    return ms.clean_messages(v.messages(spark, d)).select("message_id", "removal_reason", "cleaned_text")


VERDICTS = f"""{NEAR},
  step1 AS (SELECT *, {q.clean_text('message_text')} AS light FROM messages),
  step2 AS (SELECT *, {q.is_stop('light')} AS stop, {q.feedback('light')} AS fb FROM step1),
  step3 AS (SELECT *, CASE WHEN stop THEN coalesce(fb, light) ELSE light END AS kept FROM step2),
  verdicts AS (SELECT *, CASE WHEN {q.strip('message_text')} = '' THEN 'empty_message'
    WHEN message_id IN (SELECT message_id FROM duplicates) THEN 'duplicate' WHEN light = '' THEN 'empty_after_cleaning'
    WHEN stop AND fb IS NULL THEN 'stop_message' WHEN {q.non_substantive('kept')} THEN 'non_substantive' ELSE 'kept' END AS removal_reason FROM step3)"""
CLEAN_MESSAGES = f"WITH {VERDICTS} SELECT message_id, removal_reason, CASE WHEN removal_reason = 'kept' THEN kept END AS cleaned_text FROM verdicts"


def _cleaning_statistics(spark, d):
    return ms.cleaning_statistics(ms.clean_messages(v.messages(spark, d)))


CLEANING_STATISTICS = f"""WITH {VERDICTS} SELECT count(*) AS total_messages, count(*) FILTER (removal_reason = 'stop_message') AS removed_stop_messages,
  count(*) FILTER (removal_reason = 'duplicate') AS removed_duplicates,
  count(*) FILTER (removal_reason IN ('non_substantive', 'empty_message', 'empty_after_cleaning')) AS removed_non_substantive,
  count(*) FILTER (removal_reason = 'kept') AS remaining_substantive,
  count(*) FILTER (removal_reason = 'kept' AND kept <> message_text) AS text_normalizations FROM verdicts"""

TERMS = {"the": "THE", "ion": "$1", "main street": "[street]"}


def _anonymise(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.anonymise("text", TERMS)).alias("anonymised_md5"))


ANONYMISE = "SELECT doc_id, md5({0}) AS anonymised_md5 FROM documents".format(
    q.replace(q.replace(q.replace("text", r"(?i)\bthe\b", "THE"), r"(?i)\bion\b", "$1"), r"(?i)\bmain street\b", "[street]")
)


def _pii_scan(spark, d):
    return guards.scan_text(v.table(spark, d, "documents"), "text", "doc_id").groupBy("doc_id", "pattern_name", "matched_text").agg(
        F.count("*").alias("hits")
    )


def _pii_sql() -> str:
    parts = [
        f"SELECT doc_id, '{name}' AS pattern_name, unnest(regexp_extract_all(text, {v.quoted(p)})) AS m FROM documents"
        for name, p in fixed.PII_PATTERNS.items()
    ]
    return f"""SELECT doc_id, pattern_name, CASE WHEN length(m) > 2 THEN left(m, 1) || '***' || right(m, 1) WHEN length(m) = 2 THEN left(m, 1) || '*' ELSE m END
      AS matched_text, count(*) AS hits FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"""


def _record_scan(spark, d):
    docs = v.table(spark, d, "documents").select(
        "doc_id", F.struct("text", F.struct(F.array("text", F.col("lang")).alias("notes"), "source").alias("details")).alias("artifact")
    )
    return guards.scan_records(docs, "doc_id").groupBy("field_path", "pattern_name").agg(F.count("*").alias("hits"))


def _record_scan_sql() -> str:
    parts = [
        f"SELECT '{path}' AS field_path, '{name}' AS pattern_name, len(regexp_extract_all(text, {v.quoted(p)})) AS n FROM documents"
        for name, p in fixed.PII_PATTERNS.items()
        for path in ("artifact.text", "artifact.details.notes[0]")
    ]
    return f"SELECT field_path, pattern_name, sum(n)::BIGINT AS hits FROM ({' UNION ALL '.join(parts)}) WHERE n > 0 GROUP BY ALL"


def _sanitize_html(spark, d):
    return v.table(spark, d, "pages").select("page_id", pv.sanitize_html("html").alias("text"))


def _sanitize_sql(x: str) -> str:
    for p in fixed.MARKUP_PATTERNS:
        x = q.replace(x, p)
    return x


def _fence_content(spark, d):
    pages = v.table(spark, d, "pages").withColumn("content", pv.sanitize_html("html"))
    return pages.select("page_id", F.md5(pv.fence_content("content", "url", on_refusal="null")).alias("fenced_md5"))


def _escape_sql(x: str) -> str:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        x = f"replace({x}, {v.quoted(a)}, {v.quoted(b)})"
    return x


FENCE_CONTENT = f"""SELECT page_id, CASE WHEN NOT regexp_matches(c, '(?i)</?untrusted_web_content\\b') THEN
  md5('<untrusted_web_content source="' || {_escape_sql('url')} || '">' || c || '</untrusted_web_content>') END AS fenced_md5
  FROM (SELECT *, {_sanitize_sql('html')} AS c FROM pages)"""


def _publish_findings(spark, d):
    pages = v.table(spark, d, "pages").select("page_id", F.struct("html", "url").alias("artifact"))
    return guards.publish_findings(pages, "page_id")


PUBLISH_FINDINGS = """SELECT page_id, 'artifact.' || f AS field_path, kind AS finding FROM (
  SELECT page_id, 'html' AS f, html AS t FROM pages UNION ALL SELECT page_id, 'url', url FROM pages),
  (VALUES ('raw_html', '(?i)<script|<img\\b|javascript:'), ('fence_breakout', '(?i)</?untrusted_web_content\\b')) AS k(kind, p)
  WHERE regexp_matches(t, p)"""


def _host_allowed(spark, d):
    return v.table(spark, d, "pages").select("page_id", pv.url_host("url").alias("host"), pv.host_allowed("url", ALLOWED).alias("allowed"))


HOST_ALLOWED = """SELECT page_id, host, host IN ('example.com', 'thther.example.org') OR host LIKE '%.example.com' AS allowed
  FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)"""


def _split_messages(spark, d):
    atoms = ms.split_messages(ms.filter_messages(v.messages(spark, d)))
    return atoms.select("parent_message_id", "atomic_index", "atomic_text")


PIECES = q.strip("p")
SPLIT_CTE = f"""{FILTERED}, pieces AS (SELECT *, CASE WHEN NOT passed THEN [message_text]
    WHEN {q.strip('heavy')} = '' THEN [] WHEN len(found) > 0 THEN found ELSE [heavy] END AS atoms
  FROM (SELECT *, list_filter(list_transform(regexp_extract_all(heavy, '[^.!?;\\n]+[.!?;]*'), lambda p: {PIECES}), lambda p: p <> '') AS found FROM filtered)),
  atoms AS (SELECT message_id AS parent_message_id, campaign_name, unnest(atoms) AS atomic_text, (generate_subscripts(atoms, 1) - 1)::INTEGER AS atomic_index FROM pieces)"""
SPLIT_MESSAGES = f"WITH {SPLIT_CTE} SELECT parent_message_id, atomic_index, atomic_text FROM atoms"


def _splitting_impact(spark, d):
    filtered = ms.filter_messages(v.messages(spark, d)).where("passed")
    out = ms.splitting_impact(filtered, ms.split_messages(filtered))
    return out.withColumns({c: F.round(c, 6) for c in ("expansion_ratio", "average_length")})


SPLITTING_IMPACT = f"""WITH {SPLIT_CTE}, per_parent AS (SELECT parent_message_id, count(*) AS n, sum(length(atomic_text)) AS chars FROM atoms
    WHERE parent_message_id IN (SELECT message_id FROM filtered WHERE passed) GROUP BY 1),
  i AS (SELECT count(*) AS input_messages FROM filtered WHERE passed)
  SELECT input_messages, sum(n)::BIGINT AS output_messages, count(*) FILTER (n > 1) AS split_messages, count(*) FILTER (n = 1) AS single_messages,
    input_messages - count(*) AS dropped_messages, round(sum(n) / input_messages, 6) AS expansion_ratio,
    round(sum(chars) / sum(n), 6) AS average_length FROM per_parent, i GROUP BY input_messages"""


def _campaign_lengths(spark, d):
    out = ms.campaign_lengths(ms.split_messages(ms.filter_messages(v.messages(spark, d))))
    return out.withColumn("avg_length", F.round("avg_length", 4))


CAMPAIGN_LENGTHS = f"WITH {SPLIT_CTE} SELECT campaign_name, count(*) AS atomic_messages, round(avg(length(atomic_text)), 4) AS avg_length FROM atoms GROUP BY 1"


def _parse_model_json(spark, d):
    """Model answers with fences, doubled braces, trailing commas and indexes out of range."""
    e = v.table(spark, d, "orders")
    k = F.col("o_orderkey")
    body = F.concat(F.lit('"best_match": '), (k % 14).cast("string"), F.lit(', "confidence": '), (k % 101).cast("string"), F.lit(', "reasoning": "r'), (k % 7).cast("string"), F.lit('"'))
    answer = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n{"), body, F.lit("}\n```")))
        .when(k % 5 == 1, F.concat(F.lit("{{"), body, F.lit("}}")))
        .when(k % 5 == 2, F.concat(F.lit("{"), body, F.lit(",\n}")))
        .when(k % 5 == 3, F.concat(F.lit("  {"), body, F.lit("} ")))
        .otherwise(F.concat(F.lit("no json "), body))
    )
    schema = "struct<best_match:int,confidence:double,reasoning:string>"
    parsed = e.select(k.alias("answer_id"), tx.parse_json(answer, T.StructType.fromDDL(schema[7:-1])).alias("p"))
    return parsed.select("answer_id", tx.valid_choice(F.col("p.best_match"), F.lit(10)).alias("best_match"), "p.confidence", "p.reasoning")


PARSE_MODEL_JSON = """SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 14 BETWEEN 1 AND 10 THEN (o_orderkey % 14)::INTEGER END AS best_match,
  CASE WHEN o_orderkey % 5 <> 4 THEN (o_orderkey % 101)::DOUBLE END AS confidence,
  CASE WHEN o_orderkey % 5 <> 4 THEN 'r' || (o_orderkey % 7) END AS reasoning FROM orders"""


def _load_summary(spark, d):
    s = ms.load_summary(v.messages(spark, d), ["campaign_name", "send_direction", "message_type", "carrier"])
    return s.select(F.coalesce("dimension", F.lit("all")).alias("dimension"), F.coalesce("value", F.lit("all")).alias("value"), "n", "average_length")


LOAD_SUMMARY = f"WITH {M} " + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, coalesce({c}, 'Unknown') AS value, count(*) AS n, round(avg(length(message_text)), 1) AS average_length FROM messages GROUP BY ALL"
    for c in ["campaign_name", "send_direction", "message_type", "carrier"]
) + " UNION ALL SELECT 'all', 'all', count(*), round(avg(length(message_text)), 1) FROM messages"


def _text_length_profile(spark, d):
    p = ms.text_length_profile(v.table(spark, d, "documents").withColumn("t", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))), "text", "t")
    return p.withColumns({c: F.round(c, 6) for c in ("mean_length", "timestamp_coverage")})


TEXT_LENGTH_PROFILE = """SELECT count(*) AS total_messages, min(n)::INTEGER AS min_length, max(n)::INTEGER AS max_length, round(avg(n), 6) AS mean_length,
  round(avg((doc_id % 3 = 0)::INTEGER), 6) AS timestamp_coverage, list_sort(list(n))[count(*) // 2 + 1]::INTEGER AS median_length
  FROM (SELECT doc_id, length(text) AS n FROM documents)"""


def _metadata_fields(spark, d):
    """Keys of the metadata maps built from everything but the text."""
    from plenum.sources.readers import with_metadata
    rows = with_metadata(v.table(spark, d, "conversations"), "text")
    return rows.select(F.explode("metadata").alias("field", "value")).groupBy("field").agg(F.count("value").alias("filled"))


METADATA_FIELDS = """SELECT 'conv_id' AS field, count(conv_id) AS filled FROM conversations UNION ALL SELECT 'turn', count(turn) FROM conversations
  UNION ALL SELECT 'role', count(role) FROM conversations"""

INBOUND = f"WITH {M} SELECT message_id FROM messages WHERE upper(send_direction) = 'INBOUND'"

def _broken_json(spark, d):
    """Model answers with inner quotes, an early end, control characters or a fence, and what is read from them."""
    e = v.table(spark, d, "events")
    k, kind, n = F.col("event_id").cast("string"), F.col("event_id") % 5, (F.col("user_id") % 100).cast("string")
    tail = F.concat(F.lit('", "confidence": '), n)
    text = (
        F.when(kind == 0, F.concat(F.lit('{"reasoning": "ward "'), k, F.lit('" north'), tail, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"reasoning": "cut off at '), k))
        .when(kind == 2, F.concat(F.lit('{"reasoning": "bell \x07 '), k, tail, F.lit(",}")))
        .when(kind == 3, F.concat(F.lit('{"reasoning": "plain '), k, tail, F.lit("}")))
        .otherwise(F.concat(F.lit('```json\n{"reasoning": "said "yes", then '), k, tail, F.lit("}\n```")))
    )
    schema = T.StructType([T.StructField("reasoning", T.StringType()), T.StructField("confidence", T.LongType())])
    return e.select("event_id", parse_broken_json(text, schema).alias("p")).select("event_id", "p.reasoning", "p.confidence")


BROKEN_JSON = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ward ''' || event_id || ''' north' WHEN 1 THEN 'cut off at ' || event_id WHEN 2 THEN 'bell   ' || event_id WHEN 3 THEN 'plain ' || event_id
  ELSE 'said ''yes'', then ' || event_id END AS reasoning, CASE WHEN event_id % 5 <> 1 THEN (user_id % 100)::BIGINT END AS confidence FROM events"""


QUERIES = {
    "parse_broken_json": (_broken_json, BROKEN_JSON),
    "clean_text_light": (_clean_text, f"WITH {M} SELECT message_id, {q.clean_text('message_text')} AS cleaned FROM messages"),
    "clean_text_heavy": (_clean_text_heavy, f"WITH {M} SELECT message_id, {q.clean_text_heavy('message_text')} AS cleaned FROM messages"),
    "clean_documents": (_clean_documents, f"SELECT doc_id, md5({q.clean_text('text')}) AS light_md5, md5({q.clean_text_heavy('text')}) AS heavy_md5 FROM documents"),
    "message_flags": (_message_flags, MESSAGE_FLAGS),
    "text_lengths": (_text_lengths, TEXT_LENGTHS),
    "filter_messages": (_filter_messages, FILTER_MESSAGES),
    "filter_statistics": (_filter_statistics, FILTER_STATISTICS),
    "filter_reason_counts": (_filter_reasons, FILTER_REASONS),
    "exact_duplicates": (_exact_duplicates, EXACT_DUPLICATES),
    "near_duplicates": (_near_duplicates, NEAR_DUPLICATES),
    "cleaning_verdicts": (_clean_messages, CLEAN_MESSAGES),
    "cleaning_statistics": (_cleaning_statistics, CLEANING_STATISTICS),
    "anonymise_terms": (_anonymise, ANONYMISE),
    "pii_scan": (_pii_scan, _pii_sql()),
    "pii_scan_nested": (_record_scan, _record_scan_sql()),
    "sanitize_html": (_sanitize_html, f"SELECT page_id, {_sanitize_sql('html')} AS text FROM pages"),
    "fence_content": (_fence_content, FENCE_CONTENT),
    "publish_findings": (_publish_findings, PUBLISH_FINDINGS),
    "host_allowed": (_host_allowed, HOST_ALLOWED),
    "split_messages": (_split_messages, SPLIT_MESSAGES),
    "splitting_impact": (_splitting_impact, SPLITTING_IMPACT),
    "campaign_lengths": (_campaign_lengths, CAMPAIGN_LENGTHS),
    "parse_model_json": (_parse_model_json, PARSE_MODEL_JSON),
    "load_summary": (_load_summary, LOAD_SUMMARY),
    "text_length_profile": (_text_length_profile, TEXT_LENGTH_PROFILE),
    "metadata_fields": (_metadata_fields, METADATA_FIELDS),
    "inbound_only": (lambda s, d: ms.inbound_only(v.messages(s, d)).select("message_id"), INBOUND),
}
