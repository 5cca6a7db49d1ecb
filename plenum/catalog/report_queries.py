"""Queries on profiles, coverage, usage, conversations and event lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from plenum.catalog import text_queries as tq
from plenum.catalog import views as v
from plenum.functions import fixed
from plenum.operators import guards
from plenum.operators import profile as pf
from plenum.operators import usage as us
from plenum.sources import readers as rd
from plenum.sources import writers as wr

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _profile(spark, d):
    """Nulls are put in by a rule: every seventh flag and every fifth date."""
    li = v.table(spark, d, "lineitem").withColumn("l_returnflag", F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag"))).withColumn(
        "l_shipdate", F.when(F.col("l_suppkey") % 5 != 0, F.col("l_shipdate")))
    return pf.table_profile(li).select("column_name", "row_count", "non_null_count", "null_count")


def _profile_sql() -> str:
    masked = {"l_returnflag": "l_partkey % 7 <> 0", "l_shipdate": "l_suppkey % 5 <> 0"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count({f'CASE WHEN {masked[c]} THEN {c} END' if c in masked else c}) AS non_null_count, "
        f"count(*) - count({f'CASE WHEN {masked[c]} THEN {c} END' if c in masked else c}) AS null_count FROM lineitem" for c in LINEITEM)


def _coverage(spark, d):
    c = v.candidates(spark, d)
    return pf.column_coverage(c, ["state", "city", "candidate_office"]).withColumn("coverage_pct", F.round("coverage_pct", 6))


COVERAGE = f"WITH {v.candidates_sql()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(nullif({c}, '')) AS filled, round(count(nullif({c}, '')) * 100.0::DOUBLE / count(*), 6) AS coverage_pct, count(DISTINCT nullif({c}, '')) AS distinct_values FROM raw_candidates"
    for c in ("state", "city", "candidate_office"))


def _extract_report(spark, d):
    o = v.table(spark, d, "orders").withColumn("d", F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return pf.extract_report(o, "d").withColumn("valid_share", F.round("valid_share", 6))


def _schemas(spark, d):
    return pf.schema_rows(spark, {n: v.table(spark, d, n) for n in ("documents", "labels", "benchmark")}
                          | {"orders_a": v.table(spark, d, "orders"), "orders_b": v.table(spark, d, "orders").drop("o_totalprice")})


COLUMNS = """c AS (SELECT * FROM (VALUES ('documents', (SELECT count(*) FROM documents)), ('labels', (SELECT count(*) FROM labels))) AS t(n, x))"""


def _overlap(spark, d):
    """Columns shared by tables, with the rows behind each pair."""
    o = pf.column_overlap(_schemas(spark, d))
    sizes = None
    for name, table in (("documents", "documents"), ("labels", "labels"), ("benchmark", "benchmark"), ("orders_a", "orders"), ("orders_b", "orders")):
        part = v.table(spark, d, table).agg(F.count("*").alias("rows")).select(F.lit(name).alias("left_table"), "rows")
        sizes = part if sizes is None else sizes.unionByName(part)
    return o.join(sizes, "left_table")


OVERLAP = """WITH s AS (SELECT 'documents' AS t, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS c UNION ALL SELECT 'labels', unnest(['doc_id', 'quality', 'toxic']) UNION ALL SELECT 'benchmark', unnest(['item_id', 'text'])
    UNION ALL SELECT 'orders_a', unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) UNION ALL SELECT 'orders_b', unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority'])),
  n AS (SELECT 'documents' AS t, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'orders_a', count(*) FROM orders UNION ALL SELECT 'orders_b', count(*) FROM orders)
  SELECT a.t AS left_table, b.t AS right_table, string_agg(a.c, ',' ORDER BY a.c) AS shared_columns, any_value(rows) AS rows FROM s a JOIN s b ON a.c = b.c AND a.t <> b.t JOIN n ON n.t = a.t GROUP BY ALL"""


def _common(spark, d):
    """Columns that all of a set of tables have, with their filled rows in the first one."""
    o = v.table(spark, d, "orders")
    s = pf.schema_rows(spark, {"a": o, "b": o.drop("o_totalprice"), "c": o.select("o_orderkey", "o_custkey", "o_totalprice")})
    return pf.common_columns(s).join(pf.table_profile(o), "column_name").select("column_name", "non_null_count")


def _stage_flow(spark, d):
    from plenum.operators import messages as ms
    m = v.messages(spark, d)
    inbound = ms.inbound_only(m)
    return pf.stage_flow({"loaded": m, "inbound": inbound, "passed": ms.filter_messages(inbound).where("passed")}).select("stage", "rows")


STAGE_FLOW = f"""WITH {tq.FILTERED} SELECT 'loaded' AS stage, count(*) AS rows FROM messages UNION ALL SELECT 'inbound', count(*) FROM messages WHERE upper(send_direction) = 'INBOUND'
  UNION ALL SELECT 'passed', count(*) FROM filtered WHERE passed AND upper(send_direction) = 'INBOUND'"""


def _outcomes(spark, d):
    o = v.table(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F")
    return pf.outcome_shares(o, "ok").withColumn("success_share", F.round("success_share", 6))


def usage_log(spark, d):
    c = v.table(spark, d, "conversations")
    n = len(fixed.MODEL_PRICES) + 1
    model = v.pick([m for m, *_ in fixed.MODEL_PRICES] + ["unknown-model"], (F.col("conv_id") + F.col("turn")) % n)
    tokens = us.estimated_tokens("text")
    only_total = F.col("turn") % 3 == 0
    return c.select("conv_id", "turn", F.col("role"), model.alias("model"), tokens.cast("bigint").alias("total_tokens"),
                    F.when(~only_total, F.floor(tokens / 2)).alias("prompt_tokens"), F.when(~only_total, tokens - F.floor(tokens / 2)).alias("completion_tokens"))


def _usage_sql() -> str:
    n = len(fixed.MODEL_PRICES) + 1
    prices = ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in fixed.MODEL_PRICES)
    model = v.sql_pick([m for m, *_ in fixed.MODEL_PRICES] + ["unknown-model"], f"(conv_id + turn) % {n}")
    return f"""prices AS (SELECT * FROM (VALUES {prices}) AS t(model, pin, pout)), log AS (SELECT role, {model} AS model, turn, greatest(1, length(text) // 4) AS t FROM conversations),
      calls AS (SELECT role, log.model, t, CASE WHEN turn % 3 = 0 THEN floor(t * 0.7::DOUBLE)::BIGINT ELSE t // 2 END AS p, CASE WHEN turn % 3 = 0 THEN t - floor(t * 0.7::DOUBLE)::BIGINT ELSE t - t // 2 END AS c,
        coalesce(pin, 0.30) AS pin, coalesce(pout, 2.50) AS pout FROM log LEFT JOIN prices USING (model)), costed AS (SELECT *, p / 1000000 * pin + c / 1000000 * pout AS cost FROM calls)"""


def _usage(spark, d):
    s = us.usage_summary(us.usage_cost(usage_log(spark, d), us.price_table(spark)), "model")
    return s.withColumns({c: F.round(c, 9) for c in ("total_cost", "average_cost_per_call")})


def _usage_default(spark, d):
    s = us.usage_summary(us.usage_cost(usage_log(spark, d)), "role")
    return s.withColumns({c: F.round(c, 9) for c in ("total_cost", "average_cost_per_call")})


def _usage_query(key: str) -> str:
    return f"""WITH {_usage_sql()} SELECT {key}, sum(t)::BIGINT AS total_tokens, sum(p)::BIGINT AS total_prompt_tokens, sum(c)::BIGINT AS total_completion_tokens, count(*) AS call_count, round(sum(cost), 9) AS total_cost,
      floor(sum(t) / count(*))::BIGINT AS average_tokens_per_call, round(sum(cost) / count(*), 9) AS average_cost_per_call FROM costed GROUP BY {key}"""


def conversation_log(spark, d):
    """Conversation turns as log lines: assistant turns call a tool per role and print text."""
    c = v.table(spark, d, "conversations")
    t = F.col("turn")
    item = F.struct(F.when(t % 2 == 1, "tool_use").otherwise("text").alias("type"), v.pick(["Bash", "Read", "Grep"], F.col("conv_id") % 3).alias("name"),
                    F.lit(None).cast("map<string,string>").alias("input"), F.col("text").alias("text"))
    kind = F.when(F.col("role") == "assistant", "assistant").when(F.col("role") == "system", "result").otherwise("tool_result")
    return c.select(kind.alias("type"), F.struct(F.when(F.col("role") == "assistant", F.array(item)).alias("content")).alias("message"),
                    F.when(F.col("role") == "user", F.col("text")).alias("content"), (F.col("conv_id") % 5 == 0).alias("is_error"),
                    F.when(F.col("role") == "system", F.col("conv_id") / 10).alias("total_cost_usd"), F.when(F.col("role") == "system", F.col("conv_id")).alias("num_turns"))


def _checks(spark, d):
    k = F.col("o_orderkey")

    def check(name, passed, detail):
        return F.struct(name.alias("name"), passed.alias("passed"), detail.alias("detail"))

    none = F.lit(None).cast("string")
    checks = F.array(check(F.lit("schema"), k % 2 == 0, F.lit("bad schema")), check(none, F.when(k % 3 != 0, k % 3 == 1), F.lit("x")), check(F.lit("size"), k % 5 != 0, none))
    return us.failed_checks(v.table(spark, d, "orders").select("o_orderkey", checks.alias("checks"))).select("o_orderkey", F.array_join("violations", ";").alias("violations"))


CHECKS = """SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 2 <> 0 THEN 'schema: bad schema' END, CASE WHEN o_orderkey % 3 = 2 THEN '<unnamed>: x' END, CASE WHEN o_orderkey % 5 = 0 THEN 'size' END) AS violations FROM orders"""


def _event_scores(spark, d):
    """Each order is a run that lists up to 13 events."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 14

    def task(i):
        seed = k + i
        title = F.concat(F.lit(" Event "), (seed % 6).cast("string"))
        day = F.when(seed % 7 != 0, F.date_format(F.date_add("o_orderdate", (i * 30).cast("int")), "yyyy-MM-dd")).otherwise("soon")
        return F.struct(title.alias("title"), day.alias("date"), F.when(seed % 3 == 0, "https://x.org").when(seed % 3 == 1, "ftp://x.org").alias("url"))

    none = F.array().cast("array<struct<title:string,date:string,url:string>>")
    tasks = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), task)).otherwise(none)
    expected = F.array(*[F.struct(F.lit(f"event {i}").alias("title")) for i in (0, 1, 9)])
    runs = v.table(spark, d, "orders").select(k.alias("run_id"), tasks.alias("tasks"), F.lit("2000-06-01").alias("election_date"), expected.alias("expected"))
    s = us.event_list_scores(runs, date(1996, 1, 1))
    return s.select("run_id", *[F.round(c, 6).alias(c) for c in s.columns if c != "run_id"])


EVENT_SCORES = """WITH t AS (SELECT o_orderkey, o_orderdate, unnest(range(o_orderkey % 14)) AS i FROM orders),
  r AS (SELECT o_orderkey AS run_id, count(i) AS n, count(*) FILTER (i IS NOT NULL AND (o_orderkey + i) % 7 <> 0 AND o_orderdate::DATE + (i * 30)::INTEGER BETWEEN DATE '1996-01-01' AND DATE '2000-06-01') AS dated,
    count(*) FILTER (i IS NOT NULL AND (o_orderkey + i) % 3 <> 1) AS linked, count(DISTINCT (o_orderkey + i) % 6) AS titles, count(DISTINCT CASE WHEN (o_orderkey + i) % 6 IN (0, 1) THEN (o_orderkey + i) % 6 END) AS shared
    FROM orders LEFT JOIN t USING (o_orderkey, o_orderdate) GROUP BY o_orderkey)
  SELECT run_id, round(CASE WHEN n BETWEEN 5 AND 8 THEN 1.0::DOUBLE WHEN n < 5 THEN n / 5 ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (n - 8) / 8) END, 6) AS count_in_range,
  coalesce(round(dated / nullif(n, 0), 6), 0.0) AS dates_in_range, coalesce(round(linked / nullif(n, 0), 6), 0.0) AS urls_valid,
  CASE WHEN n = 0 THEN 0.0 ELSE round(shared / (titles + 3 - shared), 6) END AS title_overlap FROM r"""


def _scoped(spark, d):
    """What a caller scoped to one segment and two nations sees."""
    c = v.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"), F.col("c_nationkey").cast("string").alias("city"))
    return guards.scoped_view(c, "scoped_customers", "MACHINERY", ["3", "7"])


def _split_counts(spark, d):
    c = v.candidates(spark, d).withColumn("category", F.when(F.col("state").isNull(), "Questionable").when(F.col("candidate_office") == "", "Unmatchable").otherwise("Matchable"))
    return pf.category_counts(c, "category")


def _unfinished(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    done = o.where("o_orderkey % 3 = 0").withColumn("result", F.when(F.col("o_orderkey") % 2 == 0, "done"))
    return wr.unfinished(o, done, "o_orderkey", "result").groupBy("o_custkey").agg(F.count("*").alias("todo"))


def _demographics(spark, d):
    k = F.col("message_id")
    m = v.messages(spark, d).select(k.alias("source_row"), F.col("contact_phone_number").alias("Contact Phone Number"), F.col("message_text").alias("Message Text"), F.col("campaign_name").alias("Campaign ID"),
                                    F.when(k % 2 == 0, (k % 90).cast("string")).otherwise("old").alias("voters_age"), F.when(k % 3 == 0, "Ward 1").alias("ward"))
    return rd.demographic_messages(m, "c").groupBy("poll_id", "ward", "income_level").agg(F.count("*").alias("n"), F.count("voters_age").alias("ages"), F.round(F.avg("voters_age"), 6).alias("mean_age"))


DEMOGRAPHICS = f"""WITH {v.messages_sql()} SELECT campaign_name AS poll_id, CASE WHEN message_id % 3 = 0 THEN 'Ward 1' ELSE 'Unknown' END AS ward, 'Unknown' AS income_level, count(*) AS n,
  count(*) FILTER (message_id % 2 = 0) AS ages, round(avg(message_id % 90) FILTER (message_id % 2 = 0), 6) AS mean_age FROM messages WHERE trim(message_text) <> '' GROUP BY ALL"""


def _poll_records(spark, d):
    m = v.messages(spark, d)
    raw = m.select(F.col("contact_phone_number").alias("Phone"), F.col("message_text").alias("body"), F.when(F.col("message_id") % 4 == 0, "not a date").otherwise(
        F.concat(F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))).alias("Sent At"), F.when(F.col("message_id") % 3 == 0, F.col("campaign_name")).alias("Poll ID"), F.lit("file").alias("_stem"))
    r = rd.poll_records(rd.normalise_columns(raw), "camp", F.lit("2030-01-01").cast("timestamp"))
    return r.groupBy("poll_id", "round", F.year("sent_at").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("phone_number").alias("phones"))


POLL_RECORDS = f"""WITH {v.messages_sql()} SELECT CASE WHEN message_id % 3 = 0 THEN campaign_name ELSE 'file' END AS poll_id, 'R1' AS round, (CASE WHEN message_id % 4 = 0 THEN 2030 ELSE year(sent_at) END)::INTEGER AS year,
  count(*) AS n, count(DISTINCT contact_phone_number) AS phones FROM messages WHERE contact_phone_number <> '' AND message_text <> '' GROUP BY ALL"""

QUERIES = {
    "table_profile": (_profile, _profile_sql()),
    "column_coverage": (_coverage, COVERAGE),
    "top_values": (lambda s, d: pf.top_values(v.candidates(s, d), "candidate_office"), f"WITH {v.candidates_sql()} SELECT candidate_office AS value, count(*) AS n FROM raw_candidates GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"),
    "monthly_trend": (lambda s, d: pf.monthly_trend(v.table(s, d, "orders"), "o_orderdate"), "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12"),
    "extract_report": (_extract_report, "SELECT count(*) AS row_count, 7::BIGINT AS column_count, min(o_orderdate::DATE) FILTER (o_orderkey % 9 <> 0) AS first_date, max(o_orderdate::DATE) FILTER (o_orderkey % 9 <> 0) AS last_date, "
                       "count(*) FILTER (o_orderkey % 9 <> 0) AS valid_dates, round(count(*) FILTER (o_orderkey % 9 <> 0) / count(*), 6) AS valid_share FROM orders"),
    "column_overlap": (_overlap, OVERLAP),
    "common_columns": (_common, "SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS non_null_count FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey) FROM orders"),
    "stage_flow": (_stage_flow, STAGE_FLOW),
    "outcome_shares": (_outcomes, "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus <> 'F') AS failed, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS success_share FROM orders"),
    "usage_by_model": (_usage, _usage_query("model")),
    "usage_by_role": (_usage_default, _usage_query("role")),
    "tool_calls": (lambda s, d: us.tool_calls(conversation_log(s, d)), "SELECT (['Bash', 'Read', 'Grep'])[conv_id % 3 + 1] AS tool, count(*) AS calls FROM conversations WHERE role = 'assistant' AND turn % 2 = 1 GROUP BY 1"),
    "conversation_summary": (lambda s, d: us.conversation_summary(conversation_log(s, d)), "SELECT count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) FILTER (role = 'user' AND conv_id % 5 = 0) AS errors, "
                             "coalesce(max(conv_id / 10) FILTER (role = 'system'), 0) AS total_cost, coalesce(max(conv_id) FILTER (role = 'system'), 0) AS turns FROM conversations"),
    "error_previews": (lambda s, d: us.error_previews(conversation_log(s, d)), "SELECT replace(left(trim(text), 200), chr(10), ' ') AS preview FROM conversations WHERE role = 'user' AND conv_id % 5 = 0"),
    "failed_checks": (_checks, CHECKS),
    "event_list_scores": (_event_scores, EVENT_SCORES),
    "scoped_view": (_scoped, "SELECT c_custkey, c_mktsegment AS state, c_nationkey::VARCHAR AS city FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey IN (3, 7)"),
    "matchability_counts": (_split_counts, f"WITH {v.candidates_sql()} SELECT CASE WHEN state IS NULL THEN 'Questionable' WHEN candidate_office = '' THEN 'Unmatchable' ELSE 'Matchable' END AS category, count(*) AS n FROM raw_candidates GROUP BY 1"),
    "unfinished_rows": (_unfinished, "SELECT o_custkey, count(*) AS todo FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1"),
    "demographic_messages": (_demographics, DEMOGRAPHICS),
    "poll_records": (_poll_records, POLL_RECORDS),
}
