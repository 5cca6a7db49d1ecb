import pytest
from pyspark.sql import functions as F

from plenum.operators import insights as ins
from plenum.operators import polls as pl
from plenum.operators import rules

ISSUE = "array<struct<primary_category:string,secondary_category:string,stance:string,specific_concern:string,is_root_cause:boolean>>"


def classified(spark):
    i = lambda stance: ("housing", "taxes", stance, "c", False)
    rows = [(1, "(1) 555-000-1111", "m1", [i("positive")]), (2, "5550001111", "m2", [i("negative")]), (3, "5550002222", "m3", [i("requesting")]), (4, "", "m4", [i("neutral")])]
    return spark.createDataFrame(rows, f"message_id int, contact_phone_number string, message_text string, issues {ISSUE}").withColumns(
        {"should_be_uncategorized": F.lit(False), "overall_sentiment": F.lit("other")})


def test_urgency_by_respondent(spark):
    r = ins.issue_insights(ins.mentions(classified(spark))).first()
    assert (r.unique_respondents, r.total_mentions, r.mentions_per_respondent) == (2, 3, 1.5)
    assert r.urgency_score == pytest.approx(37.0) and r.negative_respondents == 1 and r.positive_respondents == 0


def test_samples_come_from_different_phones(spark):
    r = ins.sample_messages(ins.mentions(classified(spark))).first()
    assert r.sample_messages == ["m1", "m3"]


def classify(spark, text, given=None, strict=False):
    df = spark.createDataFrame([(text, given)], f"message_text string, given {ISSUE}")
    return rules.classify(df, issues="given", strict_parity=strict).first()


def keys(row):
    return [f"{i.primary_category}/{i.secondary_category}" for i in row.issues]


def test_required_and_avoided(spark):
    r = classify(spark, "Property taxes!", [("government_operations", "budget_and_taxes", "negative", "x", False)])
    assert keys(r) == ["housing_and_development/taxes_and_assessments"]
    assert len(classify(spark, "truck traffic by the warehouse").issues) == 2


def test_police_rule_and_parity_flag(spark):
    police = [("public_safety", "police", "negative", "x", False)]
    assert "public_safety/police" not in keys(classify(spark, "e-bikes everywhere", police))
    assert "public_safety/police" in keys(classify(spark, "e-bikes need a ticket", police))
    assert "public_safety/police" in keys(classify(spark, "e-bikes everywhere", police, strict=True))


def test_uncategorised_has_no_issues(spark):
    r = classify(spark, "trump and the warehouse")
    assert r.uncategorized_reason == "federal/national political issue" and r.issues == [] and r.overall_sentiment == "other"


def test_business_permit(spark):
    r = classify(spark, "business permit trouble", [("economic_development", "jobs_and_business", "requesting", "x", False)])
    assert keys(r)[-1] == "housing_and_development/zoning_and_permits" and r.issues[-1].is_root_cause


def record(i, poll, phone, cluster, opt=False):
    data = None if opt else {"15": (cluster, f"t{cluster}", f"s{i}", "a", [("q", phone)])}
    return (i, poll, phone, opt, data)


SCHEMA = "atomic_id int, poll_id string, phone_number string, is_opt_out boolean, multi_cluster_data map<string,struct<cluster_id:int,cluster_theme:string,issues_summary:string,detailed_analysis:string,quotes:array<struct<quote:string,phone_number:string>>>>"


def test_poll_completion(spark):
    rows = [record(1, "p", "a", 1), record(2, "p", "a", 1), record(3, "p", "b", 2), record(4, "p", "c", 2), record(5, "p", "d", 3), record(6, "p", "z", -1), record(7, "p", "o", 0, True), record(8, "q", "o", 0, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    polls = spark.createDataFrame([("p",), ("q",), ("silent",)], "poll_id string")
    got = {r.poll_id: r for r in pl.poll_completion(polls, df, minimum=1, n=2).collect()}
    assert got["p"].total_responses == 5 and got["q"].total_responses == 0 and got["silent"].total_responses == 0
    # two respondents first, then the cluster seen first
    assert [(i.rank, i.cluster_id, i.response_count) for i in got["p"].issues] == [(1, 2, 2), (2, 1, 1)]
    assert got["p"].issues[0].summary == "s3" and got["silent"].issues is None
    event = {r.poll_id: r.event for r in pl.poll_events(pl.poll_completion(polls, df)).collect()}["silent"]
    assert event == '{"type":"pollAnalysisComplete","data":{"pollId":"silent","totalResponses":0,"responsesLocation":"","issues":[]}}'


def test_fallback_when_too_few_themes_pass(spark):
    df = spark.createDataFrame([("a", 12), ("b", 11), ("c", 2)], "theme string, respondents_by_phone int")
    assert pl.enough_respondents(df).count() == 3
    assert pl.enough_respondents(df, minimum=10, at_least=2).count() == 2


def test_merged_themes_count_every_cluster_once(spark):
    t = spark.createDataFrame([(1, "one", 5, 4, ["a", "b"], ["x"]), (2, "two", 9, 9, ["b", "c"], ["x", "y"])], "cluster_id int, theme string, total_mentions int, unique_respondents int, quotes array<string>, key_topics array<string>")
    m = spark.createDataFrame([(1, 2), (2, 2)], "cluster_id int, target int")
    r = pl.merge_themes(t, m).first()
    assert (r.cluster_id, r.theme, r.total_mentions, r.unique_respondents, r.quotes, r.key_topics) == (2, "two", 14, 13, ["b", "c", "a"], ["x", "y"])


def test_wide_export_names_a_single_configuration_merged(spark):
    df = spark.createDataFrame([record(1, "p", "a", 1), record(2, "p", "b", 0, True)], SCHEMA)
    out = pl.wide_clusters(df, ["15"], {"cluster_id": "value", "quotes": "json"}).orderBy("atomic_id").collect()
    assert out[0].cluster_id_merged == 1 and out[0].quotes_merged == '[{"quote":"q","phone_number":"a"}]' and out[1].quotes_merged == ""


def test_one_message_is_one_theme(spark):
    row = pl.single_message_theme(spark.createDataFrame([("a",)], "phone string")).first()
    assert (row.cluster_id, row.total_mentions, row.respondent_coverage_pct) == (0, 1, 100.0)
