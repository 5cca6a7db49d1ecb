import datetime as dt

from pyspark.sql import functions as F

from plenum.functions import dates as dts
from plenum.functions import names as nm
from plenum.operators import records as rc


def values(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_names(spark):
    got = values(spark, nm.clean_name, "o'CONNOR", "O'CONNOR", "smith-jones", "ann", "J", "V", "R2D2", "x" * 51, "  Mary   Ann.", None, "nan")
    assert got == ["o'CONNOR", "O'Connor", "Smith-Jones", "ann", None, "V", None, None, "Mary Ann", None, None]


def test_title_case_equals_python(spark):
    texts = ["o'connor", "smith-jones", "élodie d'arc", "mcdonald", "a1b c"]
    assert values(spark, nm.title_case, *texts) == [t.title() for t in texts]


def test_levels_are_ordered(spark):
    assert values(spark, nm.office_level, "Interstate", "State Federal", "statewide office", "County/City", "water district", "") == [
        None, "FEDERAL", "STATE", "LOCAL", None, None]


def test_election_type_order(spark):
    assert values(spark, nm.election_type, "Primary Runoff", "General Runoff", "odd") == ["primary", "runoff", "odd"]


def test_codes(spark):
    assert values(spark, nm.state_code, "tx", "New York", "Ontario", "") == ["TX", "NY", "ON", None]
    assert values(spark, nm.normalise_phone, "(1) 555-000-1111", "5550001111", None) == ["5550001111", "5550001111", ""]
    assert values(spark, dts.excel_serial_to_date, "45231", "45231.5", "x") == [dt.date(2023, 11, 1), None, None]
    assert values(spark, nm.slug, "Jo O'Neil  Jr.") == ["jo-oneil-jr"]


def test_expansion_keeps_other_dates_for_runoffs_only(spark):
    d = [dt.date(2024, 3, 5), dt.date(2024, 11, 5), dt.date(2024, 12, 3)]
    df = spark.createDataFrame([(1, *d), (2, None, d[1], None)], "id int, primary_election_date date, general_election_date date, runoff_election_date date")
    rows = {(r.id, r.election_type): r for r in rc.expand_elections(df).collect()}
    assert set(rows) == {(1, "primary"), (1, "general"), (1, "runoff"), (2, "general")}
    assert rows[(1, "primary")].general_election_date is None and rows[(1, "runoff")].primary_election_date == d[0]


def test_runoff_types_and_latest_runoff(spark):
    day = lambda m: dt.date(2024, m, 1)
    rows = [(1, "primary", day(3), 10), (1, "runoff", day(5), 11), (1, "general", day(11), 12), (2, "general", day(11), 20), (2, "runoff", day(12), 21), (2, "runoff", day(12), 22), (3, "primary", day(3), 30)]
    results = spark.createDataFrame(rows, "candidate_id bigint, election_type string, date date, race_id bigint").withColumns({"race_name": F.lit("r"), "candidate": F.lit("c")})
    kinds = {r.candidate_id: r.runoff_type for r in rc.infer_runoff_types(results).collect()}
    assert kinds == {1: "primary", 2: "general"}
    matches = spark.createDataFrame([(7, True, 2)], "candidacy_id bigint, has_match boolean, matched_candidate_id bigint")
    assert [r.runoff_race_id for r in rc.discover_runoffs(matches, results).collect()] == [21]


def test_contact_windows(spark):
    df = spark.createDataFrame([(dt.date(2025, 11, 4), dt.date(2025, 8, 1)), (dt.date(2025, 11, 4), dt.date(2025, 10, 1)), (dt.date(2025, 11, 4), dt.date(2025, 11, 3))], "e date, today date")
    got = [r.w.start_date for r in df.select(dts.opening_window("e", F.col("today")).alias("w")).collect()]
    assert got == [dt.date(2025, 9, 16), dt.date(2025, 10, 4), dt.date(2025, 11, 3)]


def test_plan_dates(spark):
    df = spark.createDataFrame([(t,) for t in ["JULY 15", "[Jul 15]", "7/15", "July 15, 2025", "later"]], "t string")
    got = [r.d for r in df.select(dts.parse_campaign_date("t", F.lit(dt.date(2025, 11, 4)), dt.date(2025, 7, 1)).alias("d")).collect()]
    assert got == [dt.date(2025, 7, 15)] * 4 + [dt.date(2025, 10, 5)]


def test_merge_runoffs_coerces_bad_dates(spark):
    a = spark.createDataFrame([(1, "N/A")], "candidacy_id bigint, election_date string")
    b = spark.createDataFrame([(2, "2024-12-03", True, 5)], "candidacy_id bigint, election_date string, is_synthetic_runoff boolean, discovered_from_candidate_id bigint")
    rows = {r.candidacy_id: r for r in rc.merge_runoffs(a, b).collect()}
    assert rows[1].election_date is None and not rows[1].is_synthetic_runoff and rows[2].is_synthetic_runoff


def test_sample_is_that_of_the_whole_order(spark):
    from pyspark.sql import functions as F

    from plenum.operators import ranking

    df = spark.range(0, 5_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x")).repartition(9)
    whole = [r["k"] for r in df.orderBy(F.md5(F.concat_ws("-", "k", F.lit(42))), "k").collect()]
    for n in (0, 1, 37, 4_999, 5_000, 9_000):
        got = {r["k"] for r in ranking.reproducible_sample(df, "k", n).collect()}
        assert got == set(whole[:n])
    assert ranking.reproducible_sample(df.limit(0), "k", 3).count() == 0
    same = spark.range(0, 300).select(F.lit(1).alias("k"), "id")
    assert ranking.reproducible_sample(same, "k", 10).count() == 10
