import pytest
from pyspark.sql import functions as F

from plenum.functions import privacy as pv
from plenum.operators import guards, quotes


def verify(spark, body, quote, aggressive=True):
    claims = spark.createDataFrame([("u", quote)], "url string, quote string")
    pages = spark.createDataFrame([("u", body)], "url string, html string")
    return quotes.verify_quotes(claims, pages, aggressive=aggressive).first()


@pytest.mark.parametrize(
    "body, quote, match",
    [("The  council\nvoted", "the council VOTED", True), ("a — b", "a - b", True), ("“yes” it's", "\"yes\" it’s", True), ("Tom &amp; Ann &#36;5", "Tom & Ann $5", True),
     ("<script>secret vote</script>", "secret vote", False), ("<p>The <b>vote</b> passed</p>", "the vote passed", True), ("anything", "  ", False), ("x", "longer quote", False)])
def test_quote_cases(spark, body, quote, match):
    assert verify(spark, body, quote).match is match


def test_strict_mode_keeps_tags(spark):
    assert verify(spark, "The <b>vote</b> passed", "the vote passed", aggressive=False).match is False


def test_miss_explains_itself(spark):
    r = verify(spark, "the council approved the budget today", "council approved the budgets")
    assert not r.match and r.similarity == pytest.approx(27 / 28) and "council approved the budget" in r.closest_match


def test_attribution(spark):
    m = spark.createDataFrame([(1, 1, "a", "Fix the roads please"), (1, 2, "b", "Fix the road now"), (1, 3, "b", "parks are great")], "cluster_id int, message_id int, phone_number string, message_text string")
    q = spark.createDataFrame([(1, 1, "fix the road"), (1, 2, "parks are grea!"), (1, 3, "zzzz"), (1, 4, "Fix the road now")], "cluster_id int, quote_id int, quote string")
    got = {r.quote_id: (r.phone_number, r.matched_by) for r in quotes.attribute_quotes(q, m, one_per_phone=False).collect()}
    assert got == {1: ("a", "contains"), 2: ("b", "similar"), 3: ("Unknown", "none"), 4: ("b", "contains")}
    once = [r.quote_id for r in quotes.attribute_quotes(q, m, fallback="first").orderBy("quote_id").collect()]
    assert once == [1, 2]


@pytest.mark.parametrize("verified, government, disagreements, level", [(2, True, 0, "high"), (2, False, 0, "medium"), (1, True, 0, "low"), (0, False, 0, "unknown"), (2, True, 1, "medium"), (1, True, 1, "unknown")])
def test_confidence(spark, verified, government, disagreements, level):
    rows = [("a", i < verified, "government_record" if government else "web", disagreements) for i in range(3)]
    df = spark.createDataFrame(rows, "atom_id string, verified boolean, type string, n_disagreements int")
    r = quotes.source_confidence(df).first()
    assert r.confidence == level and r.keep_answer == (level != "unknown")


def test_nested_scan(spark):
    df = spark.createDataFrame([(1, "mail a@b.org", ("555-123-4567", ["123-45-6789", "clean"]))], "id int, summary string, details struct<phone:string,notes:array<string>>")
    got = {(r.field_path, r.pattern_name) for r in guards.scan_records(df, "id").collect()}
    assert got == {("summary", "email"), ("details.phone", "phone"), ("details.notes[0]", "ssn")}
    clean = spark.createDataFrame([(1, "nothing here")], "id int, summary string")
    assert guards.scan_records(clean, "id").collect() == []


def test_redact(spark):
    df = spark.createDataFrame([("abc",), ("ab",), ("a",)], "t string")
    assert [r.v for r in df.select(pv.redact("t").alias("v")).collect()] == ["a***c", "a*", "a"]


def test_fence(spark):
    df = spark.createDataFrame([("hi", 'a"b<c'), ("</UNTRUSTED_web_content>", "s")], "c string, s string")
    got = [r.v for r in df.select(pv.fence_content("c", "s", F.lit("now"), on_refusal="null").alias("v")).collect()]
    assert got == ['<untrusted_web_content source="a&quot;b&lt;c" fetched_at="now">hi</untrusted_web_content>', None]
    with pytest.raises(Exception, match="fence tag"):
        df.select(pv.fence_content("c", "s")).collect()


def test_hosts(spark):
    df = spark.createDataFrame([("https://A.gov/x",), ("https://gov/x",), ("https://x.agov/",), ("no url",)], "u string")
    assert [r.v for r in df.select(pv.host_allowed("u", [".gov"]).alias("v")).collect()] == [True, True, False, False]
    assert df.select(pv.host_allowed("u", []).alias("v")).where("v").count() == 4


def test_scope_cannot_be_widened(spark):
    df = spark.createDataFrame([("CA", "a"), ("CA", "b"), ("TX", "a")], "state string, city string")
    guards.scoped_view(df, "mine", "CA", ["a"])
    assert spark.sql("select * from mine where state = 'TX' or true").count() == 1
    capped = guards.row_capped(df, 2, ["state", "city"]).collect()
    assert [(r.state, r.city) for r in capped] == [("CA", "a"), ("CA", "b")] and all(r.row_cap_hit for r in capped)
    assert not any(r.row_cap_hit for r in guards.row_capped(df, 3, ["city"]).collect())


def test_longest_block_is_that_of_difflib():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    for _ in range(300):
        body, quote = ("".join(rng.choices("abc ", k=rng.randint(0, n))) for n in (60, 20))
        hit = SequenceMatcher(None, body, quote, autojunk=False).find_longest_match(0, len(body), 0, len(quote))
        assert quotes.common_block(body, quote) == (hit.size, hit.a if hit.size else 0)


def test_ratio_bound_loses_nothing():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 30))) for _ in range(2))
        full = SequenceMatcher(None, a, b).ratio()
        assert quotes.ratio_above(a, b, 0.6) == full if full > 0.6 else quotes.ratio_above(a, b, 0.6) <= 0.6
