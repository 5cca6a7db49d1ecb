import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import text as tx
from plenum.operators import messages as ms


def values(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_clean_text(spark):
    got = values(spark, tx.clean_text, "  a \t b ", "a\n \n\nb", "x​y", "“q” ‘s’", 'to "hello"', '👍 to "hello" x', None)
    assert got == ["a b", "a\nb", "xy", "\"q\" 's'", "", "", None]


def test_clean_text_heavy(spark):
    got = values(spark, tx.clean_text_heavy, "see http://a.b/c?d=1 now", "mail a@b.c ok", "call 555-123-4567!", "wow!!! why??? so.....", "héllo ★ wörld", "😀")
    assert got == ["see now", "mail ok", "call !", "wow! why? so...", "héllo wörld", ""]


@pytest.mark.parametrize(
    "text, expected",
    [("STOP", True), ("stop it", False), ("please do stop", True), ("stop this now", True), ("Don't text me", True), ("no more texts", True), ("the stop sign", False)],
)
def test_stop(spark, text, expected):
    assert values(spark, tx.is_stop_message, text) == [expected]


def test_feedback(spark):
    assert values(spark, tx.feedback_from_stop, "Stop the warehouses please", "fix the road stop", "stop it", "hello") == [
        "the warehouses please", "fix the road", None, None]


def test_emoji_slips_past_the_cleaned_filter_but_not_the_raw_one(spark):
    assert values(spark, tx.is_opt_out, "👍", "ok", "stop ") == [False, True, True]
    assert values(spark, lambda c: tx.is_opt_out(c, on_raw=True), "👍") == [True]


def test_missing_boundary_and_its_strict_form(spark):
    texts = ["no sidewalks on main street", "his road is bad", "Thanks", "tax!", "short", "hello"]
    assert values(spark, tx.is_non_substantive, *texts) == [True, True, True, False, True, True]
    strict = values(spark, lambda c: tx.is_non_substantive(c, strict_boundary=True), *texts)
    assert strict == [False, False, True, False, True, True]


def test_anonymise(spark):
    assert values(spark, lambda c: tx.anonymise(c, {"a.b": "X$1", "élan": "E"}), "A.B axb Élan élans") == ["X$1 axb E élans"]


def test_json_repair(spark):
    schema = T.StructType.fromDDL("best_match int, reasoning string")
    got = values(spark, lambda c: tx.parse_json(c, schema), '```json\n{"best_match": 1}\n```', '{{"best_match": 2}}', '{"best_match": 3,}', '{"reasoning": "a,]"}', "none")
    assert [g and g.asDict() for g in got] == [
        {"best_match": 1, "reasoning": None}, {"best_match": 2, "reasoning": None}, {"best_match": 3, "reasoning": None},
        {"best_match": None, "reasoning": "a,]"}, None]


SMALL = [("1", 1, "STOP"), ("1", 2, "Stop the warehouses please"), ("2", 1, "Property taxes are too high!"), ("2", 2, "Property taxes are too high!"),
         ("2", 3, "property taxes are WAY too high!"), ("3", 1, "Thanks"), ("3", 2, "tax!"), ("4", 1, "   "), ("5", 1, "👍"), ("6", 1, "no sidewalks on main street")]


def test_cleaning_verdicts(spark):
    rows = [(p, f"{p}.csv", r, t) for p, r, t in SMALL]
    df = spark.createDataFrame(rows, "contact_phone_number string, source_file string, source_row int, message_text string")
    out = {(r.contact_phone_number, r.source_row): (r.removal_reason, r.cleaned_text) for r in ms.clean_messages(df).collect()}
    assert out[("1", 1)] == ("stop_message", None)
    assert out[("1", 2)] == ("kept", "the warehouses please")
    assert out[("2", 2)][0] == "duplicate" and out[("2", 3)][0] == "kept"
    assert out[("3", 1)][0] == "non_substantive" and out[("3", 2)][0] == "kept"
    assert out[("4", 1)][0] == "empty_message"
    assert out[("5", 1)][0] == "non_substantive" and out[("6", 1)][0] == "non_substantive"


def test_split_keeps_message_when_nothing_comes_out(spark):
    df = spark.createDataFrame([(1, "Fix roads. Add lights!"), (2, "STOP"), (3, "😀")], "message_id int, message_text string")
    out = ms.split_messages(ms.filter_messages(df)).orderBy("parent_message_id", "atomic_index").collect()
    assert [(r.parent_message_id, r.atomic_text, r.is_opt_out) for r in out] == [(1, "Fix roads.", False), (1, "Add lights!", False), (2, "STOP", True)]


def test_custom_splitter(spark):
    import pandas as pd

    def halves(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: t.split("/"))

    df = spark.createDataFrame([(1, "a bc/d ef gh", True)], "message_id int, filtered_text string, passed boolean")
    out = ms.split_messages(df, splitter=halves, original=None).collect()
    assert [r.atomic_text for r in out] == ["a bc", "d ef gh"]
