import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.broken_json import mend, parse_broken_json


@pytest.mark.parametrize("value", [{}, [], {"a": 1}, {"a": {"b": [1, -2.5e3, True, None, "x"]}}, [[], {}, [{}]], {"q": 'say "yes", or: {no}', "b\\": "\\ \n\t é 漢 \u0001"}, {"": ""}])
def test_json_stays_what_it_is(value):
    for text in (json.dumps(value), json.dumps(value, indent=2), json.dumps(value, ensure_ascii=False)):
        assert json.loads(mend(text)) == value
        assert json.loads(mend(f"Here you are: {text} Hope this helps {{")) == value


@pytest.mark.parametrize("text, value", [
    ('{"reasoning": "the "Ward 2" seat", "confidence": 80}', {"reasoning": "the 'Ward 2' seat", "confidence": 80}),
    ('{"reasoning": "he said "yes", then left", "n": 1}', {"reasoning": "he said 'yes', then left", "n": 1}),
    ('{"reasoning": "ends in a "quote""}', {"reasoning": "ends in a 'quote'"}),
    ('{"list": ["a "b" c", "d"]}', {"list": ["a 'b' c", "d"]}),
    ('{"a": "line\nbreak\tand \x07bell"}', {"a": "line\nbreak\tand  bell"}),
    ('{"a": [1, 2,], "b": {"c": 3,},}', {"a": [1, 2], "b": {"c": 3}}),
    ('{"a": "cut o', {"a": "cut o"}),
    ('{"a": [1, 2, {"b": "x"', {"a": [1, 2, {"b": "x"}]}),
    ('{"a": 1, "b', {"a": 1, "b": None}),
    ('{"a": 1, "b":', {"a": 1, "b": None}),
    ('{"a": 1,', {"a": 1}),
    ('{"a": tru', {"a": None}),
    ('{"a": True, "b": None}', {"a": True, "b": None}),
    ('{"a": "back \\x slash \\', {"a": "back \\x slash "}),
    ('{"a": 1 "b": 2}', {"a": 1, "b": 2}),
    ('{"a": [1, 2}', {"a": [1, 2]}),
    ('{"a": unquoted, "b": 1}', {"a": "unquoted", "b": 1}),
])
def test_mends(text, value):
    assert json.loads(mend(text)) == value


def test_no_json():
    assert mend("no brackets") is None and mend("") is None


def test_cut_texts_are_json_and_keep_what_was_whole():
    value = {"issues": [{"category": "Roads", "quotes": ["a, b", "c: {d}"]}, {"category": "Schools", "n": 12}], "tone": "angry \\ \"loud\""}
    text = json.dumps(value)
    for i in range(1, len(text)):
        got = json.loads(mend(text[:i]))
        assert isinstance(got, dict)
        if i > 70:
            assert got["issues"][0]["category"] == "Roads"


def test_any_text_gives_json_in_time():
    pick = random.Random(2)
    for _ in range(3_000):
        text = "".join(pick.choice('{}[]",:\\ ab1\n\x01tn-') for _ in range(pick.randrange(1, 60)))
        got = mend("{" + text)
        json.loads(got)
    start = time.process_time()
    for piece in ('"', '{"', '["a",', "{[", "}", ",", "\\", '{"a":', "ab ", '", "'):
        json.dumps(mend("{" + piece * (200_000 // len(piece))))
    assert time.process_time() - start < 60


def test_column(spark):
    schema = T.StructType([T.StructField("reasoning", T.StringType()), T.StructField("confidence", T.IntegerType())])
    rows = ['{"reasoning": "fine", "confidence": 1}', '```json\n{"reasoning": "a "b" c", "confidence": 2,}\n```', '{{"reasoning": "x", "confidence": 3}}', '{"reasoning": "cut, "confidence": 4', "none", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r["i"]: tuple(r["p"]) if r["p"] else None for r in df.select("i", parse_broken_json("t", schema).alias("p")).collect()}
    assert got[0] == ("fine", 1) and got[1] == ("a 'b' c", 2) and got[2] == ("x", 3)
    assert got[4] is None and got[5] is None and got[6] is None
    assert df.select(F.count(parse_broken_json("t", schema)["reasoning"])).first()[0] >= 3
