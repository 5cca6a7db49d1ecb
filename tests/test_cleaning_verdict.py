from pyspark.sql import functions as F

from plenum.operators import messages


def test_texts_of_duplicates_are_not_cleaned(spark, monkeypatch):
    monkeypatch.setattr(messages.tx, "clean_text", lambda c: F.when(c == "again", F.raise_error(F.lit("cleaned"))).otherwise(F.trim(c)))
    rows = [(1, "again", True), (2, " the bus stop on my street is dirty ", False), (3, None, False)]
    df = spark.createDataFrame(rows, "id int, text string, seen boolean")
    got = {r["id"]: (r["removal_reason"], r["cleaned_text"]) for r in messages.cleaning_verdict(df, "text", F.col("seen")).collect()}
    assert got == {1: ("duplicate", None), 2: ("kept", "the bus stop on my street is dirty"), 3: ("empty_message", None)}
