"""Streaming forms give what the batch forms give."""

import random

from pyspark.sql import functions as F

from plenum.operators import messages as ms
from plenum.operators.polls import poll_completion
from plenum.streaming import messages as st
from tests.test_insights_and_polls import SCHEMA as POLL_SCHEMA
from tests.test_insights_and_polls import record

SCHEMA = "phone string, source_row bigint, text string"
ROWS = [("1", 1, "a b c d e f g h i j"), ("1", 2, "a b c d e f g h i j k"), ("1", 3, "A b c d e f g h i j"), ("1", 4, "new text here"), ("2", 5, "a b c"), ("2", 6, "a b c")]


def write(folder, name, rows):
    lines = ["phone,source_row,text"] + [f"{p},{r},{t}" for p, r, t in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_duplicates_batch_equals_stream(spark, tmp_path):
    write(tmp_path, "a.csv", ROWS[:3])
    write(tmp_path, "b.csv", ROWS[3:])
    (tmp_path / "ignored.txt").write_text("x")
    out = []

    def keep(batch, _):
        out.extend(batch.collect())

    stream = st.arriving_files(spark, str(tmp_path), SCHEMA, max_files=1)
    query = st.duplicate_verdicts(stream, "phone", "text").writeStream.outputMode("append").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = {(r.source_file, r.source_row): r.verdict for r in out}
    df = spark.createDataFrame([("a.csv" if i < 3 else "b.csv", *r) for i, r in enumerate(ROWS)], f"source_file string, {SCHEMA}")
    flagged = ms.exact_duplicates(df, "phone", "text", "source_file", "source_row")
    near = ms.near_duplicates(flagged.where(~F.col("is_exact_duplicate")), "phone", "text", "source_file", "source_row")
    joined = flagged.join(near, ["source_file", "source_row"], "left")
    verdict = F.when(F.col("is_exact_duplicate"), "duplicate").when(F.col("is_near_duplicate"), "near_duplicate").otherwise("new")
    batch = {(r.source_file, r.source_row): r.v for r in joined.withColumn("v", verdict).collect()}
    assert streamed == batch and set(batch.values()) == {"new", "duplicate", "near_duplicate"}


def test_each_file_runs_once(spark, tmp_path):
    write(tmp_path, "a.csv", ROWS[:2])
    counts = []

    def run():
        query = st.run_per_arrival(st.arriving_files(spark, str(tmp_path), SCHEMA), lambda b, _: counts.append(b.count()), str(tmp_path / "ck2"))
        query.awaitTermination(60)

    run()
    write(tmp_path, "b.csv", ROWS[2:])
    run()
    run()
    assert counts == [2, 4]


def test_a_poll_in_two_batches_ends_complete(spark, tmp_path):
    """The second batch sees the records of the first."""
    rows = [record(1, "p", "a", 1), record(2, "p", "b", 2), record(3, "p", "c", 2), record(4, "q", "d", 1), record(5, "p", "d", 3), record(6, "p", "e", 1), record(7, "p", "f", 1)]
    polls, source, out = spark.createDataFrame([("p",), ("q",), ("silent",)], "poll_id string"), str(tmp_path / "in"), []
    whole = spark.createDataFrame(rows, POLL_SCHEMA)
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, POLL_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(whole.schema).parquet(source)
        st.complete_polls(stream, polls, lambda df, _: out.append({r.poll_id: r for r in df.collect()}), str(tmp_path / "ck3")).awaitTermination(120)
    want = {r.poll_id: r for r in poll_completion(polls, whole, 1, 3).collect()}
    assert [sorted(batch) for batch in out] == [["p", "q"], ["p"]]
    assert out[1]["p"] == want["p"] and out[0]["q"] == want["q"] and out[0]["p"] != want["p"]


def test_poll_state_equals_the_batch_over_all_records(spark, tmp_path):
    """Two batches in any order: other configurations, noise, opt-outs, repeated and missing phones, records without clusters."""
    rng, rows = random.Random(8), []
    for i in rng.sample(range(1000), 80):
        phone = rng.choice(["a", "b", "c", "d", None])
        data = {k: (rng.choice([-1, 1, 2, 3, 4]), f"theme {i}{k}", None, "a", [("q", phone)]) for k in rng.sample(["x", "y"], rng.choice([0, 1, 2]))}
        rows.append((i, rng.choice("pqr"), phone, rng.choice([True, False, False, None]), rng.choice([None, data, data, data])))
    polls, source, out = spark.createDataFrame([("p",), ("q",), ("silent",)], "poll_id string"), str(tmp_path / "in"), {}
    for part in range(2):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], POLL_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(POLL_SCHEMA).parquet(source)
        st.complete_polls(stream, polls, lambda df, _: out.update({r.poll_id: r for r in df.collect()}), str(tmp_path / "ck4")).awaitTermination(120)
        so_far = poll_completion(polls, spark.read.parquet(source), 1, 3).where("poll_id <> 'silent'").collect()
        assert {r.poll_id: r for r in so_far} == out
    assert sorted(out) == ["p", "q"] and all(len(r.issues) == 3 for r in out.values())
