import datetime as dt

import pytest
from pyspark.sql import functions as F

from plenum.functions import fixed
from plenum.sources import readers as rd
from plenum.sources import writers as wr


def message_file(path, texts):
    header = ",".join(f'"{h}"' for h in fixed.MESSAGE_HEADERS)
    lines = [header]
    for t in texts:
        row = {h: "x" for h in fixed.MESSAGE_HEADERS} | {"Message Text": t.replace('"', '""'), "Is Automatic Reply?": "true", "Carrier": ""}
        lines.append(",".join(f'"{row[h]}"' for h in fixed.MESSAGE_HEADERS))
    path.write_text("\n".join(lines) + "\n")


def test_messages_carry_file_and_line(spark, tmp_path):
    message_file(tmp_path / "a.csv", ["one", 'two "q",\nline', "three"])
    message_file(tmp_path / "b.csv", ["four"])
    rows = rd.read_messages(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    got = sorted((r.source_file, r.source_row, r.message_text) for r in rows)
    assert got == [("a.csv", 2, "one"), ("a.csv", 3, 'two "q",\nline'), ("a.csv", 4, "three"), ("b.csv", 2, "four")]
    assert all(r.is_automatic_reply for r in rows)


def test_rows_of_a_split_file_are_numbered_through(spark, tmp_path):
    message_file(tmp_path / "a.csv", [f"m{i}" for i in range(300)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = rd.read_messages(spark, str(tmp_path / "a.csv"), multi_line=False)
        assert df.rdd.getNumPartitions() > 1
        assert sorted((r.source_row, r.message_text) for r in df.collect()) == [(i + 2, f"m{i}") for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_consolidation(spark, tmp_path):
    (tmp_path / "north_1.csv").write_text("Phone,body,Sent At\n555,hello there,2024-01-02T03:04:05.000Z\n,no phone,\n")
    (tmp_path / "north_2.csv").write_text("Contact Phone Number,Message Text,poll_id\n777,hi,own\n")
    (tmp_path / "north_3.csv").write_text("phone_number,message_text\n")
    (tmp_path / "north_4.csv").write_text("")
    (tmp_path / "south.csv").write_text("phone_number,message_text\n1,a\n")
    rows, files = rd.consolidate_polls(spark, str(tmp_path), "North")
    assert sorted(r.stem for r in files.collect()) == ["north_1", "north_2", "north_3", "north_4"]
    out = rd.poll_records(rows, "North", F.lit(dt.datetime(2030, 1, 1))).orderBy("phone_number").collect()
    assert [(r.phone_number, r.poll_id, r.round) for r in out] == [("555", "north_1", "R1"), ("777", "own", "R1")]
    assert out[0].sent_at == dt.datetime(2024, 1, 2, 3, 4, 5) and out[1].sent_at == dt.datetime(2030, 1, 1)
    with pytest.raises(ValueError):
        rd.consolidate_polls(spark, str(tmp_path), "east")


def test_alias_follows_file_order(spark):
    df = spark.createDataFrame([("b", "m")], "body string, message string")
    assert rd.normalise_columns(df).first().message_text == "b"


def test_text_column_needs_a_value(spark):
    df = spark.createDataFrame([(None, "x", 1)], "text string, my_message string, n int")
    assert rd.find_text_column(df) == "my_message"
    assert rd.find_text_column(df.select("n")) is None


def test_sheet_layouts(spark):
    df = spark.createDataFrame([("1", "45231", "General", "CA x")], "a string, b string, c string, d string")
    assert rd.sheet_range(df).first().race_name_with_state == "CA x"
    with pytest.raises(ValueError):
        rd.sheet_range(df.select("a"))


def test_slugs(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" a-b \n\n c\n")
    assert [r.slug for r in rd.read_slugs(spark, str(tmp_path / "s.txt")).collect()] == ["a-b", "c"]


def test_sources_by_name(spark, tmp_path):
    for n in ("josh_1.csv", "ann.csv", "note.txt"):
        (tmp_path / n).write_text("x\n")
    files = rd.list_files(spark, str(tmp_path))
    names = lambda df: sorted(r.file_name for r in df.collect())
    assert names(rd.select_sources(files, "all")) == ["ann.csv", "josh_1.csv"]
    assert names(rd.select_sources(files, "JOSH")) == ["josh_1.csv"]
    assert names(rd.select_sources(files, "x", {"x": ["ann.csv"]})) == ["ann.csv"]


def test_snapshots_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb")], "id int, t string")
    stamped, latest = wr.write_snapshot(df, str(tmp_path), "x", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert stamped.endswith("x_20240102_030405") and spark.read.parquet(latest).count() == 1
    for fmt in ("csv", "tsv", "json", "parquet"):
        wr.write_table(df, str(tmp_path / fmt), fmt)
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv"))
    assert back.first().t == "a\tb"
    built = []
    for _ in range(2):
        assert rd.snapshot(spark, str(tmp_path / "snap"), lambda: built.append(1) or df).count() == 1
    assert built == [1]


def test_states_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("CA", 1), ("TX", 2)], "state string, id int")
    wr.write_states(df.where("state = 'CA'"), str(tmp_path / "s"))
    wr.write_states(df.withColumn("id", F.col("id") + 10), str(tmp_path / "s"))
    assert sorted((r.state, r.id) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("CA", 1), ("TX", 12)]


def test_resume_computes_only_what_is_missing(spark, tmp_path):
    df = spark.range(10)
    seen = []

    def compute(todo):
        seen.append(todo.count())
        return todo.withColumn("result", F.when(F.lit(True), F.lit("ok")))

    wr.resume(df, str(tmp_path / "r"), "id", "result", compute, index="id", stop=4)
    out = wr.resume(df, str(tmp_path / "r"), "id", "result", compute)
    assert sum(seen[:10]) == 4 and sum(seen) == 10 and out.count() == out.distinct().count() == 10


def test_a_lost_run_keeps_its_slices(spark, tmp_path):
    df, folder, done = spark.range(100), str(tmp_path / "lost"), []

    def compute(todo):
        if len(done) == 3 and not lost.get("again"):
            raise RuntimeError("executor lost")
        done.append(todo.count())
        return todo.withColumn("result", F.lit("ok"))

    lost = {}
    with pytest.raises(RuntimeError):
        wr.resume(df, folder, "id", "result", compute, slices=5)
    kept = spark.read.parquet(folder).count()
    # a run that ends before its job is committed leaves files without a success mark
    (tmp_path / "lost" / "_SUCCESS").unlink()
    lost["again"] = True
    out = wr.resume(df, folder, "id", "result", compute, slices=5)
    assert kept == sum(done[:3]) > 0 and sum(done) == 100 and out.count() == out.select("id").distinct().count() == 100


def test_split_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "accepted"), (2, "rejected")], "id int, category string")
    wr.write_split(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c" / "category=accepted")).first().id == 1


def test_samples_do_not_depend_on_partitions(spark):
    a = rd.load_rows(spark.range(1000).withColumn("state", F.lit("CA")), ["CA"], sample_fraction=0.3, limit=50)
    b = rd.load_rows(spark.range(1000).repartition(7).withColumn("state", F.lit("CA")), ["CA"], sample_fraction=0.3, limit=50)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())


def test_catalog_helpers(spark):
    df = spark.range(3)
    df.createOrReplaceTempView("numbers")
    assert "numbers" in rd.list_tables(spark) and rd.describe(df).first().data_type == "bigint"
    assert rd.table_count(df) == 3 and rd.table_sample(df, 2).count() == 2
    assert [r.id for r in rd.extract_table(spark, "numbers", "id").collect()] == [2, 1, 0]


def test_resume_reads_its_input_once(spark, tmp_path):
    """Rows pass a counting column once, whatever the number of slices; null and repeated keys stay."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x

    rows = [(i,) for i in range(50)] + [(7,), (None,)]
    df = spark.createDataFrame(rows, "id long").select("id", counted("id").alias("seen"))
    out = wr.resume(df, str(tmp_path / "once"), "id", "result", lambda part: part.withColumn("result", F.lit("done")))
    assert read.value == len(rows) and sorted(r.id for r in out.where("id is not null").collect()) == sorted([*range(50), 7])
    assert out.columns == ["id", "seen", "result"] and out.count() == len(rows)
    again = wr.resume(df.where("id is not null"), str(tmp_path / "once"), "id", "result", lambda part: part.withColumn("result", F.lit("again")))
    assert again.where("result = 'again'").count() == 0 and again.count() == len(rows)
    empty = wr.resume(df.limit(0), str(tmp_path / "none"), "id", "result", lambda part: part.withColumn("result", F.lit("x")))
    assert empty.count() == 0
