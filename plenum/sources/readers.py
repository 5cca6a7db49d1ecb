"""Table, message, poll, sheet and slug sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import fixed
from plenum.functions.dates import first_timestamp, repair_timestamp
from plenum.functions.text import nullif_blank, strip
from plenum.operators.ranking import reproducible_sample


def extract_table(spark: SparkSession, table: str, order_by: str | None = None) -> DataFrame:
    """All columns of a table; newest first only if a consumer asks for it."""
    df = spark.read.table(table)
    return df.orderBy(F.desc(order_by)) if order_by else df


def load_rows(
    df: DataFrame, states: list[str] | None = None, limit: int | None = None, sample_fraction: float | None = None,
    seed: int = 42, key: str = "id",
) -> DataFrame:
    """State filter (pushed to the scan), then a reproducible sample, then a limit."""
    if states:
        df = df.where(F.col("state").isin(states))
    if sample_fraction is not None:
        # a hash of the key selects the same rows under any partitioning
        digits = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key), F.lit(seed))), 1, 8), 16, 10)
        df = df.where(digits.cast("long") < round(sample_fraction * 2**32))
    if limit is not None:
        df = reproducible_sample(df, key, limit, seed)
    return df


def snapshot(spark: SparkSession, path: str, build) -> DataFrame:
    """The parquet snapshot at ``path``, built first if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


MESSAGE_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in fixed.MESSAGE_HEADERS])


def read_messages(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Message exports with source file and line (data row + 1 for the header).

    Files that cannot be read are skipped, bad rows dropped. Quoted line breaks need
    ``multi_line``, which reads a file in one task; exports without them can be split.
    """
    df = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("mode", "DROPMALFORMED").option("columnPruning", False)
        .option("ignoreCorruptFiles", True).option("enforceSchema", False)
        .schema(MESSAGE_SCHEMA).csv(paths)
    )
    renamed = df.select(
        *[F.col(f"`{h}`").alias(n) for h, n in fixed.MESSAGE_HEADERS.items()],
        F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_position"),
    )
    auto = F.coalesce(F.upper(F.col("is_automatic_reply")) == "TRUE", F.lit(False))
    return number_rows(renamed).withColumn("is_automatic_reply", auto)


def number_rows(df: DataFrame, first: int = 2) -> DataFrame:
    """Row numbers per file from the position inside its blocks.

    Blocks are counted and summed up (a row per block); no file is sorted or sent to one task.
    """
    keys = ["_path", "_block"]
    blocks = df.groupBy(*keys).agg(F.min("_position").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    number = F.col("_position") - F.col("_start") + F.col("_before") + first
    return df.join(blocks, keys).withColumn("source_row", number).drop(*keys, "_position", "_start", "_n", "_before")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Files with their size and stem, empty ones too (Spark's own sources leave those out)."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    rows = [(s.getPath().toString(), s.getPath().getName(), s.getLen()) for s in found if s.isFile()]
    files = spark.createDataFrame(rows, "path string, file_name string, size bigint")
    return files.withColumn("stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))


def select_sources(files: DataFrame, source: str, named: dict[str, list[str]] | None = None) -> DataFrame:
    """Files of a named source, all of them, or those whose name contains the text."""
    if named and source in named:
        return files.where(F.col("file_name").isin(named[source]))
    if source == "all":
        return files
    return files.where(F.lower("file_name").contains(source.lower()))


def normalise_columns(df: DataFrame, aliases: dict[str, list[str]] = fixed.POLL_ALIASES) -> DataFrame:
    """Add canonical columns from the first file column among their aliases."""
    for name, known in aliases.items():
        if name not in df.columns:
            found = next((c for c in df.columns if c in known), None)
            if found is not None:
                df = df.withColumn(name, F.col(f"`{found}`"))
    return df


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file that is not blank; no more than the start of the file is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine()
        while line is not None and not line.strip():
            line = reader.readLine()
        return line or ""
    finally:
        reader.close()


def consolidate_polls(spark: SparkSession, folder: str, campaign: str) -> tuple[DataFrame, DataFrame]:
    """All rows of a campaign's files, with the file stem as poll, and the list of its files.

    Files may have different headers: files sharing one are read together and the parts are
    united by name. Empty files have no rows but stay in the list.
    """
    files = list_files(spark, folder)
    mine = files.where(F.lower("stem").contains(campaign.lower()))
    listed = [r.asDict() for r in mine.orderBy("path").collect()]  # a row per poll file
    if not listed:
        raise ValueError(f"no csv file for campaign {campaign!r} in {folder}")
    filled = [f["path"] for f in listed if f["size"] > 0]
    parts = []
    if filled:
        by_header: dict[str, list[str]] = {}
        for path in filled:
            by_header.setdefault(_first_line(spark, path), []).append(path)
        for paths in by_header.values():
            part = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
            stem = F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", "")
            part = part.select("*", stem.alias("_stem"))
            parts.append(normalise_columns(part))
    if not parts:
        return spark.createDataFrame([], "phone_number string, message_text string, _stem string"), mine
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    lower = [c.lower() for c in rows.columns]
    if not any(c in lower for c in fixed.PHONE_HEADERS):
        raise ValueError(f"no phone number column among {rows.columns}")
    if not any(c in lower for c in fixed.TEXT_HEADERS):
        raise ValueError(f"no message text column among {rows.columns}")
    return rows, mine


def poll_records(rows: DataFrame, campaign: str, as_of: Column, stem: str = "_stem") -> DataFrame:
    """Messages with a phone and a text. Poll id: column, else file stem, else campaign."""
    def given(c: str) -> Column:
        return F.col(c) if c in rows.columns else F.lit(None).cast("string")

    phone, text = strip(F.coalesce(given("phone_number"), F.lit(""))), F.coalesce(given("message_text"), F.lit(""))
    return rows.where((phone != "") & (text != "")).select(
        phone.alias("phone_number"), text.alias("message_text"),
        F.coalesce(repair_timestamp(given("sent_at")), as_of).alias("sent_at"),
        F.coalesce(given("round"), F.lit("R1")).alias("round"), F.lit(campaign).alias("campaign_id"),
        F.coalesce(given("campaign_name"), F.lit(campaign)).alias("campaign_name"), given("carrier").alias("carrier"),
        F.coalesce(given("poll_id"), given(stem), F.lit(campaign)).alias("poll_id"),
    )


def find_text_column(df: DataFrame) -> str | None:
    """The first known text column with a value, else the first that sounds like one."""
    sounding = [c for c in df.columns if any(w in c.lower() for w in fixed.TEXT_COLUMN_WORDS)]
    candidates = list(dict.fromkeys([c for c in fixed.TEXT_COLUMNS if c in df.columns] + sounding))
    if not candidates:
        return None
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(candidates)]).first()
    return next((c for i, c in enumerate(candidates) if counts[f"c{i}"] > 0), None)


def with_metadata(df: DataFrame, text: str, output: str = "metadata") -> DataFrame:
    """Everything but the text as a map of strings, and the first timestamp that parses."""
    pairs = [x for c in df.columns if c != text for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return df.select(
        F.col(f"`{text}`").alias("original_text"), F.create_map(*pairs).alias(output), first_timestamp(df.columns).alias("timestamp"),
    )


def demographic_messages(df: DataFrame, campaign: str, row: str = "source_row") -> DataFrame:
    """Messages with voter attributes: unreadable ages are null, missing texts ``Unknown``."""
    def given(c: str) -> Column:
        return F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")

    text = strip(F.coalesce(given("Message Text"), F.lit("")))
    return df.where(text != "").select(
        F.col(row).alias("original_row_idx"), F.lit(0).alias("atomic_idx"),
        F.coalesce(given("Contact Phone Number"), F.lit("")).alias("phone_number"),
        text.alias("message_text"), text.alias("original_message_text"),
        F.coalesce(given("Campaign ID"), F.lit("")).alias("poll_id"), F.lit(campaign).alias("campaign_source"),
        given("voters_age").cast("string").try_cast("double").alias("voters_age"), given("voters_gender").alias("voters_gender"),
        *[F.coalesce(given(c), F.lit("Unknown")).alias(c) for c in fixed.DEMOGRAPHICS],
    )


def sheet_range(df: DataFrame) -> DataFrame:
    """Name the columns of a headerless range; four or six of them decide the layout."""
    if len(df.columns) == 4:
        named = df.toDF("race_id", "date", "state_election_type", "race_name_orig")
        return named.withColumn("election_type_clean", F.col("state_election_type")).withColumn(
            "race_name_with_state", F.col("race_name_orig")
        )
    if len(df.columns) == 6:
        return df.toDF("race_id_empty", "date", "state_election_type", "race_name_orig", "election_type_clean", "race_name_with_state")
    raise ValueError(f"expected 4 or 6 columns, found {len(df.columns)}")


def read_slugs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(nullif_blank("value").alias("slug")).where("slug is not null")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def list_tables(spark: SparkSession, schema: str | None = None) -> list[str]:
    return [t.name for t in spark.catalog.listTables(schema)]


def describe(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "col_name string, data_type string")


def table_count(df: DataFrame) -> int:
    return df.count()


def table_sample(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
