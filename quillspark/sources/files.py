"""JSON maps, JSON lines, the event log, and evaluation cases."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import strip
from ..functions.text import clean_log_field

# Fixed value: the form of a log line.
LOG_LINE = r"^## \[(\d{4}-\d{2}-\d{2})\] (\w[\w-]*) \| (.*?) \| (.*)$"
# The kinds of event the log knows.
LOG_KINDS = ("capture", "digest", "proposal", "applied", "archive", "index")

CASES_SCHEMA = (
    "id string, query string, topic string, stratum string, expectedNotes array<string>, "
    "expectedBrief string, negative boolean"
)
TASKS_SCHEMA = (
    "id string, question string, gold string, sources array<string>, stratum string, "
    "negative boolean, notes string, draft boolean"
)


def read_keyword_map(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, path) from a flat JSON object; anything else gives no rows."""
    text = spark.read.text(path, wholetext=True)
    return keyword_map_rows(text.select(F.col("value")))


def keyword_map_rows(raw: DataFrame) -> DataFrame:
    flat = F.from_json(F.col("value"), "map<string,string>")
    is_object = F.rlike("value", F.lit(r"(?s)\A\s*\{.*\}\s*\z"))
    return (
        raw.where(is_object)
        .select(F.explode(flat).alias("k", "path"))
        .select(strip(F.lower("k")).alias("keyword"), "path")
        .where(F.col("path").isNotNull() & (strip("path") != ""))
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, v VARIANT); blank and broken lines are dropped."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")
    )
    return parse_jsonl(raw)


def parse_jsonl(raw: DataFrame) -> DataFrame:
    return raw.where(strip("line") != "").withColumn("v", F.try_parse_json("line")).where(
        F.col("v").isNotNull()
    )


def read_cases(spark: SparkSession, path: str, schema: str = CASES_SCHEMA) -> DataFrame:
    """Evaluation cases; a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


# --- event log ------------------------------------------------------------------------


def parse_log(lines: DataFrame) -> DataFrame:
    """(seq, line) to typed events; lines outside the grammar are left out.

    ``seq`` is any value that sorts in the order of the log.
    """
    ok = lines.where(F.rlike("line", F.lit(LOG_LINE)))
    part = lambda i: F.regexp_extract("line", LOG_LINE, i)
    return ok.select(
        "seq",
        part(1).cast("date").alias("date"),
        part(2).alias("kind"),
        strip(part(3)).alias("title"),
        strip(part(4)).alias("path"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log file, or of a folder of appended ones, in the order they were written.

    Read line by line and split over tasks like any text. ``seq`` is (file, start of the split, line in the task): append
    names its files so that later ones sort behind earlier ones, and ids within a task rise.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    return parse_log(lines)


def log_tail(events: DataFrame, last: int | None = None, kind: str | None = None) -> DataFrame:
    """The newest ``last`` events, in file order."""
    if kind is not None:
        events = events.where(F.col("kind") == kind)
    if last is not None:
        events = events.orderBy(F.col("seq").desc()).limit(last)
    return events.orderBy("seq")


def format_log_line(date: Column, kind: Column, title: Column, path: Column) -> Column:
    return F.concat(
        F.lit("## ["),
        F.date_format(date, "yyyy-MM-dd"),
        F.lit("] "),
        kind,
        F.lit(" | "),
        clean_log_field(title),
        F.lit(" | "),
        clean_log_field(path),
    )


def log_lines(events: DataFrame) -> DataFrame:
    return events.select(
        format_log_line(F.col("date"), F.col("kind"), F.col("title"), F.col("path")).alias("value")
    )


LOG_HEADER = "# Log"


def append_log(events: DataFrame, path: str) -> None:
    """Add one line per event; earlier lines are never rewritten.

    Each append is a folder named by its time in nanoseconds, so folders sort in the order of appends; events of
    one append keep the order of the DataFrame's partitions, whose files sort by their number. The first append
    writes a header.
    """
    spark = events.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    new = not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if new:
        spark.range(1).select(F.lit(f"{LOG_HEADER}\n").alias("value")).write.text(f"{path}/append={0:020d}")
    log_lines(events).write.text(f"{path}/append={time.time_ns():020d}")


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Recall decisions, one JSON object per prompt."""
    decisions.write.mode("append").json(path)


def write_eval_results(results: DataFrame, path: str) -> None:
    """Partitioned by run date and mode, so runs of different modes do not overwrite each other."""
    results.write.mode("append").partitionBy("run_date", "mode").parquet(path)
