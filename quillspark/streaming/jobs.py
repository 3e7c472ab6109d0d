"""Three continuous jobs: index refresh, session capture, once-per-session suppression.

Each writes append-only folders, one per micro-batch, so a batch that is run again after a lost
driver replaces its own folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators import capture, keyword
from ..sources import notes as note_source

#: Keys of the state of what sessions have seen, over all sessions: a key costs several calls and an Arrow batch in each micro-batch.
SEEN_PARTS = 8192


def _batch_dir(root: str, table: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/{table}/batch={batch_id}"


def _write(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(_batch_dir(root, table, batch_id))


def read_batches(
    spark: SparkSession, root: str, table: str, before: int | None = None
) -> DataFrame | None:
    """Everything the batches wrote; with ``before`` only earlier batches."""
    try:
        df = spark.read.parquet(f"{root.rstrip('/')}/{table}")
    except AnalysisException:
        return None
    return df if before is None else df.where(F.col("batch") < before)


def _start(stream: DataFrame, handle, checkpoint: str, continuous: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if continuous:
        return writer.trigger(processingTime=continuous).start()
    return writer.trigger(availableNow=True).start()


# --- index refresh ---------------------------------------------------------------------------


def note_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """New note files under ``root``. A file source reads each path once: it sees neither edits
    nor deletions, for which there is ``refresh_once``."""
    reader = (
        spark.readStream.format("binaryFile")
        .option("pathGlobFilter", "*.md")
        .option("recursiveFileLookup", "true")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The schema of this source is fixed.
    return reader.schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(root)


def _write_index(raw: DataFrame, out: str, batch_id: int) -> None:
    notes = note_source.parse_notes(raw)
    versions = raw.select("path", "modified_at", "size", F.lit(False).alias("deleted"))
    _write(keyword.build_index(notes).postings, out, "postings", batch_id)
    # Written last: a version without postings would hide the note.
    _write(versions, out, "note_versions", batch_id)


def index_new_files(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    continuous: str | None = None,
) -> StreamingQuery:
    """Postings of new notes, batch by batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The same notes as a scan of the folder: no archive, no hidden names.
        files = note_source.relative(batch, root).where(
            ~F.rlike("path", F.lit(r"(^|/)\.")) & ~F.startswith("path", F.lit(note_source.ARCHIVE_PREFIX))
        )
        _write_index(note_source.decoded(files), out, batch_id)

    return _start(note_stream(spark, root, files_per_batch), handle, checkpoint, continuous)


def _newest(versions: DataFrame) -> DataFrame:
    """(path, batch, modified_at, size) of every note that still exists."""
    last = versions.groupBy("path").agg(
        F.max(F.struct("batch", "deleted", "modified_at", "size")).alias("v")
    )
    return last.where(~F.col("v.deleted")).select("path", "v.batch", "v.modified_at", "v.size")


def refresh_once(
    spark: SparkSession, root: str, out: str, batch_id: int
) -> DataFrame:
    """Bring the index up to date with the folder: listing against known versions.

    Changed files are read by one scan of the folder. Returns (path, change) of what was done.
    """
    versions = read_batches(spark, out, "note_versions", before=batch_id)
    disk = note_source.stat_notes(spark, root)
    known = disk.limit(0) if versions is None else _newest(versions).drop("batch")
    diff = keyword.snapshot_diff(known, disk).where(F.col("change") != "unchanged")
    # Kept on disk: later steps and a rerun must see the same decision.
    _write(diff, out, "changes", batch_id)
    changes = spark.read.parquet(_batch_dir(out, "changes", batch_id))

    touched = changes.where(F.col("change") != "removed").select("path")
    raw = note_source.raw_notes(spark, root).join(touched, "path", "left_semi")
    _write_index(raw, out, batch_id)
    gone = changes.where(F.col("change") == "removed").select(
        "path",
        F.lit(None).cast("timestamp").alias("modified_at"),
        F.lit(None).cast("long").alias("size"),
        F.lit(True).alias("deleted"),
    )
    gone.write.mode("append").parquet(_batch_dir(out, "note_versions", batch_id))
    return changes


def watch_folder(
    spark: SparkSession, root: str, out: str, checkpoint: str, interval: str
) -> StreamingQuery:
    """``refresh_once`` on a clock, so edits and deletions are picked up as well."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def handle(_: DataFrame, batch_id: int) -> None:
        refresh_once(spark, root, out, batch_id)

    return _start(ticks, handle, checkpoint, interval)


def live_postings(spark: SparkSession, out: str) -> DataFrame:
    """Postings of the newest version of each note that still exists."""
    newest = _newest(spark.read.parquet(f"{out.rstrip('/')}/note_versions"))
    postings = spark.read.parquet(f"{out.rstrip('/')}/postings")
    return postings.join(newest.select("path", "batch"), ["path", "batch"]).drop("batch")


# --- session capture ---------------------------------------------------------------------------


def capture_sessions(
    transcript: DataFrame, out: str, checkpoint: str, continuous: str | None = None
) -> StreamingQuery:
    """Partial session facts per micro-batch. ``transcript``: session_id, cwd, pos, line.

    Counts and minima merge in any order, so late lines and a resumed session only lower
    ``first_ts`` and extend the lists.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        lines = capture.parse_lines(batch)
        calls = capture.tool_calls(lines)
        _write(capture.partial_facts(lines), out, "facts", batch_id)
        _write(capture.topic_rows(lines), out, "topics", batch_id)
        _write(capture.file_rows(calls), out, "files", batch_id)
        _write(capture.command_rows(calls), out, "commands", batch_id)

    return _start(transcript, handle, checkpoint, continuous)


def captured_notes(
    spark: SparkSession, out: str, project_map: DataFrame, existing: DataFrame, as_of: str
) -> DataFrame:
    """Session notes from all batches so far; the same rows a batch run would give."""
    read = lambda t: spark.read.parquet(f"{out.rstrip('/')}/{t}")
    unique = lambda t: capture.first_seen(read(t))
    return capture.build_notes(
        capture.merge_facts(read("facts")),
        capture._first_n(read("topics").select("session_id", "at", "v"), "v", capture.MAX_TOPICS, "topics"),
        capture._first_n(unique("files"), "v", None, "files"),
        capture._first_n(unique("commands"), "v", capture.MAX_COMMANDS, "commands"),
        project_map,
        existing,
        as_of,
    )


# --- suppression ----------------------------------------------------------------------------------


class FirstShown(StatefulProcessor):
    """Marks the rows whose path the state had not seen in their session before this micro-batch.

    The state maps a session and path to the time the path was first shown and forgets it ``ttl_ms`` later on the clock (0: never).
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "session_id string, path string", "ts timestamp", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A path is asked for once per session and micro-batch, however many rows have it, and not at all where the key holds nothing yet.
        held = self.seen.exists()
        unseen: dict[tuple, bool] = {}
        marked = None
        for row in rows:
            marked = marked or Row(*row.__fields__, "unseen")
            of = (row["session_id"], row["path"])
            if of[1] is not None and of not in unseen:
                unseen[of] = not (held and self.seen.containsKey(of))
                if unseen[of]:
                    self.seen.updateValue(of, (row["ts"],))
            yield marked(*row, unseen.get(of, False))

    def close(self) -> None:
        pass


#: Map state needs this store, and a clock would otherwise ask for empty batches without end.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _start_stateful(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query with ``STATE_CONF``, which it keeps; the session's own settings are put back."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    try:
        for name, value in STATE_CONF.items():
            spark.conf.set(name, value)
        return start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def suppress(
    decisions: DataFrame, out: str, checkpoint: str, continuous: str | None = None, ttl_ms: int = 0
) -> StreamingQuery:
    """Decision log with ``suppressed``. ``decisions``: session_id, prompt_id, ts, method, injected and others.

    What sessions have seen is keyed state of the query, ``SEEN_PARTS`` keys by session and path: a session that
    holds a third of all prompts never sits in one task, and small sessions share a key. A micro-batch is written once with the verdicts of the state;
    the log is made from these rows alone, so nothing of earlier batches is read. Inside a batch the earliest prompt wins.
    A null or empty list of paths is never suppressed.
    """
    spark = decisions.sparkSession
    names = decisions.columns
    place = F.posexplode_outer("injected").alias("place", "path")
    # The list stays on the first row of a prompt alone.
    rows = decisions.select("*", place).select(
        *(F.when(F.coalesce("place", F.lit(0)) == 0, F.col(n)).alias(n) if n == "injected" else F.col(n) for n in names),
        "place",
        "path",
        # Prompts that show nothing have no state; they only have to be spread.
        F.pmod(F.when(F.col("path").isNull(), F.xxhash64("session_id", "prompt_id")).otherwise(F.xxhash64("session_id", "path")), F.lit(SEEN_PARTS)).alias("part"),
    )
    marked = rows.groupBy("part").transformWithState(
        FirstShown(ttl_ms), StructType([*rows.schema, StructField("unseen", BooleanType())]), "Append", "ProcessingTime" if ttl_ms else "None"
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        # One action on the stateful plan per batch.
        _write(batch, out, "shown", batch_id)
        shown = spark.read.schema(batch.schema).parquet(_batch_dir(out, "shown", batch_id))
        first = shown.where("unseen").groupBy("session_id", "path").agg(F.min(F.struct("ts", "prompt_id")).alias("first"))
        flag = first.select(
            F.col("session_id").alias("of_session"), F.col("first.prompt_id").alias("of_prompt"), F.lit(True).alias("fresh")
        ).distinct()
        prompts = shown.where(F.coalesce("place", F.lit(0)) == 0)
        same = F.col("session_id").eqNullSafe(F.col("of_session")) & F.col("prompt_id").eqNullSafe(F.col("of_prompt"))
        log = prompts.join(flag, same, "left").select(
            *names,
            (
                (F.coalesce(F.size("injected"), F.lit(0)) > 0)
                & F.col("fresh").isNull()
                & (F.coalesce("method", F.lit("")) != "direct_map")
            ).alias("suppressed"),
        )
        _write(log, out, "decisions", batch_id)

    return _start_stateful(spark, lambda: _start(marked, handle, checkpoint, continuous))


def first_shown(decisions: DataFrame, delay: str) -> DataFrame:
    """Path-level variant as one built-in operator: each (session, path) once within the delay.
    Which of several prompts of one batch stays is not fixed."""
    shown = decisions.withColumn("path", F.explode("injected"))
    return shown.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "path"])
