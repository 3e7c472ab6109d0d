"""Session notes from chat transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.base import strip
from ..functions.redact import redact_secrets

MIN_MESSAGES = 6
MAX_TOPICS, MAX_COMMANDS = 20, 30
# Commands that only look.
READ_ONLY = ("ls ", "cat ", "head ", "tail ", "grep ", "find ", "echo ", "wc ", "file ", "which ")


def parse_lines(transcript: DataFrame) -> DataFrame:
    """(session_id, cwd, pos, type, ai_title, ts, said, blocks); broken lines are dropped.

    ``said`` is set when the content is plain text, ``blocks`` when it is a list.
    """
    v = F.col("v")
    get = lambda path, t: F.try_variant_get(v, path, t)
    content = get("$.message.content", "variant")
    is_text = F.schema_of_variant(content) == "STRING"
    return (
        transcript.withColumn("v", F.try_parse_json("line"))
        .where(F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
        .select(
            "session_id",
            "cwd",
            "pos",
            get("$.type", "string").alias("type"),
            F.when(get("$.type", "string") == "ai-title", F.coalesce(get("$.aiTitle", "string"), F.lit(""))).alias(
                "ai_title"
            ),
            dates.parse_ts(get("$.timestamp", "string")).alias("ts"),
            F.when(is_text, get("$.message.content", "string")).alias("said"),
            F.when(~is_text, get("$.message.content", "array<variant>")).alias("blocks"),
        )
    )


def tool_calls(lines: DataFrame) -> DataFrame:
    """(session_id, pos, ix, name, file_path, command) of assistant tool calls."""
    b = F.col("b")
    return (
        lines.where(F.col("type") == "assistant")
        .select("session_id", "pos", F.posexplode("blocks").alias("ix", "b"))
        .where(F.try_variant_get(b, "$.type", "string") == "tool_use")
        .select(
            "session_id",
            "pos",
            "ix",
            F.try_variant_get(b, "$.name", "string").alias("name"),
            F.try_variant_get(b, "$.input.file_path", "string").alias("file_path"),
            F.try_variant_get(b, "$.input.command", "string").alias("command"),
        )
        .where(F.coalesce("name", F.lit("")) != "")
    )


def _writes(blocks: Column) -> Column:
    return F.size(
        F.filter(
            F.coalesce(blocks, F.array().cast("array<variant>")),
            lambda b: (F.try_variant_get(b, "$.type", "string") == "tool_use")
            & F.try_variant_get(b, "$.name", "string").isin("Edit", "Write"),
        )
    )


def partial_facts(lines: DataFrame) -> DataFrame:
    """One row per session of these lines: counts, first timestamp, title candidates.

    Everything is a count or a minimum, so a session of any length is combined before the
    shuffle, and rows from several batches can be merged in any order.
    """
    clean = text.strip_markup("said")
    step = lines.withColumn(
        "first_text",
        F.when((F.col("type") == "user") & (F.length(clean) > 10), F.substring(clean, 1, 200)),
    )
    earliest = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("v"))))
    n_writes = F.when(F.col("type") == "assistant", _writes(F.col("blocks"))).otherwise(0)
    return step.groupBy("session_id").agg(
        F.min("cwd").alias("cwd"),
        F.count_if(F.col("type").isin("user", "assistant")).alias("n_messages"),
        F.sum(n_writes).alias("n_writes"),
        F.min("ts").alias("first_ts"),
        earliest("ai_title").alias("ai_title"),
        earliest("first_text").alias("first_message"),
    )


def merge_facts(partials: DataFrame, min_messages: int = MIN_MESSAGES) -> DataFrame:
    """Sessions worth keeping, from partial rows: enough messages, or something was written."""
    return (
        partials.groupBy("session_id")
        .agg(
            F.min("cwd").alias("cwd"),
            F.sum("n_messages").alias("n_messages"),
            F.sum("n_writes").alias("n_writes"),
            F.min("first_ts").alias("first_ts"),
            F.min("ai_title")["v"].alias("ai_title"),
            F.min("first_message")["v"].alias("first_message"),
        )
        .where((F.col("n_messages") >= min_messages) | (F.col("n_writes") > 0))
    )


def session_facts(lines: DataFrame, min_messages: int = MIN_MESSAGES) -> DataFrame:
    """One row per session worth keeping. Both levels share one shuffle."""
    return merge_facts(partial_facts(lines), min_messages)


def session_title() -> Column:
    """AI title, else the first message, else the short session id; redacted."""
    return redact_secrets(
        F.coalesce(
            F.nullif(F.col("ai_title"), F.lit("")),
            F.concat(F.lit("Session: "), F.substring("first_message", 1, 80)),
            F.concat(F.lit("Session: "), F.substring("session_id", 1, 8)),
        )
    )


def _first_n(rows: DataFrame, value: str, n: int | None, name: str) -> DataFrame:
    """Per session the values in order of ``at``; the window keeps n rows per task before the shuffle."""
    if n is not None:
        w = Window.partitionBy("session_id").orderBy("at", value)
        rows = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return rows.groupBy("session_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))), lambda x: x["v"]
        ).alias(name)
    )


def topic_rows(lines: DataFrame) -> DataFrame:
    """(session_id, at, v): user messages with something to say; ids alone say nothing."""
    clean = text.strip_markup("said")
    return (
        lines.where((F.col("type") == "user") & F.col("said").isNotNull())
        .select("session_id", F.struct(F.col("pos"), F.lit(0).alias("ix")).alias("at"), clean.alias("v"))
        .where((F.length("v") > 10) & ~F.rlike("v", F.lit(r"\A(?i)[a-f0-9-]{20,}\z")))
        .withColumn("v", text.cut("v", 100))
    )


def file_rows(calls: DataFrame) -> DataFrame:
    """(session_id, at, v): edited files, each at its first touch."""
    edited = calls.where(
        F.col("name").isin("Edit", "Write") & (F.coalesce("file_path", F.lit("")) != "")
    )
    return first_seen(edited.select("session_id", F.struct("pos", "ix").alias("at"), F.col("file_path").alias("v")))


def command_rows(calls: DataFrame) -> DataFrame:
    """(session_id, at, v): shell commands that do more than look, each at its first use."""
    head = F.ltrim(F.col("command"), F.lit(" \t\n\r\x0b\f"))
    looks = F.lit(False)
    for prefix in READ_ONLY:
        looks = looks | F.startswith(head, F.lit(prefix))
    run = calls.where((F.col("name") == "Bash") & (F.coalesce("command", F.lit("")) != "") & ~looks)
    return first_seen(run.select("session_id", F.struct("pos", "ix").alias("at"), text.cut("command", 100).alias("v")))


def first_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "v").agg(F.min("at").alias("at"))


def topics(lines: DataFrame) -> DataFrame:
    """(session_id, topics[]): the first twenty."""
    return _first_n(topic_rows(lines), "v", MAX_TOPICS, "topics")


def files_changed(calls: DataFrame) -> DataFrame:
    """(session_id, files[]): all of them, in order of first touch."""
    return _first_n(file_rows(calls), "v", None, "files")


def commands(calls: DataFrame) -> DataFrame:
    """(session_id, commands[]): the first thirty, unique."""
    return _first_n(command_rows(calls), "v", MAX_COMMANDS, "commands")


# --- where a session belongs ----------------------------------------------------------------------


def resolve_projects(cwds: DataFrame, project_map: DataFrame) -> DataFrame:
    """(cwd, slug, vault_id, matched): the nearest mapped folder on the way up, else the default.

    ``project_map``: slug, vault_id; the row ``_default`` applies when nothing on the path is
    mapped. Without either ``vault_id`` stays null and nothing is recorded.
    """
    mapped = project_map.where(F.coalesce("vault_id", F.lit("")) != "")
    fallback = mapped.where(F.col("slug") == "_default").agg(F.max("vault_id").alias("v")).scalar()
    parts = F.filter(F.split("cwd", "/"), lambda p: p != "")
    unique = cwds.select("cwd").distinct()
    steps = unique.select("cwd", F.posexplode(parts).alias("depth", "slug"))
    nearest = (
        steps.join(mapped, "slug")
        .groupBy("cwd")
        .agg(F.max(F.struct("depth", "vault_id", "slug")).alias("m"))
    )
    return unique.join(nearest, "cwd", "left").select(
        "cwd",
        F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("unknown")).alias("slug"),
        F.coalesce("m.vault_id", F.when(F.col("cwd").isNotNull(), fallback)).alias("vault_id"),
        F.col("m.slug").alias("matched"),
    )


# --- the note ----------------------------------------------------------------------------------------


def _bullets(items: Column, code: bool) -> Column:
    tick = F.lit("`" if code else "")
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), tick, i, tick)), "\n")


def _section(name: str, items: Column, code: bool) -> Column:
    return F.when(
        F.size(items) > 0, F.concat(F.lit(f"\n## {name}\n\n"), _bullets(items, code), F.lit("\n"))
    ).otherwise("")


def _yaml_text(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("''"))


def session_notes(
    transcript: DataFrame, project_map: DataFrame, existing: DataFrame, as_of: str
) -> DataFrame:
    """One note per captured session, new or updated in place.

    ``existing``: path, created of session notes already stored, archive included. A resumed session
    keeps the path and ``created`` of the note it has. Columns: session_id, vault_id, path, title,
    created, is_new, raw (the redacted note text).
    """
    lines = parse_lines(transcript)
    calls = tool_calls(lines)
    parts = (topics(lines), files_changed(calls), commands(calls))
    return build_notes(session_facts(lines), *parts, project_map, existing, as_of)


def build_notes(
    facts: DataFrame,
    topic_lists: DataFrame,
    file_lists: DataFrame,
    command_lists: DataFrame,
    project_map: DataFrame,
    existing: DataFrame,
    as_of: str,
) -> DataFrame:
    """The note rows from session facts and their lists; see ``session_notes``."""
    facts = facts.withColumn("title", session_title())
    homes = resolve_projects(facts, project_map).select("cwd", "slug", "vault_id")
    empty = F.array().cast("array<string>")
    known = (
        existing.where(F.startswith("path", F.lit("sessions/")))
        .select(text.basename("path").alias("file"), F.struct("path", "created").alias("old"))
        .groupBy("file")
        .agg(F.min("old").alias("old"))
    )
    now = dates.clock(as_of)
    rows = (
        facts.join(homes, "cwd")
        .where(F.col("vault_id").isNotNull())
        .withColumn("file", F.concat("slug", F.lit("-"), F.substring("session_id", 1, 8), F.lit(".md")))
        .join(known, "file", "left")
        .join(topic_lists, "session_id", "left")
        .join(file_lists, "session_id", "left")
        .join(command_lists, "session_id", "left")
        .select(
            "session_id",
            "vault_id",
            "cwd",
            "slug",
            "title",
            F.coalesce(
                "old.path", F.concat(F.lit("sessions/"), F.date_format(now, "yyyy/MM-dd/"), "file")
            ).alias("path"),
            F.coalesce(
                F.nullif(F.col("old.created"), F.lit("")), dates.iso_text("first_ts"), dates.iso_text(now)
            ).alias("created"),
            F.col("old").isNull().alias("is_new"),
            F.coalesce("topics", empty).alias("topics"),
            F.coalesce("files", empty).alias("files"),
            F.coalesce("commands", empty).alias("commands"),
        )
    )
    q = lambda c: F.concat(F.lit("'"), _yaml_text(c), F.lit("'"))
    raw = F.concat(
        F.lit("---\ntitle: "),
        q(F.col("title")),
        F.lit("\ntags:\n  - type/session\n  - project/"),
        text.project_slug("slug"),
        F.lit("\ncreated: "),
        q(F.col("created")),
        F.lit("\nupdated: "),
        q(dates.iso_text(now)),
        F.lit("\nsession_id: "),
        q(F.col("session_id")),
        F.lit("\nproject: "),
        q(F.col("slug")),
        F.lit("\ncwd: "),
        q(F.col("cwd")),
        F.lit("\n---\n\n# "),
        F.col("title"),
        F.lit("\n"),
        _section("Topics", F.col("topics"), False),
        _section("Files Changed", F.col("files"), True),
        _section("Commands", F.col("commands"), True),
    )
    return rows.select(
        "session_id", "vault_id", "path", "title", "created", "is_new", redact_secrets(raw).alias("raw")
    )


def capture_log(captured: DataFrame, as_of: str) -> DataFrame:
    """One event per session captured for the first time."""
    return captured.where("is_new").select(
        dates.clock(as_of).cast("date").alias("date"),
        F.lit("capture").alias("kind"),
        "title",
        "path",
    )


def read_created(raw: Column) -> Column:
    """``created:`` out of the head of a stored note; null when absent."""
    head = F.substring(raw, 1, 2000)
    return F.nullif(
        strip(F.regexp_extract(head, r"(?m)^created:\s*'?([^'\n]+)'?\s*$", 1)), F.lit("")
    )
