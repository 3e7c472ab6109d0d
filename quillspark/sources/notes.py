"""Note files in, note table out; and the note table back to files or a new version."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, markdown, text
from ..schema import LIST_KEYS, SCALAR_KEYS

ARCHIVE_PREFIX = "sessions/archive/"


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.md")
        .option("recursiveFileLookup", "true")
        .load(root)
    )


def _underscored(spark: SparkSession, root: str) -> list[tuple[str, int, int]]:
    """(path, modification time in ms, size) of notes below a name that begins with ``_``.

    Spark's file sources leave such names out, and so does their listing; the folder tree is
    walked here as Spark walks it for the others, and these few are kept.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    found = []
    walk = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    while walk.hasNext():
        status = walk.next()
        path = status.getPath().toString()
        inner = path.split(root.split("://")[-1].removeprefix("file:"), 1)[-1]
        if path.endswith(".md") and "/_" in inner:
            found.append((path, status.getModificationTime(), status.getLen()))
    return found


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content = []
        for path in batch["path"].to_pylist():
            store, inner = pa_fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
            with store.open_input_stream(inner) as f:
                content.append(f.read())
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("path", "modificationTime", "length")), pa.array(content, pa.binary())],
            names=["path", "modificationTime", "length", "content"],
        )


def list_files(
    spark: SparkSession, root: str, include_archive: bool = False, content: bool = True
) -> DataFrame:
    """Every ``*.md`` file with its relative path, names that begin with ``_`` included.

    Names that begin with ``.`` are left out. ``content`` is only read when asked for.
    """
    base = root.rstrip("/")
    names = ["path", "modificationTime", "length", *(["content"] if content else [])]
    files = _listed(spark, base).select(*names)
    if hidden := _underscored(spark, base):
        rows = spark.createDataFrame(hidden, "path string, ms long, length long").select(
            "path", F.timestamp_millis("ms").alias("modificationTime"), "length"
        )
        if content:
            # One task for some thousand files; each opens its own.
            rows = rows.repartition(1 + len(hidden) // 2000).mapInArrow(
                _opened, "path string, modificationTime timestamp, length long, content binary"
            )
        files = files.unionByName(rows)
    files = relative(files, base).where(~F.rlike("path", F.lit(r"(^|/)\.")))
    if not include_archive:
        files = files.where(~F.startswith("path", F.lit(ARCHIVE_PREFIX)))
    return files


def relative(files: DataFrame, root: str) -> DataFrame:
    """Paths as the part behind ``root``."""
    prefix = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    full = F.col("path")
    return files.withColumn(
        "path", F.substr(full, F.position(F.lit(prefix), full) + F.lit(len(prefix)))
    )


def decoded(files: DataFrame) -> DataFrame:
    """(path, modified_at, size, raw). Bytes that are not UTF-8 become U+FFFD; no file is left out."""
    return files.select(
        "path",
        F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("size"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("raw"),
    )


def stat_notes(spark: SparkSession, root: str) -> DataFrame:
    """Path, modification time and size, bodies not opened."""
    return list_files(spark, root, content=False).select(
        "path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size")
    )


def raw_notes(spark: SparkSession, root: str, include_archive: bool = False) -> DataFrame:
    return decoded(list_files(spark, root, include_archive))


def frontmatter_struct(block: Column) -> Column:
    return F.struct(
        *[markdown.yaml_scalar(block, k).alias(k) for k in SCALAR_KEYS],
        *[markdown.yaml_list(block, k).alias(k) for k in LIST_KEYS],
        markdown.yaml_edits(block).alias("edits"),
    )


def parse_notes(raw: DataFrame) -> DataFrame:
    """Raw files to the note table (one row in, one row out; no shuffle)."""
    split = raw.select(
        "path",
        "modified_at",
        "size",
        F.when(markdown.has_frontmatter("raw"), markdown.frontmatter_block("raw"))
        .otherwise("")
        .alias("block"),
        markdown.note_body("raw").alias("content"),
    )
    fm = split.withColumn("fm", frontmatter_struct(F.col("block")))
    alias_list = F.coalesce(F.col("fm.aliases"), markdown.yaml_list("block", "alias"))
    return fm.select(
        "path",
        markdown.note_title(F.col("fm.title"), "content", "path").alias("title"),
        markdown.note_tags(F.col("fm.tags"), "content").alias("tags"),
        dates.created_or(F.col("fm.created"), "modified_at").alias("created_at"),
        "modified_at",
        "size",
        dates.is_malformed(F.col("fm.created")).alias("malformed"),
        "content",
        F.col("fm").withField("aliases", alias_list).alias("fm"),
    )


def read_notes(spark: SparkSession, root: str, include_archive: bool = False) -> DataFrame:
    return parse_notes(raw_notes(spark, root, include_archive))


def render_notes(notes: DataFrame) -> DataFrame:
    """(path, raw): the note table back to file text."""
    fm = F.col("fm")
    scalars = {k: fm[k] for k in SCALAR_KEYS if k != "edits"}
    lists = {k: fm[k] for k in LIST_KEYS}
    return notes.select("path", markdown.render_note("content", scalars, lists).alias("raw"))


def export_notes(notes: DataFrame, target: str) -> None:
    """Write rendered notes, one folder per note path."""
    render_notes(notes).write.partitionBy("path").mode("overwrite").option(
        "lineSep", "\n"
    ).text(target)


def upsert_notes(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Create and update notes in one pass.

    ``changes``: path, op (create | update), mode (replace | append | prepend), content (null keeps
    the body), fm (null fields keep their value), changed_at; at most one row per path.
    Returns (new version of the notes, rejected changes with a reason).
    """
    ch = changes.select(
        F.when(F.endswith("path", F.lit(".md")), F.col("path"))
        .otherwise(F.concat("path", F.lit(".md")))
        .alias("path"),
        F.col("op").alias("c_op"),
        F.col("mode").alias("c_mode"),
        F.col("content").alias("c_content"),
        F.col("fm").alias("c_fm"),
        F.col("changed_at").alias("c_at"),
    )
    both = current.withColumn("_old", F.lit(True)).join(ch, "path", "full")
    exists = F.col("_old").isNotNull()
    reason = F.when(exists & (F.col("c_op") == "create"), "exists").when(
        ~exists & (F.col("c_op") == "update"), "not_found"
    )
    both = both.withColumn("_reason", reason)
    rejected = both.where(F.col("_reason").isNotNull()).select(
        "path", F.col("c_op").alias("op"), F.col("_reason").alias("reason")
    )

    applied = F.col("c_op").isNotNull() & F.col("_reason").isNull()
    old, new = F.col("content"), F.col("c_content")
    body = (
        F.when(~applied | new.isNull(), F.coalesce(old, F.lit("")))
        .when(~exists | (F.coalesce("c_mode", F.lit("replace")) == "replace"), new)
        .when(F.col("c_mode") == "append", F.concat(old, F.lit("\n\n"), new))
        .otherwise(F.concat(new, F.lit("\n\n"), old))
    )
    merged_fm = F.struct(
        *[
            F.when(applied, F.coalesce(F.col(f"c_fm.{k}"), F.col(f"fm.{k}")))
            .otherwise(F.col(f"fm.{k}"))
            .alias(k)
            for k in (*SCALAR_KEYS, *LIST_KEYS, "edits")
        ]
    )
    kept = both.where(exists | applied).select(
        "path",
        F.col("title").alias("_title"),
        F.col("tags").alias("_tags"),
        F.col("created_at").alias("_created"),
        F.col("modified_at").alias("_modified"),
        F.col("size").alias("_size"),
        F.col("malformed").alias("_malformed"),
        "c_at",
        applied.alias("_applied"),
        body.alias("content"),
        merged_fm.alias("fm"),
    )
    modified = F.when(F.col("_applied"), F.col("c_at")).otherwise(F.col("_modified"))
    renewed = F.col("_applied")
    notes = kept.select(
        "path",
        F.when(renewed, markdown.note_title(F.col("fm.title"), "content", "path"))
        .otherwise(F.col("_title"))
        .alias("title"),
        F.when(renewed, markdown.note_tags(F.col("fm.tags"), "content"))
        .otherwise(F.col("_tags"))
        .alias("tags"),
        F.when(renewed, dates.created_or(F.col("fm.created"), F.col("c_at")))
        .otherwise(F.col("_created"))
        .alias("created_at"),
        modified.alias("modified_at"),
        F.when(renewed, F.octet_length("content").cast("long"))
        .otherwise(F.col("_size"))
        .alias("size"),
        F.when(renewed, dates.is_malformed(F.col("fm.created")))
        .otherwise(F.col("_malformed"))
        .alias("malformed"),
        "content",
        "fm",
    )
    return notes, rejected


def list_notes(
    notes: DataFrame, folder: str = "", recursive: bool = True, limit: int = 100
) -> DataFrame:
    """Newest first; direct children only unless ``recursive``."""
    base = folder.rstrip("/")
    out = notes
    if base:
        out = out.where(F.startswith("path", F.lit(base + "/")))
    if not recursive:
        rest = F.substring(F.col("path"), len(base) + 2 if base else 1, 1_000_000)
        out = out.where(~F.contains(rest, F.lit("/")))
    return (
        out.select("path", "title", "tags", "created_at", "modified_at", "size")
        .orderBy(F.col("modified_at").desc(), "path")
        .limit(limit)
    )


def tag_counts(notes: DataFrame, prefix: str | None = None) -> DataFrame:
    tags = notes.select(F.explode("tags").alias("tag"))
    if prefix:
        tags = tags.where(F.startswith("tag", F.lit(prefix.lower())))
    return (
        tags.groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n_notes"))
        .orderBy(F.col("n_notes").desc(), "tag")
    )


def lookup_notes(notes: DataFrame, requested: DataFrame) -> DataFrame:
    """Point reads: one row per requested path, ``found`` false when it is missing."""
    hit = notes.select("path", "title", "tags", "content", F.lit(True).alias("_hit"))
    return requested.join(hit, "path", "left").select(
        "path", F.col("_hit").isNotNull().alias("found"), "title", "tags", "content"
    )


def curated_counts(notes: DataFrame, threshold: int = 300) -> DataFrame:
    """Per corpus: notes that are not raw sessions, and whether vectors pay off."""
    group = ["vault_id"] if "vault_id" in notes.columns else []
    n = F.count_if(~text.is_raw_session("path"))
    return notes.groupBy(*group).agg(
        n.alias("curated"), (n >= threshold).alias("semantic_on")
    )
