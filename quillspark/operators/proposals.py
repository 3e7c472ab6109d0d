"""Filing and applying change proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, markdown, text
from ..functions.base import strip
from .lifecycle import BRIEF_UPDATES


def file_proposals(requests: DataFrame, as_of: str, tool: str = "propose") -> tuple[DataFrame, DataFrame]:
    """Turn requests into proposal notes.

    ``requests``: title, target (nullable), confidence (nullable), sources[], body. Returns the
    accepted notes (path, content, status, target_brief, confidence, sources, kind, created) and the
    rejected requests with a reason.
    """
    body = strip("body")
    reason = (
        F.when(F.coalesce(strip("title"), F.lit("")) == "", "title is empty")
        .when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no source")
        .when(F.coalesce(body, F.lit("")) == "", "body is empty")
    )
    r = requests.withColumn("reason", reason)
    now = dates.clock(as_of)
    folder = F.when(F.col("target").isNotNull(), F.lit(BRIEF_UPDATES)).otherwise("proposals/notes/")
    lead = F.when(
        F.col("target").isNotNull(),
        F.concat(
            F.lit("Proposed change to `"),
            "target",
            F.lit("`. Review, then apply it if it carries an `edits:` block, or by hand."),
        ),
    ).otherwise(
        "Candidate new note. Review, then move it to its home folder with frontmatter copied from a sibling."
    )
    content = F.concat(
        F.lit("# "),
        "title",
        F.lit("\n\n"),
        lead,
        F.lit("\n\n## Proposal\n\n"),
        body,
        F.lit("\n\n## Provenance\n\n"),
        F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s)), "\n"),
        F.lit("\n"),
    )
    accepted = r.where(F.col("reason").isNull()).select(
        F.concat(
            folder, F.date_format(now, "yyyy-MM-dd"), F.lit("-"), text.title_slug("title"), F.lit(".md")
        ).alias("path"),
        "title",
        content.alias("content"),
        F.lit("proposed").alias("status"),
        F.col("target").alias("target_brief"),
        F.when(F.col("target").isNull(), "new-note").alias("kind"),
        "confidence",
        "sources",
        F.lit(tool).alias("generated_by"),
        dates.iso_text(now).alias("created"),
    )
    rejected = r.where(F.col("reason").isNotNull()).select("title", "target", "reason")
    return accepted, rejected


def applicable(notes: DataFrame, confidence: str | None = None) -> DataFrame:
    """(path, target_brief, confidence, n_edits, edits) of open proposals with usable edits."""
    direct = F.rlike("path", F.lit(rf"\A{BRIEF_UPDATES}[^/]+\z"))
    out = notes.where(
        direct
        & (F.col("fm.status") == "proposed")
        & (F.coalesce(strip(F.col("fm.target_brief")), F.lit("")) != "")
    ).select(
        "path",
        text.drop_dot_slash(F.col("fm.target_brief")).alias("target_brief"),
        F.col("fm.confidence").alias("confidence"),
        markdown.valid_edits(F.col("fm.edits")).alias("edits"),
    )
    out = out.where(F.size("edits") > 0)
    if confidence is not None:
        out = out.where(F.col("confidence") == confidence)
    return out.withColumn("n_edits", F.size("edits"))


def apply_proposals(notes: DataFrame, proposals: DataFrame, today: str) -> dict[str, DataFrame]:
    """Apply proposals to their notes, in path order per note; each one whole or not at all.

    The proposals of one note meet in one row because its new body, which holds what they
    add, is one row as well. Returns ``results``, ``briefs``, ``proposals`` and ``log``.
    """
    bodies = notes.select(F.col("path").alias("target_brief"), F.col("content").alias("old_body"))
    queue = (
        proposals.groupBy("target_brief")
        .agg(F.array_sort(F.collect_list(F.struct("path", "edits"))).alias("queue"))
        .join(bodies, "target_brief", "left")
    )
    start = F.struct(
        F.col("old_body").alias("body"),
        F.array()
        .cast("array<struct<path:string,ok:boolean,changed:array<string>,error:string>>")
        .alias("results"),
    )

    def step(acc: Column, p: Column) -> Column:
        done = F.transform(
            F.array(markdown.apply_edits(acc["body"], p["edits"])),
            lambda r: F.struct(
                F.coalesce(r["body"], acc["body"]).alias("body"),
                F.array_append(
                    acc["results"],
                    F.struct(
                        p["path"].alias("path"),
                        (acc["body"].isNotNull() & r["error"].isNull()).alias("ok"),
                        r["changed"].alias("changed"),
                        F.when(acc["body"].isNull(), F.lit("Note not found"))
                        .otherwise(r["error"])
                        .alias("error"),
                    ),
                ).alias("results"),
            ),
        )
        return F.element_at(done, 1)

    folded = queue.select(
        "target_brief", "old_body", F.aggregate("queue", start, step).alias("r")
    )
    results = folded.select("target_brief", F.explode("r.results").alias("x")).select(
        F.col("x.path").alias("proposal"),
        "target_brief",
        F.col("x.ok").alias("ok"),
        F.when(F.col("x.ok"), F.col("x.changed")).alias("sections_changed"),
        F.when(F.col("x.ok"), F.lit(today)).alias("last_reviewed"),
        F.col("x.error").alias("error"),
    )
    briefs = folded.where(F.exists("r.results", lambda x: x["ok"])).select(
        F.col("target_brief").alias("path"),
        F.col("r.body").alias("content"),
        F.lit(today).alias("last_reviewed"),
    )
    applied = results.where("ok")
    banner = F.concat(
        F.lit(f"> [!done] Applied {today} — applied to `"),
        "target_brief",
        F.lit("` ("),
        F.array_join("sections_changed", ", "),
        F.lit("). This proposal is resolved; the notes below are historical, no action needed."),
    )
    stamped = applied.join(
        notes.select(F.col("path").alias("proposal"), "content"), "proposal"
    ).select(
        F.col("proposal").alias("path"),
        F.concat(banner, F.lit("\n\n"), "content").alias("content"),
        F.lit("applied").alias("status"),
        F.lit(today).alias("applied"),
    )
    log = applied.select(
        F.lit(today).cast("date").alias("date"),
        F.lit("applied").alias("kind"),
        F.concat(
            F.lit("proposal applied ("), F.array_join("sections_changed", ", "), F.lit(")")
        ).alias("title"),
        F.col("target_brief").alias("path"),
    )
    return {"results": results, "briefs": briefs, "proposals": stamped, "log": log}
