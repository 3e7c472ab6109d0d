"""Digest, archive, staleness and review jobs over the note table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, markdown, text
from ..functions.base import strip
from . import graph

SESSIONS, DIGESTS = "sessions/", "sessions/digests/"
BRIEF_UPDATES = "proposals/brief-updates/"

# Lint rules.
LINT_RULES = ("orphan", "missing-link", "missing-page", "stale-reference", "missing-provenance")


# --- sessions and digests -----------------------------------------------------------------


def sessions(notes: DataFrame) -> DataFrame:
    """Live session notes with project, topics and changed files."""
    p = F.col("path")
    live = (
        F.startswith(p, F.lit(SESSIONS))
        & ~F.rlike(p, F.lit("/(archive|digests)/"))
        & F.array_contains("tags", text.SESSION_TAG)
    )
    return notes.where(live).select(
        "path",
        "title",
        "tags",
        "created_at",
        "malformed",
        markdown.section_items("content", "Topics").alias("topics"),
        markdown.section_items("content", "Files Changed").alias("files_changed"),
        text.project_of("tags").alias("project"),
    )


def malformed_sessions(session_notes: DataFrame) -> DataFrame:
    return session_notes.where("malformed").select("path")


def _with_period(session_notes: DataFrame, period: str, project: str | None) -> DataFrame:
    if project is not None:
        session_notes = session_notes.where(F.col("project") == project)
    return session_notes.withColumn("period", dates.period_key("created_at", period))


def digest_groups(
    session_notes: DataFrame,
    notes: DataFrame,
    period: str = "week",
    min_sessions: int = 1,
    project: str | None = None,
) -> DataFrame:
    """Project-period groups with their size, span and whether a digest note exists.

    Counts and bounds combine before the shuffle; the members are ``digest_members``, so a group
    of any size never sits in one row.
    """
    grouped = (
        _with_period(session_notes, period, project)
        .groupBy("project", "period")
        .agg(
            F.count(F.lit(1)).alias("n_sessions"),
            F.min("created_at").alias("first_created"),
            F.max("created_at").alias("last_created"),
        )
        .where(F.col("n_sessions") >= min_sessions)
        .withColumn(
            "digest_path", F.concat(F.lit(DIGESTS), F.col("period"), F.lit("-"), F.col("project"), F.lit(".md"))
        )
    )
    existing = notes.where(F.startswith("path", F.lit(DIGESTS))).select(
        F.col("path").alias("digest_path"), F.lit(True).alias("_e")
    )
    return grouped.join(existing, "digest_path", "left").select(
        "project",
        "period",
        "digest_path",
        F.col("_e").isNotNull().alias("exists"),
        "n_sessions",
        "first_created",
        "last_created",
    )


def digest_members(
    session_notes: DataFrame,
    groups: DataFrame,
    period: str = "week",
    project: str | None = None,
) -> DataFrame:
    """The sessions of every kept group; sort by (period, project, created_at, path) to list them."""
    return (
        _with_period(session_notes, period, project)
        .join(groups.select("project", "period", "digest_path"), ["project", "period"])
        .select(
            "project",
            "period",
            "digest_path",
            "path",
            "title",
            "created_at",
            "topics",
            F.size("files_changed").alias("files_changed_count"),
        )
    )


def covered_sessions(notes: DataFrame) -> DataFrame:
    """(path) of sessions some digest lists in its sources."""
    direct = F.rlike("path", F.lit(r"\Asessions/digests/[^/]+\z"))
    return (
        notes.where(direct)
        .select(F.explode("fm.sources").alias("path"))
        .select(text.drop_dot_slash("path").alias("path"))
        .distinct()
    )


# --- archive --------------------------------------------------------------------------------


def archive_candidates(
    session_notes: DataFrame,
    covered: DataFrame,
    as_of: str,
    days_old: int = 30,
    require_digest: bool = True,
) -> DataFrame:
    """(path, created_at, to_path) of sessions old enough and safe to move."""
    old = session_notes.where(
        F.col("created_at") < dates.days_before(dates.clock(as_of), days_old)
    ).select("path", "created_at")
    if require_digest:
        old = old.join(covered, "path", "left_semi")
    return old.withColumn("to_path", text.archive_path("path"))


def archive_plan(
    session_notes: DataFrame,
    covered: DataFrame,
    as_of: str,
    days_old: int = 30,
    require_digest: bool = True,
) -> DataFrame:
    """One row: candidates, skipped for want of a digest, oldest and newest date."""
    old = session_notes.where(
        F.col("created_at") < dates.days_before(dates.clock(as_of), days_old)
    ).join(covered.withColumn("_c", F.lit(True)), "path", "left")
    ok = F.col("_c").isNotNull() if require_digest else F.lit(True)
    return old.agg(
        F.count_if(ok).alias("candidates"),
        F.count_if(~ok).alias("skipped_undigested"),
        F.date_format(F.min(F.when(ok, F.col("created_at"))), "yyyy-MM-dd").alias("oldest"),
        F.date_format(F.max(F.when(ok, F.col("created_at"))), "yyyy-MM-dd").alias("newest"),
    )


def repoint_digests(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """Digest notes with every renamed session path rewritten. ``renames``: from_path, to_path.

    Returns the digests (path, content, sources, changed). Paths are taken out of each digest and
    joined with the renames, so the rename list is never carried whole.
    """
    direct = F.rlike("path", F.lit(r"\Asessions/digests/[^/]+\z"))
    digests = notes.where(direct).select(
        "path",
        "content",
        F.coalesce(F.col("fm.sources"), F.array().cast("array<string>")).alias("sources"),
    )
    cited = digests.select(
        "path",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.regexp_extract_all(
                        "content", F.lit(r"sessions/[^\s\[\]|#\"'(),]+?\.md"), F.lit(0)
                    ),
                    F.transform("sources", text.drop_dot_slash),
                )
            )
        ).alias("from_path"),
    )
    # A digest's hits are bounded by the paths written in its own text.
    hits = (
        cited.join(renames.select("from_path", "to_path"), "from_path")
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("from_path", "to_path"))).alias("hits"))
    )

    def rewrite(c: Column) -> Column:
        return F.aggregate(
            F.coalesce(F.col("hits"), F.array().cast("array<struct<from_path:string,to_path:string>>")),
            c,
            lambda acc, h: F.replace(acc, h["from_path"], h["to_path"]),
        )

    out = digests.join(hits, "path", "left").select(
        "path",
        rewrite(F.col("content")).alias("new_content"),
        F.transform("sources", rewrite).alias("new_sources"),
        "content",
        "sources",
    )
    return out.select(
        "path",
        F.col("new_content").alias("content"),
        F.col("new_sources").alias("sources"),
        (
            (F.col("new_content") != F.col("content"))
            | (F.to_json("new_sources") != F.to_json("sources"))
        ).alias("changed"),
    )


def apply_archive(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """The note table after a move: new paths, repointed digests."""
    moved = notes.join(renames, notes["path"] == renames["from_path"], "left").select(
        F.coalesce("to_path", "path").alias("path"),
        *[c for c in notes.columns if c != "path"],
    )
    fixed = repoint_digests(notes, renames).where("changed").select(
        "path", F.col("content").alias("_content"), F.col("sources").alias("_sources")
    )
    return (
        moved.join(fixed, "path", "left")
        .withColumn("content", F.coalesce("_content", "content"))
        .withColumn("fm", F.col("fm").withField("sources", F.coalesce("_sources", F.col("fm.sources"))))
        .drop("_content", "_sources")
    )


def archive_log(plan: DataFrame, as_of: str) -> DataFrame:
    """One event per archive run that moved something."""
    return plan.where(F.col("candidates") > 0).select(
        dates.clock(as_of).cast("date").alias("date"),
        F.lit("archive").alias("kind"),
        F.concat(
            F.col("candidates").cast("string"),
            F.lit(" session(s) archived ("),
            "oldest",
            F.lit(".."),
            "newest",
            F.lit(")"),
        ).alias("title"),
        F.lit("sessions/archive/").alias("path"),
    )


# --- stale briefs ---------------------------------------------------------------------------


def open_targets(notes: DataFrame) -> DataFrame:
    """(path) of notes with an open update proposal."""
    direct = F.rlike("path", F.lit(rf"\A{BRIEF_UPDATES}[^/]+\z"))
    return (
        notes.where(direct & (F.col("fm.status") == "proposed") & F.col("fm.target_brief").isNotNull())
        .select(text.drop_dot_slash(F.col("fm.target_brief")).alias("path"))
        .distinct()
    )


def _plain_words(c: str) -> Column:
    return F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Every run of ``n`` words, joined by blanks."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.coalesce(runs, F.array().cast("array<string>"))


def _sign_key(keyword: str) -> Column:
    """The first one or two signs of a keyword without word characters; the mark keeps them apart from words."""
    k = F.trim(F.lower(keyword))
    second = F.substring(k, 2, 1)
    return F.concat(F.lit("\u0001"), F.substring(k, 1, 1), F.when(F.rlike(second, F.lit(r"^[^\s\w]$")), second).otherwise(""))


def _sign_keys(spoken: str) -> Column:
    """All keys that a keyword of signs in this text can have."""
    low = F.lower(spoken)
    single = F.regexp_extract_all(low, F.lit(r"[^\s\w]"), F.lit(0))
    double = F.regexp_extract_all(low, F.lit(r"(?=([^\s\w]{2}))"), F.lit(1))
    marked = F.transform(F.array_distinct(F.concat(single, double)), lambda s: F.concat(F.lit("\u0001"), s))
    return F.coalesce(marked, F.array().cast("array<string>"))


def stale_matches(
    notes: DataFrame,
    session_notes: DataFrame,
    brief_map: DataFrame,
    as_of: str,
    stale_days: int = 21,
) -> DataFrame:
    """(brief_path, review_date, source, session_path, session_created, keyword) of stale notes.

    Sessions and keywords meet on the first words of the keyword, up to three in a row, so a
    common word alone brings nothing together; the literal match is checked on the survivors.
    """
    briefs = (
        brief_map.select(text.drop_dot_slash("path").alias("path"), "keyword")
        .join(
            notes.select(
                "path",
                dates.review_date(
                    F.col("fm.last_reviewed"), F.col("fm.updated"), "modified_at"
                ).alias("review_date"),
                dates.review_date_source(F.col("fm.last_reviewed"), F.col("fm.updated")).alias(
                    "source"
                ),
            ),
            "path",
        )
        .where(F.col("review_date") <= dates.days_before(dates.clock(as_of), stale_days))
        .join(open_targets(notes), "path", "left_anti")
        .withColumn("words", F.array_join(F.slice(_plain_words("keyword"), 1, 3), " "))
        .withColumn("words", F.when(F.col("words") == "", _sign_key("keyword")).otherwise(F.col("words")))
    )
    spoken = session_notes.select(
        F.col("path").alias("session_path"),
        F.col("created_at").alias("session_created"),
        F.array_join(F.concat(F.array("title"), "topics", "files_changed"), "\n").alias("spoken"),
    )
    by_words = spoken.withColumn("w", _plain_words("spoken")).select(
        "session_path",
        "session_created",
        "spoken",
        # Keywords without any ASCII word character are found by their first signs.
        F.explode(
            F.array_distinct(
                F.concat(F.col("w"), _runs(F.col("w"), 2), _runs(F.col("w"), 3), _sign_keys("spoken"))
            )
        ).alias("words"),
    )
    return (
        by_words.join(briefs, "words")
        .where(F.col("session_created") > F.col("review_date"))
        .where(text.matches_keyword("spoken", "keyword"))
        .select(
            F.col("path").alias("brief_path"),
            "review_date",
            "source",
            "session_path",
            "session_created",
            "keyword",
        )
    )


def stale_briefs(matches: DataFrame) -> DataFrame:
    """One row per stale note. Two countable levels instead of a list of unknown length."""
    per_session = matches.groupBy(
        "brief_path", "review_date", "source", "session_path", "session_created"
    ).agg(F.count(F.lit(1)).alias("k"))
    sessions_part = per_session.groupBy("brief_path", "review_date", "source").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.min("session_created").alias("first_session"),
        F.max("session_created").alias("last_session"),
    )
    words = (
        matches.select("brief_path", "keyword")
        .distinct()
        .groupBy("brief_path")
        .agg(F.count(F.lit(1)).alias("n_keywords"))
    )
    return sessions_part.join(words, "brief_path")


# --- review queue, topic clusters --------------------------------------------------------------


def review_queue(notes: DataFrame, as_of: str, window: int = 14) -> DataFrame:
    """Evergreen notes not looked at for ``window`` days, oldest first."""
    fm = lambda k: F.col(f"fm.{k}")
    base = dates.baseline_date(fm("last_reviewed"), fm("reviewed"), fm("date"), fm("created"))
    seen = F.coalesce(fm("last_reviewed"), fm("reviewed"))
    return (
        notes.where(F.array_contains("tags", "type/note"))
        .select(
            "path",
            "title",
            text.topic_tags("tags").alias("topics"),
            F.when(dates.parse_ts(seen).isNotNull(), seen).alias("last_reviewed"),
            dates.age_days(base, dates.clock(as_of)).alias("age_days"),
        )
        .where(F.col("age_days") >= window)
    )


def topic_clusters(notes: DataFrame, threshold: int = 3) -> DataFrame:
    """(tag, n_notes): topics with enough notes and no map of their own."""
    topics = notes.select(
        text.is_moc("path", "tags").alias("moc"), F.explode(text.topic_tags("tags")).alias("tag")
    )
    # One aggregate does the count and the anti-join.
    return (
        topics.groupBy("tag")
        .agg(F.count_if(~F.col("moc")).alias("n_notes"), F.bool_or("moc").alias("owned"))
        .where((F.col("n_notes") >= threshold) & ~F.col("owned"))
        .select("tag", "n_notes")
    )


# --- lints ------------------------------------------------------------------------------------


def has_provenance() -> Column:
    fm = lambda k: F.col(f"fm.{k}")
    some = lambda k: F.coalesce(F.size(fm(k)) > 0, F.lit(False))
    filled = lambda k: F.coalesce(strip(fm(k)) != "", F.lit(False))
    proposal = F.startswith("path", F.lit("proposals/")) & (
        some("sessions")
        | F.contains("content", F.lit("[[sessions/"))
        | F.rlike("content", F.lit(r"sessions/\d{4}/"))
    )
    return some("sources") | filled("source") | filled("provenance") | proposal


def structure_issues(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, path, detail): maps off the home note, dead links, evergreen notes without source."""
    maps = graph.unlinked_maps(notes, links).select(
        F.lit("moc-not-in-home").alias("kind"),
        "path",
        F.concat(F.lit('Home.md does not link to MOC "'), "title", F.lit('"')).alias("detail"),
    )
    dead = (
        graph.dangling(links)
        .where(~F.startswith("src", F.lit(SESSIONS)))
        .select(
            F.lit("dangling-link").alias("kind"),
            F.col("src").alias("path"),
            F.concat(F.lit("unresolved [["), "target", F.lit("]]")).alias("detail"),
        )
    )
    unsourced = notes.where(
        F.array_contains("tags", "type/note")
        & ~F.rlike("content", F.lit(r"(?:\A|\n)\s*Source:\s*\[\["))
    ).select(
        F.lit("missing-source").alias("kind"),
        "path",
        F.concat(F.lit('Evergreen note "'), "title", F.lit('" has no Source: link')).alias("detail"),
    )
    return maps.unionByName(dead).unionByName(unsourced)


def lint(
    notes: DataFrame,
    links: DataFrame | None = None,
    rules: tuple[str, ...] = LINT_RULES,
    threshold: int = 3,
) -> DataFrame:
    """(rule, path, detail). Rules that were not asked for are not planned."""
    if links is None:
        links = graph.resolve_links(notes)
    parts: list[DataFrame] = []
    if "orphan" in rules:
        o = graph.orphans(notes, links)
        parts.append(
            o.select(
                F.lit("orphan").alias("rule"),
                "path",
                F.when(
                    F.col("reason") == "isolated",
                    F.concat(F.lit('nothing links to "'), "title", F.lit('"')),
                )
                .otherwise(
                    F.concat(
                        F.lit('no MOC links to "'),
                        "title",
                        F.lit('" ('),
                        F.col("backlink_count").cast("string"),
                        F.lit(" other backlink(s))"),
                    )
                )
                .alias("detail"),
            )
        )
    if "missing-link" in rules or "missing-provenance" in rules:
        s = structure_issues(notes, links)
        rule = F.when(F.col("kind") == "missing-source", "missing-provenance").otherwise(
            "missing-link"
        )
        s = s.select(rule.alias("rule"), "path", "detail")
        parts.append(s.where(F.col("rule").isin(*rules)))
    if "missing-page" in rules:
        parts.append(
            topic_clusters(notes, threshold).select(
                F.lit("missing-page").alias("rule"),
                F.col("tag").alias("path"),
                F.concat(
                    F.col("n_notes").cast("string"),
                    F.lit(" notes carry "),
                    "tag",
                    F.lit(" and no MOC owns it"),
                ).alias("detail"),
            )
        )
    if "stale-reference" in rules:
        refs = notes.where(text.is_durable("tags")).select(
            "path", text.stale_references("content").alias("refs")
        )
        more = F.size("refs") - 3
        parts.append(
            refs.where(F.size("refs") > 0).select(
                F.lit("stale-reference").alias("rule"),
                "path",
                F.concat(
                    F.lit("cites "),
                    F.array_join(F.slice("refs", 1, 3), ", "),
                    F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""),
                ).alias("detail"),
            )
        )
    if "missing-provenance" in rules:
        parts.append(
            notes.where(
                text.is_generated("path", "tags", F.col("fm.generated_by")) & ~has_provenance()
            ).select(
                F.lit("missing-provenance").alias("rule"),
                "path",
                F.lit("generated note has no sources/source/provenance frontmatter").alias("detail"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief_stats(notes: DataFrame) -> DataFrame:
    return notes.where(F.array_contains("tags", "type/brief")).agg(
        F.count(F.lit(1)).alias("n_briefs"),
        F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0).cast("long")).alias("total_chars"),
    )


# --- index page ----------------------------------------------------------------------------------


def index_lines(notes: DataFrame) -> DataFrame:
    """(folder, path, line): one line per curated note. Sort by (folder, path) to print the page."""
    p = F.col("path")
    curated = notes.where(text.is_curated("path") & ~F.startswith(p, F.lit("00-Index/")))
    kind = F.try_element_at(
        F.filter("tags", lambda t: F.startswith(t, F.lit("type/"))), F.lit(1)
    )
    s = text.summary_line("content")
    return curated.select(
        F.when(F.startswith(p, F.lit(DIGESTS)), "sessions/digests")
        .otherwise(text.top_folder("path"))
        .alias("folder"),
        "path",
        F.concat(
            F.lit("- [["),
            text.slug("path"),
            F.lit("|"),
            "title",
            F.lit("]]"),
            F.when(
                kind.isNotNull(),
                F.concat(F.lit(" `"), F.regexp_replace(kind, r"\Atype/", ""), F.lit("`")),
            ).otherwise(""),
            F.when(s != "", F.concat(F.lit(": "), s)).otherwise(""),
        ).alias("line"),
    )


# --- weekly summary --------------------------------------------------------------------------------


def weekly_summary(
    groups: DataFrame, proposals: DataFrame, archive: DataFrame, lints: DataFrame, queue: DataFrame
) -> DataFrame:
    """(section, item, n): the counts of a weekly report, as one long table."""

    def section(name: str, df: DataFrame, item: Column, n: Column | None = None) -> DataFrame:
        count = F.count(F.lit(1)) if n is None else F.coalesce(F.sum(n), F.lit(0)).cast("long")
        return df.groupBy(item.alias("item")).agg(count.alias("n")).select(
            F.lit(name).alias("section"), "item", "n"
        )

    exists = F.when(F.col("exists"), "written").otherwise("pending")
    return (
        section("digests", groups, exists)
        .unionByName(section("proposals", proposals, F.coalesce("confidence", F.lit("none"))))
        .unionByName(section("archived", archive, F.lit("candidates"), F.col("candidates")))
        .unionByName(section("health", lints, F.col("rule")))
        .unionByName(section("review", queue, F.lit("due")))
    )
