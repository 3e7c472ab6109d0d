from conftest import note
from pyspark.sql import functions as F

from quillspark.operators import graph, health, lifecycle, proposals

NOW = "2026-09-07 00:00:00"


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- graph --------------------------------------------------------------------------------------


def test_link_tiers_and_collisions(vault):
    notes = vault(
        {
            "src.md": "[[Target]] [[deep/x/target]] [[nick]] [[The Title]] [[Ghost]] [[src]]",
            "deep/x/target.md": "x",
            "deep/longer/target.md": "x",
            "named.md": note("The Title", aliases=["Nick"]),
        }
    )
    links = graph.resolve_links(notes).where("src = 'src.md'")
    assert {r.target: r.dst for r in links.collect()} == {
        "Target": "deep/x/target.md",
        "deep/x/target": "deep/x/target.md",
        "nick": "named.md",
        "The Title": "named.md",
        "src": "src.md",
        "Ghost": None,
    }
    assert pairs(graph.edges(graph.resolve_links(notes)), "src", "dst") == [
        ("src.md", "deep/x/target.md"),
        ("src.md", "named.md"),
    ]
    assert pairs(graph.dangling(graph.resolve_links(notes)), "src", "target") == [("src.md", "Ghost")]


def test_orphans_and_maps(vault):
    notes = vault(
        {
            "Home.md": "[[MOCs/A]]",
            "MOCs/A.md": note("A", ("type/moc",), "[[Linked]]"),
            "MOCs/B.md": note("B", ("type/moc",), "[[Linked]]"),
            "Linked.md": note("Linked", ("type/note",), "[[NoMoc]]"),
            "NoMoc.md": note("NoMoc", ("type/note",), ""),
            "Isolated.md": note("Isolated", ("type/reference",), ""),
        }
    )
    links = graph.resolve_links(notes)
    assert pairs(graph.orphans(notes, links), "path", "reason", "backlink_count") == [
        ("Isolated.md", "isolated", 0),
        ("NoMoc.md", "no-moc", 1),
    ]
    assert pairs(graph.unlinked_maps(notes, links), "path") == [("MOCs/B.md",)]
    assert pairs(graph.backlinks(links).where("dst = 'Linked.md'"), "n_sources") == [(2,)]


# --- sessions, digests, archive ---------------------------------------------------------------------


def session(project, created, body="", title="T"):
    return note(title, ("type/session", f"project/{project}"), body, created=f"'{created}'")


VAULT = {
    "sessions/2026/a1.md": session("proj-a", "2026-06-08T10:00:00Z", "## Topics\n\n- one\n\n## Files Changed\n\n- `f.py`\n"),
    "sessions/2026/a2.md": session("proj-a", "2026-06-09T10:00:00Z"),
    "sessions/2026/b1.md": session("proj-b", "2026-06-10T10:00:00Z"),
    "sessions/2026/bad.md": session("proj-c", "nope"),
    "sessions/archive/old.md": session("proj-a", "2026-06-08T10:00:00Z"),
    "sessions/digests/2026-W24-proj-a.md": note(
        "D", ("type/digest",), "## Source\n- [[sessions/2026/a1.md]]\n", sources=["./sessions/2026/a1.md", "sessions/2026/gone.md"]
    ),
    "sessions/digests/_runs/r.md": note("R", (), "", sources=["sessions/2026/b1.md"]),
    "kb/n.md": note("N", ("type/note",)),
}


def test_digest_groups(vault):
    notes = vault(VAULT, modified="2026-06-20 00:00:00")
    s = lifecycle.sessions(notes)
    assert pairs(lifecycle.malformed_sessions(s), "path") == [("sessions/2026/bad.md",)]
    g = lifecycle.digest_groups(s, notes)
    assert pairs(g, "project", "period", "exists", "n_sessions") == [
        ("proj-a", "2026-W24", True, 2),
        ("proj-b", "2026-W24", False, 1),
        ("proj-c", "2026-W25", False, 1),
    ]
    assert pairs(lifecycle.digest_groups(s, notes, min_sessions=2), "project") == [("proj-a",)]
    assert pairs(lifecycle.digest_groups(s, notes, period="month", project="proj-b"), "period") == [("2026-06",)]
    m = lifecycle.digest_members(s, g).where("project = 'proj-a'").orderBy("created_at").collect()
    assert [(r.path, r.topics, r.files_changed_count) for r in m] == [
        ("sessions/2026/a1.md", ["one"], 1),
        ("sessions/2026/a2.md", [], 0),
    ]
    assert pairs(health.digest_backlog(g), "project") == [("proj-b",), ("proj-c",)]


def test_archive_needs_a_digest(vault):
    notes = vault(VAULT, modified="2026-09-01 00:00:00")
    s, covered = lifecycle.sessions(notes), lifecycle.covered_sessions(notes)
    assert pairs(covered, "path") == [("sessions/2026/a1.md",), ("sessions/2026/gone.md",)]
    plan = lifecycle.archive_plan(s, covered, NOW).first()
    assert (plan.candidates, plan.skipped_undigested, plan.oldest) == (1, 2, "2026-06-08")
    loose = lifecycle.archive_plan(s, covered, NOW, require_digest=False).first()
    assert (loose.candidates, loose.skipped_undigested) == (3, 0)
    log = lifecycle.archive_log(lifecycle.archive_plan(s, covered, NOW), NOW).first()
    assert log.title == "1 session(s) archived (2026-06-08..2026-06-08)"


def test_archive_apply_and_repoint_twice(vault):
    notes = vault(VAULT, modified="2026-09-01 00:00:00")
    s, covered = lifecycle.sessions(notes), lifecycle.covered_sessions(notes)
    r = lifecycle.archive_candidates(s, covered, NOW).select(F.col("path").alias("from_path"), "to_path")
    once = lifecycle.repoint_digests(notes, r).where("changed").collect()
    assert len(once) == 1
    assert once[0].sources == ["./sessions/archive/2026/a1.md", "sessions/2026/gone.md"]
    assert "[[sessions/archive/2026/a1.md]]" in once[0].content
    after = lifecycle.apply_archive(notes, r)
    paths = {x.path for x in after.select("path").collect()}
    assert "sessions/archive/2026/a1.md" in paths and "sessions/2026/a1.md" not in paths
    assert lifecycle.repoint_digests(after, r).where("changed").count() == 0


# --- stale briefs, review, clusters ---------------------------------------------------------------------


def test_stale_briefs(vault, spark):
    files = {
        "kb/coffee.md": note("Coffee", ("type/brief",), last_reviewed="2026-07-01"),
        "kb/cycling.md": note("Cycling", ("type/brief",), last_reviewed="2026-07-01"),
        "kb/open.md": note("Open", ("type/brief",), last_reviewed="2026-07-01"),
        "kb/fresh.md": note("Fresh", ("type/brief",), last_reviewed="2026-09-01"),
        "proposals/brief-updates/p.md": note("P", ("type/proposal",), status="proposed", target_brief="./kb/open.md"),
        "sessions/2026/s.md": session("p", "2026-08-28T00:00:00Z", "## Topics\n\n- Roasting beans\n- open things, fresh ones\n", "girls talk"),
        "sessions/2026/early.md": session("p", "2026-06-01T00:00:00Z", "## Topics\n\n- cycling\n"),
    }
    m = spark.createDataFrame(
        [("roasting", "./kb/coffee.md"), ("sourdough", "kb/coffee.md"), ("cycling", "kb/cycling.md"), ("open", "kb/open.md"), ("fresh", "kb/fresh.md"), ("x", "kb/none.md")],
        "keyword string, path string",
    )
    notes = vault(files)
    matches = lifecycle.stale_matches(notes, lifecycle.sessions(notes), m, NOW)
    assert pairs(matches, "brief_path", "source", "session_path", "keyword") == [
        ("kb/coffee.md", "last_reviewed", "sessions/2026/s.md", "roasting")
    ]
    b = lifecycle.stale_briefs(matches).first()
    assert (b.brief_path, b.n_sessions, b.n_keywords) == ("kb/coffee.md", 1, 1)


def test_review_queue(vault):
    notes = vault(
        {
            "Fresh.md": note("Fresh", ("type/note",), date="2026-06-20"),
            "Old.md": note("Old", ("type/note", "topic/x"), date="2026-01-01"),
            "Reviewed.md": note("Rev", ("type/note",), date="2026-01-01", last_reviewed="2026-06-20"),
            "None.md": note("No date", ("type/note",)),
            "brief.md": note("B", ("type/brief",), date="2026-01-01"),
        }
    )
    rows = lifecycle.review_queue(notes, "2026-06-21 00:00:00").collect()
    assert [(r.path, r.topics, r.last_reviewed, r.age_days) for r in rows] == [("Old.md", ["topic/x"], None, 171)]


def test_topic_clusters(vault):
    files = {"MOCs/C.md": note("C", ("type/moc", "topic/cyber"))}
    for i in range(3):
        files[f"c{i}.md"] = note("x", ("topic/cyber",))
        files[f"f{i}.md"] = note("x", ("topic/finance",))
    files["r.md"] = note("x", ("topic/rare",))
    assert pairs(lifecycle.topic_clusters(vault(files)), "tag", "n_notes") == [("topic/finance", 3)]


def test_lints(vault):
    files = {
        "Home.md": "[[MOCs/A]]",
        "MOCs/A.md": note("A", ("type/moc",), "[[good]]"),
        "MOCs/B.md": note("B", ("type/moc",), ""),
        "good.md": note("Good", ("type/note",), "Source: [[Home]]"),
        "bad.md": note("Bad", ("type/note",), "[[Ghost]] see src/a/b.ts"),
        "brief.md": note("Br", ("type/brief",), "at line 12, line 13, line 14 and #L5"),
        "sessions/digests/d1.md": note("D1", ("type/digest",), ""),
        "sessions/digests/d2.md": note("D2", ("type/digest",), "[[Lost]]", sources=["sessions/x.md"]),
        "proposals/p.md": note("P", (), "from [[sessions/2026/x]]"),
        "gen.md": note("G", (), "", generated_by="tool", source="import"),
    }
    notes = vault(files)
    rows = pairs(lifecycle.lint(notes), "rule", "path", "detail")
    assert rows == [
        ("missing-link", "MOCs/B.md", 'Home.md does not link to MOC "B"'),
        ("missing-link", "bad.md", "unresolved [[Ghost]]"),
        ("missing-link", "proposals/p.md", "unresolved [[sessions/2026/x]]"),
        ("missing-provenance", "bad.md", 'Evergreen note "Bad" has no Source: link'),
        ("missing-provenance", "sessions/digests/d1.md", "generated note has no sources/source/provenance frontmatter"),
        ("orphan", "bad.md", 'nothing links to "Bad"'),
        ("stale-reference", "bad.md", "cites src/a/b.ts"),
        ("stale-reference", "brief.md", "cites line 12, line 13, line 14 (+1)"),
    ]
    only = lifecycle.lint(notes, rules=("missing-page",))
    assert only.count() == 0
    assert lifecycle.brief_stats(notes).first().n_briefs == 1
    lines = lifecycle.index_lines(notes).orderBy("folder", "path").collect()
    assert ("(root)", "- [[good|Good]] `note`: Source: Home") in [(r.folder, r.line) for r in lines]
    assert "sessions/digests" in {r.folder for r in lines} and "proposals" not in {r.folder for r in lines}


# --- proposals --------------------------------------------------------------------------------------------

EDITS = "edits:\n  - section: Facts\n    action: append\n    content: '- new'\n"


def proposal(target, edits=EDITS, status="proposed", conf="high"):
    return f"---\ntitle: P\nstatus: {status}\ntarget_brief: {target}\nconfidence: {conf}\n{edits}---\nwhy\n"


def test_apply_proposals(vault):
    d = "proposals/brief-updates/"
    bad = EDITS.replace("append", "replace").replace("Facts", "Nowhere")
    files = {
        "kb/brief-demo.md": note("Demo", ("type/brief",), "# Demo\n\n## Facts\n- old\n\n## End\n"),
        f"{d}p1.md": proposal("./kb/brief-demo.md"),
        f"{d}p2.md": proposal("kb/brief-demo.md", bad, conf="low"),
        f"{d}p3.md": proposal("kb/missing.md"),
        f"{d}p4.md": proposal("kb/brief-demo.md", EDITS.replace("- new", "- newer")),
        f"{d}done.md": proposal("kb/brief-demo.md", status="applied"),
        f"{d}prose.md": proposal("kb/brief-demo.md", ""),
    }
    notes = vault(files)
    ready = proposals.applicable(notes)
    assert pairs(ready, "path", "n_edits") == [(f"{d}p{i}.md", 1) for i in (1, 2, 3, 4)]
    assert pairs(proposals.applicable(notes, "low"), "path") == [(f"{d}p2.md",)]
    out = proposals.apply_proposals(notes, ready, "2026-09-07")
    res = {r.proposal[-5:-3]: r for r in out["results"].collect()}
    assert res["p1"].ok and res["p1"].sections_changed == ["Facts"] and res["p4"].ok
    assert res["p2"].error == 'Cannot replace missing section "Nowhere"' and not res["p2"].ok
    assert res["p3"].error == "Note not found"
    brief = out["briefs"].first()
    assert brief.content == "# Demo\n\n## Facts\n- old\n- new\n- newer\n\n## End\n" and brief.last_reviewed == "2026-09-07"
    stamped = {r.path: r for r in out["proposals"].collect()}
    assert set(stamped) == {f"{d}p1.md", f"{d}p4.md"}
    assert stamped[f"{d}p1.md"].content.startswith("> [!done] Applied 2026-09-07")
    assert {r.title for r in out["log"].collect()} == {"proposal applied (Facts)"}


def test_file_proposals(spark):
    rows = [
        ("Fix it!", "kb/a.md", "high", ["s1"], " body "),
        ("New", None, None, ["s1", "s2"], "b"),
        ("No source", None, None, [], "b"),
        ("Empty", None, None, ["s"], "  "),
    ]
    df = spark.createDataFrame(rows, "title string, target string, confidence string, sources array<string>, body string")
    ok, bad = proposals.file_proposals(df, NOW)
    got = {r.title: r for r in ok.collect()}
    assert got["Fix it!"].path == "proposals/brief-updates/2026-09-07-fix-it.md"
    assert got["New"].path == "proposals/notes/2026-09-07-new.md" and got["New"].kind == "new-note"
    assert "## Proposal\n\nbody\n\n## Provenance\n\n- s1\n" in got["Fix it!"].content
    assert pairs(bad, "title", "reason") == [("Empty", "body is empty"), ("No source", "no source")]


# --- health --------------------------------------------------------------------------------------------------


def test_health(vault, spark):
    notes = vault(
        {
            "kb/brief-big.md": "x" * 70_000,
            "kb/brief-mid.md": "x" * 40_000,
            "kb/brief-ok.md": "x",
            "kb/big.md": "x" * 70_000,
        }
    )
    assert pairs(health.oversized_briefs(notes), "path", "level") == [
        ("kb/brief-big.md", "fail"),
        ("kb/brief-mid.md", "warn"),
    ]
    assert health.newer_than_index(notes, "2026-05-31 00:00:00").first().n_newer == 4
    runs = spark.createDataFrame(
        [("a", "sessions/digests/_runs/1.md", "2026-09-01"), ("b", "sessions/digests/_runs/1.md", "2026-08-01"), ("c", "kb/x.md", "2026-09-01")],
        "vault_id string, path string, modified_at string",
    ).withColumn("modified_at", F.col("modified_at").cast("timestamp"))
    got = pairs(health.run_age(runs.select("vault_id").distinct(), runs, NOW), "vault_id", "level")
    assert got == [("a", "pass"), ("b", "fail"), ("c", "warn")]
