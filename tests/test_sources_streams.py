import json

import pytest
from conftest import note
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.operators import context, keyword
from quillspark.session import work_dir
from quillspark.sources import files, snapshot
from quillspark.sources import notes as note_source
from quillspark.streaming import jobs


@pytest.fixture
def folder(tmp_path):
    def write(items, root=tmp_path / "vault"):
        for rel, raw in items.items():
            p = root / rel
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(raw, encoding="utf-8")
        return str(root)

    return write


FILES = {
    "Home.md": "# Home\n",
    "kb/sub dir/a b.md": note("A", ("x",), "body\n"),
    "kb/skip.txt": "no",
    ".hidden/x.md": "hidden",
    "sessions/archive/old.md": "archived",
    "sessions/digests/d.md": "digest",
    "sessions/digests/_runs/r.md": "run report",
}


def test_note_scan(spark, folder):
    root = folder(FILES)
    live = {r.path for r in note_source.read_notes(spark, root).collect()}
    assert live == {"Home.md", "kb/sub dir/a b.md", "sessions/digests/d.md", "sessions/digests/_runs/r.md"}
    every = {r.path for r in note_source.read_notes(spark, root, include_archive=True).collect()}
    assert every - live == {"sessions/archive/old.md"}
    stats = {r.path: r.size for r in note_source.stat_notes(spark, root).collect()}
    assert stats["Home.md"] == 7 and set(stats) == live


def test_bad_bytes_are_replaced(spark, folder, tmp_path):
    root = folder({"ok.md": "fine"})
    (tmp_path / "vault" / "bad.md").write_bytes(b"caf\xe9 is kept")
    got = {r.path: r.content for r in note_source.read_notes(spark, root).collect()}
    assert got == {"ok.md": "fine", "bad.md": "caf\ufffd is kept"}


def test_underscored_names_are_read(spark, folder):
    root = folder({"_x/c.md": "# C", "kb/_conv.md": "rules", "kb/_y/_z/d.md": "deep", "kb/.h/_e.md": "hidden", "a.md": "plain", "_x/n.txt": "no"})
    got = {r.path: r.content for r in note_source.read_notes(spark, root).collect()}
    assert got == {"_x/c.md": "# C", "kb/_conv.md": "rules", "kb/_y/_z/d.md": "deep", "a.md": "plain"}
    assert {r.path for r in note_source.stat_notes(spark, root).collect()} == set(got)


def test_listing_lookup_and_curated(vault, spark):
    notes = vault({"a/1.md": ("x", "2026-01-01"), "a/b/2.md": ("x", "2026-01-02"), "3.md": ("x", "2026-01-03"), "sessions/s.md": ("x", "2026-01-04")})
    paths = lambda d: [r.path for r in d.collect()]
    assert paths(note_source.list_notes(notes, limit=2)) == ["sessions/s.md", "3.md"]
    assert paths(note_source.list_notes(notes, "a/")) == ["a/b/2.md", "a/1.md"]
    assert paths(note_source.list_notes(notes, "a", recursive=False)) == ["a/1.md"]
    assert paths(note_source.list_notes(notes, recursive=False)) == ["3.md"]
    c = note_source.curated_counts(notes, threshold=3).first()
    assert (c.curated, c.semantic_on) == (3, True)
    asked = spark.createDataFrame([("3.md",), ("no.md",)], "path string")
    assert {r.path: r.found for r in note_source.lookup_notes(notes, asked).collect()} == {"3.md": True, "no.md": False}


def test_upsert(vault, spark):
    notes = vault({"a.md": note("A", ("x",), "old", keywords=["k"]), "b.md": "stay"})
    fm = notes.schema["fm"].dataType
    blank = {f.name: None for f in fm.fields}
    rows = [
        ("a.md", "update", "append", "more", {**blank, "title": "New"}),
        ("b.md", "create", "replace", "x", None),
        ("c", "create", "replace", "# C", None),
        ("d.md", "update", "replace", "x", None),
    ]
    ch = spark.createDataFrame(rows, f"path string, op string, mode string, content string, fm {fm.simpleString()}")
    new, rejected = note_source.upsert_notes(notes, ch.withColumn("changed_at", F.lit("2026-07-01").cast("timestamp")))
    got = {r.path: r for r in new.collect()}
    assert set(got) == {"a.md", "b.md", "c.md"}
    assert got["a.md"].content == "old\n\nmore" and got["a.md"].title == "New" and got["a.md"].fm.keywords == ["k"]
    assert str(got["a.md"].modified_at) == "2026-07-01 00:00:00" and got["b.md"].content == "stay" and got["c.md"].title == "C"
    assert {(r.path, r.reason) for r in rejected.collect()} == {("b.md", "exists"), ("d.md", "not_found")}


def test_render_export_and_read_back(vault, tmp_path):
    notes = vault({"x/a.md": note("It's", ("t/one",), "body\n\ntext\n", sources=["s1", "s2"]), "plain.md": "only body"})
    raw = {r.path: r.raw for r in note_source.render_notes(notes).collect()}
    assert raw["plain.md"] == "only body"
    assert raw["x/a.md"].startswith("---\ntitle: 'It''s'\ntags:\n  - 't/one'\nsources:\n")
    note_source.export_notes(notes, str(tmp_path / "out"))


def test_keyword_map(spark, tmp_path):
    p = tmp_path / "map.json"
    p.write_text('{"JWT ": "kb/a.md", "none": null, "blank": " "}')
    assert [tuple(r) for r in files.read_keyword_map(spark, str(p)).collect()] == [("jwt", "kb/a.md")]
    p.write_text("[1, 2]")
    assert files.read_keyword_map(spark, str(p)).count() == 0


def test_jsonl_and_cases(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"a": 1}\n\n{broken\n{"a": {"b": "x"}}\n')
    assert files.read_jsonl(spark, str(p)).count() == 2
    c = tmp_path / "cases.jsonl"
    c.write_text(json.dumps({"id": "1", "query": "q", "expectedNotes": ["a.md"], "stratum": "nl"}) + "\n")
    assert files.read_cases(spark, str(c)).first().expectedNotes == ["a.md"]
    c.write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_cases(spark, str(c)).collect()


def test_event_log(spark, tmp_path):
    p = str(tmp_path / "log")
    ev = lambda rows: spark.createDataFrame(rows, "date string, kind string, title string, path string").withColumn("date", F.col("date").cast("date"))
    files.append_log(ev([("2026-01-01", "capture", "a | b\nc", "x.md")]), p)
    files.append_log(ev([("2026-01-02", "archive", "moved", "y/")]), p)
    lines = sorted(r.value for r in spark.read.text(p).collect() if r.value.startswith("## "))
    assert lines == ["## [2026-01-01] capture | a b c | x.md", "## [2026-01-02] archive | moved | y/"]
    f = tmp_path / "log.md"
    f.write_text("# Log\n\n" + "\n".join(lines) + "\nnoise\n## [2026-01-03] index | i | z\n")
    log = files.read_log(spark, str(f))
    assert [r.kind for r in log.orderBy("seq").collect()] == ["capture", "archive", "index"]
    assert [r.title for r in files.log_tail(log, 2).collect()] == ["moved", "i"]
    assert [r.title for r in files.log_tail(log, 5, "capture").collect()] == ["a b c"]


def test_event_log_in_the_order_of_appends(spark, tmp_path):
    p = str(tmp_path / "log")
    for run in range(3):
        rows = [("2026-01-01", "capture", f"run {run} event {k}", "x.md") for k in range(5)]
        df = spark.createDataFrame(rows, "date string, kind string, title string, path string")
        files.append_log(df.withColumn("date", F.col("date").cast("date")), p)
    log = files.read_log(spark, p)
    every = [f"run {run} event {k}" for run in range(3) for k in range(5)]
    assert [r.title for r in log.orderBy("seq").collect()] == every
    assert [r.title for r in files.log_tail(log, 7).collect()] == every[-7:]
    assert sum(r.value == files.LOG_HEADER for r in spark.read.text(p).collect()) == 1


def test_snapshot(spark, vault, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshot.load(spark, root, ["postings"]) is None
    ix = keyword.build_index(vault({"a.md": "alpha"}))
    snapshot.publish(ix.tables(), root)
    back = snapshot.load(spark, root, list(ix.tables()))
    assert back["postings"].count() == ix.postings.count()
    q = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    hits = keyword.search(keyword.KeywordIndex(**back), q, "2026-08-01 00:00:00")
    assert hits.first().path == "a.md"
    snapshot.publish(keyword.build_index(vault({"b.md": "alpha"})).tables(), root)
    assert snapshot.load(spark, root, ["postings"])["postings"].first().path == "b.md"
    assert snapshot.load(spark, root, ["postings"], version=99) is None
    cache = spark.createDataFrame([("h1", 1), ("h2", 2)], "hash string, v int")
    live = spark.createDataFrame([("h1",)], "hash string")
    assert [r.hash for r in snapshot.compact_cache(cache, live).collect()] == ["h1"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame(
        [("s", "how does it work", "brief", "tag_search", "a.md", ["a.md"], False)],
        "session_id string, prompt string, tier string, method string, route_path string, injected array<string>, suppressed boolean",
    ).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    out = str(tmp_path / "log")
    files.append_decisions(context.decision_log(d), out)
    files.append_decisions(context.decision_log(d), out)
    rows = spark.read.json(out).collect()
    assert len(rows) == 2 and rows[0].promptChars == 16 and rows[0].route.method == "tag_search"
    res = spark.createDataFrame([("2026-01-01", "curated", 0.5)], "run_date string, mode string, recall double")
    files.write_eval_results(res, str(tmp_path / "r"))
    assert (tmp_path / "r" / "run_date=2026-01-01" / "mode=curated").exists()


# --- streams ------------------------------------------------------------------------------------------


def run(query):
    query.awaitTermination()


COLS = ["path", "term", "tf_title", "tf_content", "len_content"]


def posting_rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def test_index_stream_takes_new_files(spark, folder, tmp_path):
    root = folder({"a.md": "alpha beta", "kb/b.md": "beta"})
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    run(jobs.index_new_files(spark, root, out, cp, files_per_batch=1))
    folder({"c.md": "new gamma"})
    run(jobs.index_new_files(spark, root, out, cp))
    want = keyword.build_index(note_source.read_notes(spark, root)).postings
    assert posting_rows(jobs.live_postings(spark, out)) == posting_rows(want)


def test_refresh_follows_changes_and_deletions(spark, folder, tmp_path):
    root = folder({"a.md": "alpha beta", "kb/b.md": "beta", "gone.md": "bye"})
    out = str(tmp_path / "out")
    jobs.refresh_once(spark, root, out, 0)
    folder({"kb/b.md": "gamma gamma delta", "c.md": "new"})
    (tmp_path / "vault" / "gone.md").unlink()
    changes = jobs.refresh_once(spark, root, out, 1)
    assert {r.path: r.change for r in changes.collect()} == {"kb/b.md": "changed", "c.md": "added", "gone.md": "removed"}
    want = keyword.build_index(note_source.read_notes(spark, root)).postings
    assert posting_rows(jobs.live_postings(spark, out)) == posting_rows(want)
    assert jobs.refresh_once(spark, root, out, 2).count() == 0
    folder({"gone.md": "back again"})
    jobs.refresh_once(spark, root, out, 3)
    assert jobs.live_postings(spark, out).where("path = 'gone.md' and term = 'back'").count() == 1


def test_watch_runs_refresh_on_a_clock(spark, folder, tmp_path):
    root, out = folder({"a.md": "alpha"}), str(tmp_path / "out")
    query = jobs.watch_folder(spark, root, out, str(tmp_path / "cp"), "1 second")
    try:
        for _ in range(30):
            if jobs.read_batches(spark, out, "note_versions") is not None:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert jobs.live_postings(spark, out).where("term = 'alpha'").count() == 1


def test_suppression_stream_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "session_id string, prompt_id int, ts timestamp, method string, injected array<string>"
    batches = [
        [("s", 2, "2026-01-01 00:00:02", "tag_search", ["a"]), ("s", 1, "2026-01-01 00:00:01", "tag_search", ["a", "b"])],
        [("s", 3, "2026-01-01 00:00:03", "tag_search", ["b"]), ("s", 4, "2026-01-01 00:00:04", "tag_search", ["c"]), ("t", 5, "2026-01-01 00:00:05", "tag_search", ["b"])],
        [("s", 6, "2026-01-01 00:00:06", "direct_map", ["a"]), ("s", 7, "2026-01-01 00:00:07", "tag_search", ["c", "d"])],
    ]
    for b in batches:
        df = spark.createDataFrame(b, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        run(jobs.suppress(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    log = jobs.read_batches(spark, str(tmp_path / "out"), "decisions")
    got = {r.prompt_id: r.suppressed for r in log.collect()}
    batch = {r.prompt_id: r.suppressed for r in context.suppress_repeats(spark.read.parquet(str(src))).collect()}
    assert got == batch == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_suppression_state_expires_and_spreads_a_session(spark, tmp_path):
    src = tmp_path / "in"
    schema = "session_id string, prompt_id int, ts timestamp, method string, injected array<string>, note string"

    def add(first):
        rows = [("hot", first + i, "2026-01-01 00:00:00", "tag_search", [f"p{i}", f"q{i % 3}"], "kept") for i in range(90)]
        rows += [(None, first + 90, "2026-01-01 00:00:00", None, ["p1"], None), ("hot", first + 91, "2026-01-01 00:00:00", None, None, "none"), ("hot", first + 92, None, None, [], "empty")]
        df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(src))

    def suppressed(first, ttl_ms):
        out = str(tmp_path / f"out{ttl_ms}")
        run(jobs.suppress(spark.readStream.schema(schema).parquet(str(src)), out, str(tmp_path / f"cp{ttl_ms}"), ttl_ms=ttl_ms))
        log = jobs.read_batches(spark, out, "decisions").where(F.col("prompt_id").between(first, first + 99))
        assert log.where("note = 'kept'").count() == 90
        return {r.prompt_id - first for r in log.collect() if r.suppressed}

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    add(0)
    assert suppressed(0, 3_600_000) == suppressed(0, 1) == set()
    add(100)
    # What was shown outlives a micro-batch, unless its time is over.
    assert suppressed(100, 3_600_000) == {*range(91)}
    assert suppressed(100, 1) == set()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    parts = spark.read.parquet(str(tmp_path / "out1" / "shown")).where("session_id = 'hot'").select("part").distinct().count()
    assert parts > 20


def test_suppression_state_is_shared_by_small_sessions(spark, tmp_path):
    class Seen(dict):
        asked = 0

        def exists(self):
            return bool(self)

        def containsKey(self, key):
            self.asked += 1
            return key in self

        updateValue = dict.__setitem__

    first, seen = jobs.FirstShown(0), Seen()
    first.seen = seen
    row = Row("session_id", "path", "ts")
    mark = lambda *pairs: [r.unseen for r in first.handleInputRows((0,), iter([row(s, p, None) for s, p in pairs]), None)]
    assert mark(("a", "x"), ("b", "x"), (None, "x"), ("a", "x"), ("a", None)) == [True, True, True, True, False]
    assert seen.asked == 0
    assert mark(("b", "x"), ("b", "x"), ("b", "y"), (None, "x"), (None, "y")) == [False, False, True, False, True]
    assert seen.asked == 4

    # Many sessions meet in as many keys as there are, one session and prompts without a path in many.
    schema = "session_id string, prompt_id int, ts string, method string, injected array<string>"
    rows = [(f"s{i}", i, "2026-01-01 00:00:00", "tag_search", [f"p{i % 7}"]) for i in range(400)]
    rows += [("hot", 1000 + i, "2026-01-01 00:00:00", "tag_search", [] if i % 2 else [f"p{i}"]) for i in range(200)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(src)
    run(jobs.suppress(spark.readStream.schema(df.schema).parquet(src), out, str(tmp_path / "cp")))
    shown = spark.read.parquet(f"{out}/shown")
    keys = lambda cond: shown.where(cond).select("part").distinct().count()
    assert keys("session_id = 'hot' AND path IS NULL") > 50 and keys("session_id = 'hot' AND path IS NOT NULL") > 50
    assert shown.agg(F.max("part")).first()[0] < jobs.SEEN_PARTS and shown.where("unseen").count() == 500
    assert jobs.read_batches(spark, out, "decisions").where("suppressed").count() == 0


def test_capture_stream_resumes_a_session(spark, tmp_path):
    src = tmp_path / "in"
    schema = "session_id string, cwd string, pos int, line string"

    def line(i, ts):
        return ("sess-1234", "/w/app", i, json.dumps({"type": "user", "timestamp": ts, "message": {"content": f"message with words {i}"}}))

    m = spark.createDataFrame([("app", "main")], "slug string, vault_id string")
    none = spark.createDataFrame([], "path string, created string")
    first = [line(i, f"2026-01-02T00:0{i}:00Z") for i in range(3, 7)]
    late = [line(i, f"2026-01-01T00:0{i}:00Z") for i in range(0, 3)]
    seen = []
    for b in (first, late):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        run(jobs.capture_sessions(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
        notes = jobs.captured_notes(spark, str(tmp_path / "out"), m, none, "2026-01-03 00:00:00").collect()
        seen.append(notes)
    assert seen[0] == []  # four messages are too few
    n = seen[1][0]
    assert n.created == "2026-01-01T00:00:00.000Z"
    assert n.raw.index("words 0") < n.raw.index("words 6")


def test_work_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    made = work_dir(spark, "x")
    assert made != work_dir(spark, "x")
    assert root is None or made.startswith(root)
