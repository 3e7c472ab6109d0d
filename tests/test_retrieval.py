import random

import numpy as np
import pytest
from conftest import note
from pyspark.sql import functions as F

from quillspark.operators import blockmax, context, fusion, ivf, keyword, routing, vector
from quillspark.plans import search

NOW = "2026-08-01 00:00:00"


def ranked(vault, spark, files, query, **opt):
    notes = vault(files)
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    hits = keyword.search(keyword.build_index(notes), q, NOW, **opt)
    return [r.path for r in hits.orderBy("rank").collect()]


def test_title_beats_tags_beats_content(vault, spark):
    files = {
        "c.md": note("Other", (), "about widget things"),
        "b.md": note("Other", ("widget",), "about things"),
        "a.md": note("Widget", (), "about things"),
    }
    assert ranked(vault, spark, files, "widget") == ["a.md", "b.md", "c.md"]


def test_folder_tag_and_limit(vault, spark):
    files = {
        "x/a.md": note("Alpha", ("type/note",), "topic words"),
        "x/y/b.md": note("Alpha", ("type/brief",), "topic words"),
        "xy/c.md": note("Alpha", ("type/brief",), "topic words"),
    }
    assert set(ranked(vault, spark, files, "alpha", folder="x")) == {"x/a.md", "x/y/b.md"}
    assert set(ranked(vault, spark, files, "alpha", tags=("TYPE/brief",))) == {"x/y/b.md", "xy/c.md"}
    assert len(ranked(vault, spark, files, "alpha", limit=1)) == 1
    assert ranked(vault, spark, files, "zebra") == []


def test_prefix_and_fuzzy_reach(vault, spark):
    files = {"a.md": note("Authentication", (), "x"), "b.md": note("Unrelated", (), "y")}
    assert ranked(vault, spark, files, "auth") == ["a.md"]
    assert ranked(vault, spark, files, "authentication") == ["a.md"]
    assert ranked(vault, spark, files, "autentication") == ["a.md"]  # one letter short
    assert ranked(vault, spark, files, "autentication", expand=False) == []


def test_age_and_type_boosts(vault, spark):
    body = "same words here"
    fresh = {"new.md": (note("T", (), body), "2026-08-01"), "old.md": (note("T", (), body), "2026-05-01")}
    assert ranked(vault, spark, fresh, "words") == ["new.md", "old.md"]
    digest = {
        "sessions/digests/d.md": (note("T", ("type/digest",), body), "2026-05-01"),
        "plain.md": (note("T", ("type/plain",), body), "2026-05-01"),
    }
    assert ranked(vault, spark, digest, "words")[0] == "sessions/digests/d.md"
    both = {
        "sessions/s.md": (note("T", ("type/session",), body), "2026-07-01"),
        "n.md": (note("T", ("type/nothing",), body), "2026-07-01"),
    }
    assert ranked(vault, spark, both, "words") == ["n.md", "sessions/s.md"]

    notes = vault(both)
    q = spark.createDataFrame([(1, "words")], "query_id int, query string")
    ix = keyword.build_index(notes)
    low = keyword.search(ix, q, NOW).where("path like 'sessions/%'").first().score
    asked = keyword.search(ix, q, NOW, tags=("type/session",)).first().score
    assert asked == pytest.approx(low / 0.3, rel=1e-4)


def test_session_demotion_lifted_by_row_tags(vault, spark):
    notes = vault({"sessions/s.md": note("T", ("type/session",), "words")})
    ix = keyword.build_index(notes)
    q = spark.createDataFrame(
        [(1, "words", ["type/session"], None), (2, "words", None, None), (3, "words", None, "kb")],
        "query_id int, query string, tags array<string>, folder string",
    )
    s = {r.query_id: r.score for r in keyword.search(ix, q, NOW).collect()}
    assert set(s) == {1, 2} and s[2] == pytest.approx(s[1] * 0.3, rel=1e-4)


def test_hand_computed_score(vault, spark):
    """One term, one field, two notes: BM25+ with unique-term field length, times coverage."""
    notes = vault({"a.md": note("x", (), "foo foo bar"), "b.md": note("y", (), "baz")}, modified="2026-07-15")
    q = spark.createDataFrame([(1, "foo bar")], "query_id int, query string")
    got = keyword.search(keyword.build_index(notes), q, NOW, expand=False).first().score
    idf = np.log(1 + (2 - 1 + 0.5) / (1 + 0.5))
    norm = 1.2 * (0.3 + 0.7 * 2 / 1.5)
    want = 2 * sum(idf * (0.5 + tf * 2.2 / (tf + norm)) for tf in (2, 1))
    assert got == pytest.approx(want, abs=1e-5)


def test_fuzzy_against_brute_force(spark):
    words = ["kubernetes", "kubernets", "kubernettes", "kuber", "cat", "cut", "at", "cats", "authentication",
             "authentcation", "autentcation", "uthentication", "authenticationx", "xy", "tokenizer", "tokeniser", "tkoenizer"]
    df = spark.createDataFrame([(w,) for w in words], "term string")
    src = df.select(F.col("term").alias("source_term"))
    got = {(r.source_term, r.term, r.distance) for r in keyword.fuzzy_matches(src, df).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, cb in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (ca != cb))
        return row[-1]

    want = {(a, b, lev(a, b)) for a in words for b in words if a != b and lev(a, b) <= min(6, int(len(a) * 0.2 + 0.5))}
    assert got == want


def test_update_equals_rebuild(vault, spark):
    v1 = vault({"a.md": "alpha beta", "b.md": "beta gamma", "c.md": "gone words"})
    v2 = vault({"a.md": "alpha beta", "b.md": "beta delta delta", "d.md": "new gamma"})
    changed = v2.where("path in ('b.md', 'd.md')")
    removed = spark.createDataFrame([("c.md",)], "path string")
    got = keyword.update_index(keyword.build_index(v1), changed, removed, v2)
    want = keyword.build_index(v2)
    for name in ("postings", "dictionary", "field_stats", "docs"):
        a, b = got.tables()[name], want.tables()[name]
        cols = sorted(b.columns)
        rows = lambda d: sorted(map(str, d.select(*cols).collect()))  # noqa: E731, B023
        assert rows(a) == rows(b), name


def test_update_shuffles_no_postings(vault, spark, capsys):
    v1 = vault({"a.md": "alpha beta alpha", "b.md": "beta gamma", "c.md": "gone words"})
    # Paths may come twice or be missing: their words are counted together, as without the shuffle by path.
    odd = v1.unionByName(v1.where("path = 'a.md'")).unionByName(v1.where("path = 'b.md'").withColumn("path", F.lit(None).cast("string")))
    rows = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    for name, table in keyword.build_index(odd, parts=3).tables().items():
        assert rows(table) == rows(keyword.build_index(odd).tables()[name]), name
    changed, removed = odd.where("path = 'a.md'"), v1.where("path = 'c.md'").select("path")
    new = keyword.update_index(keyword.build_index(odd, parts=3), changed, removed, odd)
    before = keyword.update_index(keyword.build_index(odd), changed, removed, odd)
    assert rows(new.postings) == rows(before.postings) and rows(new.dictionary) == rows(before.dictionary)
    new.postings.agg(F.sum("tf_content")).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(path" in plan and not [x for x in plan.split("hashpartitioning(")[1:] if "term" in x.split(")")[0]]
    assert "SortMergeJoin" not in plan


def test_snapshot_diff(spark):
    t = "path string, modified_at string, size long"
    known = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("e", "1", 1)], t)
    disk = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("d", "1", 1), ("e", "1", 2)], t)
    got = {r.path: r.change for r in keyword.snapshot_diff(known, disk).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added", "e": "changed"}


# --- fusion ----------------------------------------------------------------------------------------


def lists(spark, *paths):
    return [
        spark.createDataFrame([(1, p, i + 1) for i, p in enumerate(ps)], "query_id int, path string, rank int")
        for ps in paths
    ]


def fused(df):
    return [r.path for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    assert fused(fusion.fuse(lists(spark, ["a", "b", "c"], ["b", "d"])))[0] == "b"
    assert fused(fusion.fuse(lists(spark, ["z"], ["a"]))) == ["a", "z"]
    a, b = lists(spark, ["sessions/x", "kb"], ["sessions/x", "kb"])
    assert fused(fusion.fuse([a, b], weight=fusion.path_weight())) == ["kb", "sessions/x"]
    pins = spark.createDataFrame([(1, "c", 1), (1, "nope", 2)], "query_id int, path string, pin_ord int")
    assert fused(fusion.fuse(lists(spark, ["a", "b", "c"]), pins=pins)) == ["c", "a", "b"]
    assert fused(fusion.fuse(lists(spark, ["a", "b", "c"]), pins=pins, limit=2)) == ["c", "a"]


# --- routing -------------------------------------------------------------------------------------------


def route(spark, topic, hits, mapping=None, **opt):
    topics = spark.createDataFrame([(1, topic)], "query_id int, topic string")
    top = spark.createDataFrame(
        [(1, p, s, i + 1) for i, (p, _, s) in enumerate(hits)], "query_id int, path string, score double, rank int"
    )
    titles = spark.createDataFrame([(p, t) for p, t, _ in hits], "path string, title string")
    m = spark.createDataFrame([(k, v) for k, v in (mapping or {}).items()], "keyword string, path string")
    return routing.route(topics, m, top, titles, **opt).first()


@pytest.mark.parametrize(
    ("topic", "hits", "mapping", "path", "method"),
    [
        (" JWT ", [], {"jwt": "./kb/auth.md"}, "kb/auth.md", "direct_map"),
        ("Auth Guide", [("a.md", "Auth guide", 9.0), ("b.md", "B", 8.9)], {}, "a.md", "exact_title"),
        ("auth tokens", [("a.md", "Auth", 9.0), ("b.md", "B", 3.0)], {}, "a.md", "tag_search"),
        ("auth tokens", [("a.md", "Auth", 3.9), ("b.md", "B", 1.0)], {}, None, "abstain"),
        ("auth tokens", [("a.md", "Auth", 9.0), ("b.md", "B", 8.0)], {}, None, "abstain"),
        ("auth tokens", [], {}, None, "abstain"),
        ("auth tokens", [("a.md", "Auth", 9.0)], {}, "a.md", "tag_search"),
        ("support phone", [("a.md", "Security", 9.0)], {}, None, "abstain"),
        ("support phone", [("a.md", "Security", 9.0)], {"phone book": "a.md"}, "a.md", "tag_search"),
        ("the brief please", [("brief-x.md", "X", 9.0)], {}, None, "abstain"),
        ("about hybrid", [("brief-hybrid.md", "X", 9.0)], {}, "brief-hybrid.md", "tag_search"),
    ],
)
def test_route(spark, topic, hits, mapping, path, method):
    r = route(spark, topic, hits, mapping)
    assert (r.path, r.method) == (path, method)


def test_brief_map(vault, spark):
    notes = vault(
        {
            "a-brief.md": note("A", ("type/brief",), keywords=["Login", "auth"]),
            "b-play.md": note("B", ("type/playbook",), keywords="deploy, auth"),
            "c-rej.md": note("C", ("type/rejected",), aliases=["graphql"]),
            "d-sess.md": note("D", ("type/session",), keywords=["ignored"]),
        }
    )
    fm = spark.createDataFrame([("login", "override.md"), ("empty", " ")], "keyword string, path string")
    got = {r.keyword: r.path for r in routing.build_map(routing.note_keywords(notes), fm).collect()}
    assert got == {"login": "override.md", "auth": "a-brief.md", "deploy": "b-play.md", "graphql": "c-rej.md"}


# --- vectors ---------------------------------------------------------------------------------------------


def test_nearest_both_ways_against_numpy(spark):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(7, 8)), rng.normal(size=(300, 8))
    c[5] = c[6]  # a tie
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<double>")
    cd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "item_id int, vector array<double>").repartition(5)
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    want = {
        (i, j, r + 1)
        for i in range(7)
        for r, j in enumerate(sorted(range(300), key=lambda j: (-round(s[i, j], 6), j))[:6])
    }
    for blocks in ({}, {"query_block": 3, "item_block": 50}):  # one block of queries; several of both sides
        got = {(r.query_id, r.item_id, r["rank"]) for r in vector.nearest(qd, cd, 6, **blocks).collect()}
        assert got == want


def _vectors(spark, rows, key, start=0):
    data = [(i + start, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, f"{key} long, vector array<double>")


def test_inverted_file(spark, tmp_path, monkeypatch):
    """60 clusters: few lists are probed, nine of ten neighbours found for each query; copies, hot vectors and missing vectors."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(60, 17))
    c = middle[rng.integers(0, 60, 3000)] + 0.15 * rng.normal(size=(3000, 17))
    c[1000:2000] = c[999]  # a third of the rows is one vector
    rows = [*c, None, np.zeros(17)]
    items = _vectors(spark, rows, "item_id").repartition(6)
    asked = [*c[::20], None, np.zeros(17)]
    queries = _vectors(spark, asked, "query_id").repartition(3)
    index = ivf.publish(items, str(tmp_path / "v"), k=10)
    assert index.codes.count() == 3001
    assert index.model.probes <= len(index.model.centroids) // 4
    assert ivf.load(spark, str(tmp_path / "v")).model.probes == index.model.probes
    exact = {}
    for r in vector.nearest(queries.where("vector is not null"), items.where("vector is not null"), 10).collect():
        exact.setdefault(r.query_id, {})[r.item_id] = r.score
    found = {}
    for r in ivf.search(index, queries, items, 10).collect():
        found.setdefault(r.query_id, {})[r.item_id] = r.score
    assert len(exact) == 151 and 150 not in found
    for q, near in exact.items():
        assert len(found[q]) == 10
        if q < 150:
            assert len(near.keys() & found[q].keys()) >= 9, q
    assert set(found[50]) == set(exact[50]) == set(range(999, 1009))  # ties of the hot vector go to the smaller ids
    # Cutting lists and queries into pieces changes nothing.
    monkeypatch.setattr(ivf, "PIECE", 37)
    monkeypatch.setattr(ivf, "ASKED", 4)
    again = {(r.query_id, r.item_id, r.score) for r in ivf.search(index, queries, items, 10).collect()}
    assert again == {(q, i, s) for q, near in found.items() for i, s in near.items()}


def test_inverted_file_of_few_rows(spark, tmp_path):
    assert ivf.publish(_vectors(spark, [], "item_id"), str(tmp_path / "none")) is None
    assert ivf.publish(_vectors(spark, [None], "item_id"), str(tmp_path / "null")) is None
    items = _vectors(spark, [[1, 0, 0], [0, 1, 0]], "item_id")
    index = ivf.publish(items, str(tmp_path / "two"))
    got = ivf.search(index, _vectors(spark, [[2, 0.1, 0]], "query_id"), items, 5).orderBy("rank").collect()
    assert [r.item_id for r in got] == [0, 1] and got[0].score == 0.998752
    assert ivf.search(index, _vectors(spark, [], "query_id"), items, 5).count() == 0


def test_embedding_cache(vault, spark):
    notes = vault({"a.md": "# A\n\nx\n\n## S\n\nbody", "b.md": "# B\n\nother"})

    def embed(texts):
        return [np.array([float(len(t)), 1.0]) for t in texts]

    chunks = vector.chunk_table(notes)
    vecs = vector.embed_new(chunks, None, embed)
    assert vecs.count() == 3
    again = chunks.select("hash").distinct().join(vecs, "hash", "left_anti")
    assert again.count() == 0
    edited = vault({"a.md": "# A\n\nx\n\n## S\n\nchanged"})
    now = vector.update_chunks(vector.embedded_chunks(chunks, vecs), edited, spark.createDataFrame([("b.md",)], "path string"), embed)
    rows = now.orderBy("path", "chunk_ix").collect()
    assert [(r.path, r.heading) for r in rows] == [("a.md", ""), ("a.md", "S")]
    assert rows[1].text.endswith("changed")


def test_semantic_search_and_dedupe(vault, spark):
    notes = vault({"a.md": "# A\n\nred green\n\n## S\n\nred red", "b.md": "# B\n\nblue"})
    c = vector.chunk_table(notes)
    emb = vector.embedded_chunks(c, vector.embed_new(c, None, vector.hash_embedder()))
    q = spark.createDataFrame([(1, "red")], "query_id int, text string")
    hits = vector.semantic_search(q, emb, vector.hash_embedder(), 3)
    assert hits.where("rank = 1").first().path == "a.md"
    per_note = vector.first_hit_per_note(hits).orderBy("rank").collect()
    assert [r.path for r in per_note] == ["a.md", "b.md"]


# --- recall ------------------------------------------------------------------------------------------------

RECALL = {
    "02/brief-hybrid.md": note("Hybrid retrieval", ("type/brief",), "# Hybrid retrieval\n\n" + "fusion of ranked lists. " * 40 + "\n\n## Detail\n\n" + "x " * 300, keywords=["rrf"]),
    "sessions/2026/s.md": note("tables session", ("type/session",), "hybrid fusion lists discussed"),
    "kb/note.md": note("Ranked lists", ("type/note",), "ranked lists and fusion weights for retrieval"),
}


def recall(vault, spark, prompts, **opt):
    notes = vault(RECALL, modified="2026-08-20")
    ix = keyword.build_index(notes)
    m = routing.build_map(routing.note_keywords(notes))
    p = spark.createDataFrame(list(enumerate(prompts)), "query_id int, prompt string")
    out = search.recall_prompts(ix, notes, p, m, "2026-09-07 00:00:00", **opt)
    return {r.query_id: r for r in out.collect()}


def test_recall_tiers(vault, spark):
    r = recall(vault, spark, ["rrf", "how are ranked lists combined here", "what should the weather be tomorrow", "ok"])
    assert (r[0].tier, r[0].reason) == ("none", "not eligible")
    assert r[1].tier in ("brief", "hits") and all(not p.startswith("sessions/") for p in r[1].injected)
    assert r[2].tier == "none" and r[2].text is None
    assert r[3].reason == "not eligible"


def test_recall_brief_is_cut_to_budget(vault, spark):
    r = recall(vault, spark, ["hybrid retrieval of ranked fusion"], budget_tokens=200)[0]
    if r.tier == "brief":
        assert len(r.text) <= 800 and "Truncated" in r.text
    off = recall(vault, spark, ["hybrid retrieval of ranked fusion"], mode="off")[0]
    assert off.tier == "none"


def test_vocabulary_and_content_gate(vault, spark):
    notes = vault(RECALL)
    m = spark.createDataFrame([("rrf", "02/brief-hybrid.md")], "keyword string, path string")
    words = {r.token for r in context.domain_vocabulary(notes, m).collect()}
    assert {"hybrid", "rrf", "ranked"} <= words and "tables" not in words and "brief" not in words
    p = spark.createDataFrame(
        [(1, "the hybrid one"), (2, "fusion weights now"), (3, "only fusion here"), (4, "nothing at all")], "query_id int, prompt string"
    )
    pairs = p.select("query_id", F.lit("kb/note.md").alias("path")).unionByName(p.select("query_id", F.lit("02/brief-hybrid.md").alias("path")))
    by_regex = (
        pairs.join(p, "query_id").join(notes.select("path", "title", "content"), "path")
        .where(context.shares_content(F.col("prompt"), F.col("title"), F.col("content")))
        .select("query_id", "path")
    )
    by_join = context.shares_content_by_tokens(p, pairs, notes)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(by_regex) == rows(by_join) == [(1, "02/brief-hybrid.md"), (2, "kb/note.md")]


def test_suppression(spark):
    rows = [
        ("s", 1, "2026-01-01 00:00:01", "tag_search", ["a", "b"]),
        ("s", 2, "2026-01-01 00:00:02", "tag_search", ["a", "b"]),
        ("s", 3, "2026-01-01 00:00:03", "tag_search", ["a", "c"]),
        ("s", 4, "2026-01-01 00:00:04", "direct_map", ["a"]),
        ("t", 5, "2026-01-01 00:00:05", "tag_search", ["a"]),
        ("s", 6, "2026-01-01 00:00:06", "abstain", []),
    ]
    d = spark.createDataFrame(rows, "session_id string, prompt_id int, ts string, method string, injected array<string>")
    got = {r.prompt_id: r.suppressed for r in context.suppress_repeats(d).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_context_assembly(vault, spark):
    notes = vault(
        {
            "small.md": note("Small", (), "tiny"),
            "big.md": note("Big", (), "intro\n\n## One\n\n" + "a" * 1500 + "\n\n## Two\n\n" + "b" * 3000),
        }
    )
    routed = spark.createDataFrame(
        [(1, 0, "s", "small.md"), (1, 1, "b", "big.md"), (1, 2, "dup", "small.md"), (1, 3, "none", None), (1, 4, "gone", "missing.md"), (2, 0, "none", None)],
        "request_id int, topic_ix int, topic string, path string",
    )
    r = {x.request_id: x for x in context.assemble(routed, notes, max_tokens=500).collect()}
    assert [p.path for p in r[1].resolved] == ["small.md", "big.md"]
    assert r[1].not_found == ["none", "gone"]
    assert r[1].total_chars <= 2000 and "Truncated to fit" in r[1].text
    assert r[1].text.startswith("---\n# Small\n\ntiny\n\n---\n# Big")
    assert r[1].text.endswith("*No briefs found for: none, gone. Try a search for these topics.*")
    assert r[2].text == "" and r[2].not_found == ["none"]


# --- stored index ---------------------------------------------------------------------------------


def test_stored_index_gives_the_hits_of_the_plain_one(spark, tmp_path):
    rnd = random.Random(8)
    words = "rank fusion ranking fusions vector vectors session sessions archive note notes index".split()
    rows = []
    for i in range(90):
        body = " ".join(rnd.choice(words) + rnd.choice(["", "", "x", "s"]) for _ in range(rnd.choice([0, 3, 12, 60])))
        kind = rnd.choice(["type/brief", "type/session", "type/digest", "type/note"])
        rows.append((f"{rnd.choice(['kb', 'kb/sub', 'sessions'])}/n{i}.md", f"{rnd.choice(words)} {i % 7}", [kind, "topic/" + rnd.choice("ab")], body, f"2026-0{rnd.randrange(1, 9)}-03 00:00:00"))
    df = spark.createDataFrame(rows, "path string, title string, tags array<string>, content string, created_at string")
    notes = df.withColumn("created_at", F.col("created_at").cast("timestamp"))
    plain = keyword.build_index(notes)
    stored = blockmax.publish(notes, str(tmp_path), shards=3, notes_per_range=4)
    asked = [(1, "rank fusion rank", None, None), (2, "sesion archve", ["type/session"], None), (3, "ve", None, "kb/"), (4, "nothing that is there", [], "kb"), (5, "", None, None)]
    full = spark.createDataFrame(asked, "query_id long, query string, tags array<string>, folder string")
    cases = [(full, {}, 2), (full, {"folder": "kb", "expand": False}, 100), (full.drop("tags", "folder"), {"tags": ("type/brief",), "expand": False}, 2)]
    for queries, options, block in [*cases, (full.drop("tags", "folder"), {"expand": False, "params": keyword.KeywordParams.textbook()}, 100)]:
        want = sorted(map(tuple, keyword.search(plain, queries, NOW, limit=3, **options).collect()))
        assert sorted(map(tuple, stored.search(queries, NOW, limit=3, query_block=block, **options).collect())) == want
    terms = sorted((r.term, r.df_title, r.df_tags, r.df_content) for r in stored.dictionary.collect())
    assert terms == sorted((r.term, r.df_title, r.df_tags, r.df_content) for r in plain.dictionary.collect())
    assert blockmax.load(spark, str(tmp_path)).search(full, NOW, limit=3, expand=False).count() > 0


def test_stored_search_shuffles_no_matches(spark, tmp_path):
    notes = spark.createDataFrame([(f"kb/n{i}.md", "rank", ["type/note"], "fusion " * i) for i in range(20)], "path string, title string, tags array<string>, content string")
    stored = blockmax.publish(notes.withColumn("created_at", F.lit("2026-01-01").cast("timestamp")), str(tmp_path), shards=4)
    asks, small = stored._asks(["fusion", "rank"], False, keyword.DEFAULT, {f: (20, 1.0) for f in keyword.FIELD_BOOSTS})
    met = stored.blocks.join(F.broadcast(asks), "term").groupBy("shard").count()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert small and "Exchange hashpartitioning(shard" not in plan


def test_ranges_that_cannot_reach_the_best_hits_stay_closed():
    def shard(counts):
        import pyarrow as pa

        docs = [[{"doc": d, "tf_title": 0, "tf_tags": 0, "tf_content": counts[d]} for d in range(r, r + 4) if counts[d]] for r in range(0, 40, 4)]
        left = pa.table({
            "term": ["fusion"] * 10, "range": pa.array(range(10), pa.int32()), "docs": docs,
            **{f"{b}_{f}": pa.array([0] * 10 if f != "content" else [max(counts[r : r + 4]) if b == "max" else 5 for r in range(0, 40, 4)], pa.int32()) for b in ("max", "least") for f in blockmax.FIELDS},
            "asks": [[{"sid": 0, "w_title": 1.0, "w_tags": 1.0, "w_content": 1.0}]] * 10,
        })
        n = range(40)
        right = pa.table({
            "doc": pa.array(n, pa.int32()), "path": [f"p{i:02}" for i in n], "allowed": [True] * 40, "boost": [1.0] * 40, "boost_asked": [1.0] * 40,
            **{f"len_{f}": pa.array([5] * 40, pa.int32()) for f in blockmax.FIELDS},
        })
        return blockmax._Shard(left, right, dict.fromkeys(blockmax.FIELDS, 5.0), keyword.DEFAULT, 4)

    one = shard([1] * 36 + [9, 9, 9, 9])
    query = blockmax._Query(1, np.array([0]), np.array([1.0]), None, None, False)
    assert [path for _, path, _ in one.search([query], 4, 1)] == ["p36", "p37", "p38", "p39"]
    assert one.opened == 1


def test_near_spellings_against_all_pairs(spark):
    rnd = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    asked = {"".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 13, 18, 24, 30]))) for _ in range(30)}
    known = set()
    for word in asked:
        for _ in range(30):
            letters = list(word)
            for _ in range(rnd.randrange(8)):
                at, edit = rnd.randrange(len(letters) + 1), rnd.randrange(3)
                letters[at : at + (edit > 0)] = [] if edit == 1 else [rnd.choice("abcdé")]
            known.add("".join(letters) or "x")
    want = {(a, b, d) for a in asked for b in known if 0 < (d := distance(a, b)) <= min(6, int(len(a) * 0.2 + 0.5))}
    words, terms = (spark.createDataFrame([(w,) for w in sorted(x)], f"{n} string") for x, n in ((asked, "source_term"), (known, "term")))
    for parts in (None, keyword.spelling_parts(terms)):
        assert set(map(tuple, keyword.fuzzy_matches(words, terms, parts=parts).collect())) == want


def test_the_dictionary_is_not_broadcast_as_prefixes(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(w,) for w in ("rank", "ranking", "ranked", "note")], "term string").write.parquet(f"{tmp_path}/t")
    terms, words = spark.read.parquet(f"{tmp_path}/t"), spark.createDataFrame([("rank",), ("n",)], "source_term string")
    want = {("rank", "ranking"), ("rank", "ranked"), ("n", "note")}
    for bound in (100, 0):
        monkeypatch.setattr(keyword, "BROADCAST_WORDS", bound)
        out = keyword.prefix_matches(words, terms)
        assert {tuple(r) for r in out.collect()} == want
        sent = out._jdf.queryExecution().sparkPlan().toString()
        assert ("SortMergeJoin" if bound == 0 else "BroadcastHashJoin") in sent and "BuildLeft" not in sent


def test_blocks_of_a_shard_are_counted_as_arrays(spark, tmp_path, monkeypatch):
    body = ["rank fusion rank", "", None, "ranking notes"]
    rows = [(f"kb/n{i}.md", None if i % 5 == 0 else f"rank {i}", ["type/note"], body[i % 4]) for i in range(40)]
    notes = spark.createDataFrame(rows, "path string, title string, tags array<string>, content string").withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    labels = blockmax.shard_labels(spark, 3)
    plan = blockmax.blocks(notes, labels, 4)._jdf.queryExecution().sparkPlan().toString()
    assert "collect_list" not in plan and plan.count("Generate") == 0
    plain, stored = keyword.build_index(notes), blockmax.publish(notes, str(tmp_path), shards=3, notes_per_range=4)
    columns = ["path", "term", *[f"tf_{f}" for f in blockmax.FIELDS]]
    assert sorted(map(tuple, stored.postings.select(*columns).collect())) == sorted(map(tuple, plain.postings.select(*columns).collect()))
    # More asked words than are broadcast: the same hits by a shuffle.
    monkeypatch.setattr(blockmax, "BROADCAST_ASKS", 0)
    asked = spark.createDataFrame([(1, "rank fusion"), (2, "rankin nots")], "query_id long, query string")
    want = sorted(map(tuple, keyword.search(plain, asked, NOW, limit=4).collect()))
    assert sorted(map(tuple, stored.search(asked, NOW, limit=4).collect())) == want


def test_small_blocks_cost_no_copies_of_the_items(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    queries = spark.createDataFrame(rows[::2], "query_id long, vector array<double>")
    out = vector.nearest(queries, items, 5, query_block=3, item_block=7)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, vector.nearest(queries, items, 5).collect()))
    copies = vector._block_join(queries, items, 5, "query_id long, item_id long, score double", 3, 7)
    # Few queries are one tile, however small the blocks: no item is copied.
    assert "sequence(0, 0, " in copies._jdf.queryExecution().analyzed().toString().replace("cast(0 as bigint)", "0")


def test_offline_embedder_counts_signed_words():
    import hashlib

    import pandas as pd

    texts = ["rank fusion rank", "", None, "vector note vector rank " * 20]
    embed = vector.hash_embedder(16)
    for _ in range(2):  # words met before have the same place
        got = embed(pd.Series(texts))
        for t, v in zip(texts, got, strict=True):
            want = np.zeros(16)
            for w in (t or "").split():
                h = hashlib.md5(w.encode()).hexdigest()
                want[int(h[:4], 16) % 16] += 1.0 if int(h[4], 16) < 8 else -1.0
            assert np.allclose(v, want / (np.linalg.norm(want) or 1.0))
    assert vector.KEPT_WORDS > 0
