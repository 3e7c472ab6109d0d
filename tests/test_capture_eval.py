import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers, capture, evals

NOW = "2026-09-07 12:00:00"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def transcript(spark, sessions):
    data = []
    for sid, cwd, lines in sessions:
        for i, ln in enumerate(lines):
            data.append((sid, cwd, i, ln if isinstance(ln, str) else json.dumps(ln)))
    return spark.createDataFrame(data, "session_id string, cwd string, pos int, line string")


def user(text, ts=None):
    return {"type": "user", "timestamp": ts, "message": {"content": text}}


def bot(*blocks, ts=None):
    return {"type": "assistant", "timestamp": ts, "message": {"content": list(blocks)}}


def tool(name, **inp):
    return {"type": "tool_use", "name": name, "input": inp}


MAIN = [
    {"type": "ai-title", "aiTitle": "Fix the login"},
    user("Please fix the login flow <b>now</b>", "2026-09-06T23:59:00Z"),
    bot({"type": "text", "text": "ok"}, tool("Edit", file_path="src/a.py"), tool("Bash", command="ls -la")),
    "{broken",
    user("yes", "2026-09-06T22:10:00Z"),
    bot(tool("Bash", command="make test NEON_API_KEY=abc123def456"), tool("Edit", file_path="src/a.py"), tool("Write", file_path="src/b.py")),
    user("the second thing to look at is here", "nope"),
    user([{"type": "tool_result", "content": "x"}]),
    bot({"type": "text", "text": "done"}),
]
PROJECTS = [("app", "main"), ("closed", None)]


def test_capture(spark):
    t = transcript(
        spark,
        [
            ("12345678-aaaa", "/home/u/app/worktrees/feat-x", MAIN),
            ("tiny0000-x", "/home/u/app", [user("hello there friend")]),
            ("lost0000-x", "/home/u/elsewhere", MAIN),
        ],
    )
    m = spark.createDataFrame(PROJECTS, "slug string, vault_id string")
    none = spark.createDataFrame([], "path string, created string")
    got = capture.session_notes(t, m, none, NOW).collect()
    assert len(got) == 1
    n = got[0]
    assert n.path == "sessions/2026/09-07/feat-x-12345678.md" and n.vault_id == "main"
    assert n.created == "2026-09-06T22:10:00.000Z" and n.is_new
    assert "NEON_API_KEY=[REDACTED]" in n.raw and "abc123def456" not in n.raw
    assert "## Topics\n\n- Please fix the login flow now\n- the second thing to look at is here\n" in n.raw
    assert "## Files Changed\n\n- `src/a.py`\n- `src/b.py`\n" in n.raw
    assert "- `ls -la`" not in n.raw and "title: 'Fix the login'" in n.raw
    assert capture.capture_log(capture.session_notes(t, m, none, NOW), NOW).count() == 1

    known = spark.createDataFrame([("sessions/archive/2026/feat-x-12345678.md", "2026-01-01T00:00:00.000Z")], "path string, created string")
    again = capture.session_notes(t, m, known, "2026-09-08 12:00:00")
    a = again.first()
    assert (a.path, a.created, a.is_new) == ("sessions/archive/2026/feat-x-12345678.md", "2026-01-01T00:00:00.000Z", False)
    assert capture.capture_log(again, NOW).count() == 0


def test_title_fallbacks(spark):
    t = transcript(
        spark,
        [
            ("s1", "/a", [user("a first message long enough")] * 6),
            ("s2-abcdefgh", "/a", [user("short")] * 6),
        ],
    )
    f = capture.session_facts(capture.parse_lines(t)).select("session_id", capture.session_title().alias("t"))
    assert rows(f, "session_id", "t") == [("s1", "Session: a first message long enough"), ("s2-abcdefgh", "Session: s2-abcde")]


def test_topic_limits(spark):
    lines = [user(f"message number {i:03d} " + "x" * 120) for i in range(25)] + [user("a" * 12 + "-" + "0" * 12)]
    t = capture.topics(capture.parse_lines(transcript(spark, [("s", "/a", lines)]))).first().topics
    assert len(t) == 20 and t[0].startswith("message number 000") and t[0].endswith("...") and len(t[0]) == 103


def test_nearest_project(spark):
    cwds = spark.createDataFrame([("/w/app/sub/deep",), ("/w/other",), ("/w/closed/x",), ("/app/closed",)], "cwd string")
    m = spark.createDataFrame(PROJECTS, "slug string, vault_id string")
    got = {r.cwd: (r.slug, r.vault_id, r.matched) for r in capture.resolve_projects(cwds, m).collect()}
    assert got == {
        "/w/app/sub/deep": ("deep", "main", "app"),
        "/w/other": ("other", None, None),
        "/w/closed/x": ("x", None, None),
        "/app/closed": ("closed", "main", "app"),
    }
    d = m.unionByName(spark.createDataFrame([("_default", "rest")], "slug string, vault_id string"))
    got = {r.cwd: r.vault_id for r in capture.resolve_projects(cwds, d).collect()}
    assert got["/w/other"] == "rest" and got["/w/closed/x"] == "rest" and got["/w/app/sub/deep"] == "main"


def test_read_created(one):
    assert one(capture.read_created(F.col("c")), c="---\ncreated: '2026-01-01'\n---\n") == "2026-01-01"
    assert one(capture.read_created(F.col("c")), c="none") is None


# --- retrieval metrics ---------------------------------------------------------------------------------


def test_scores(spark):
    cases = spark.createDataFrame([("a", False), ("b", False), ("n", True), ("e", False)], "case_id string, negative boolean")
    expected = spark.createDataFrame([("a", "./x"), ("a", "y"), ("b", "z"), ("n", "x"), ("e", "q")], "case_id string, path string")
    ranked = spark.createDataFrame(
        [("kw", "a", "w", 1), ("kw", "a", "x", 2), ("kw", "b", "z", 1), ("kw", "b", "y", 2), ("kw", "b", "v", 9), ("kw", "n", "x", 1)],
        "mode string, case_id string, path string, rank int",
    )
    got = {r.case_id: r for r in evals.score_cases(cases, expected, ranked, 5, ("kw",)).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].rr) == (0.5, 0.5, 0.5)
    assert (got["b"].precision, got["b"].recall, got["b"].rr, got["b"].success) == (0.5, 1.0, 1.0, True)
    assert (got["n"].hits, got["n"].success) == (0, False)
    assert (got["e"].precision, got["e"].recall, got["e"].rr) == (0.0, 0.0, 0.0)
    agg = evals.aggregate_modes(evals.score_cases(cases, expected, ranked, 5, ("kw",))).first()
    assert (agg.n_cases, agg.n_positive, agg.recall, agg.mrr) == (4, 3, 0.5, 0.5)


def test_routing_metrics(spark):
    cases = spark.createDataFrame(
        [("a", False, "x"), ("b", False, "y"), ("c", False, None), ("n", True, None)],
        "case_id string, negative boolean, expected_brief string",
    )
    routes = spark.createDataFrame(
        [("a", "./x", "direct_map"), ("b", "x", "tag_search"), ("c", None, "abstain"), ("n", "z", "tag_search")],
        "query_id string, path string, method string",
    )
    hits = {r.case_id: r.routing_hit for r in evals.routing_hits(cases, routes).collect()}
    assert hits == {"a": True, "b": False, "c": True, "n": False}
    q = evals.routing_quality(cases, routes).first()
    assert (q.n_routed, q.wrong_routes, q.negative_accuracy, q.abstention) == (3, 2, 0.0, 0.25)
    assert q.precision == pytest.approx(1 / 3) and q.recall == pytest.approx(1 / 3)


def lcg_bootstrap(values, iters, seed):
    s, means = seed, []
    for _ in range(iters):
        total = 0.0
        for _ in values:
            s = (s * 1664525 + 1013904223) % 2**32
            total += values[int(s / 2**32 * len(values))]
        means.append(total / len(values))
    means.sort()
    return means[int(iters * 0.025)], means[int(iters * 0.975)]


def test_bootstrap_matches_the_sequential_generator(spark):
    data = {"g": [0.0, 1.0, 1.0, 0.0, 0.5, 1.0, 0.0], "h": [1.0] * 5}
    df = spark.createDataFrame([(g, i, v) for g, vs in data.items() for i, v in enumerate(vs)], "g string, i int, v double")
    got = {r.g: (r.lo, r.hi) for r in evals.bootstrap_ci(df, ["g"], "i", "v", iters=300).collect()}
    assert got["h"] == (1.0, 1.0)
    assert got["g"] == pytest.approx(lcg_bootstrap(data["g"], 300, 42))
    alone = evals.bootstrap_ci(df.where("g = 'g'"), [], "i", "v", iters=300).first()
    assert (alone.lo, alone.hi) == pytest.approx(got["g"])
    assert evals.bootstrap_ci(df.limit(0), ["g"], "i", "v").count() == 0


def weighted_bootstrap(keys, values, iters, seed):
    cdf = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(30)]
    states = [int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16) for k in keys]
    means = []
    for _ in range(iters):
        states = [(s * 1664525 + 1013904223) % 2**32 for s in states]
        w = [next(k for k, top in enumerate(cdf) if s < math.floor(top * 2**32)) for s in states]
        means.append(sum(a * b for a, b in zip(w, values)) / sum(w) if sum(w) else sum(values) / len(values))
    means.sort()
    return means[int(iters * 0.025)], means[int(iters * 0.975)]


def test_weighted_bootstrap_in_one_pass(spark):
    data = {"g": [0.0, 1.0, 1.0, 0.0, 0.5, 1.0, 0.0], None: [3.0], "many": [float(i % 2) for i in range(400)]}
    rows = [(g, i, v) for g, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame([*rows, ("g", 99, None)], "g string, i int, v double")
    out = evals.bootstrap_weighted(df, ["g"], "i", "v", iters=300)
    got = {r.g: (r.n, r.mean, r.lo, r.hi) for r in out.collect()}
    for g, vs in data.items():
        assert got[g][:2] == (len(vs), pytest.approx(sum(vs) / len(vs)))
        assert got[g][2:] == pytest.approx(weighted_bootstrap(range(len(vs)), vs, 300, 42))
    # As wide as the drawn intervals, and the sums are combined before the first exchange.
    drawn = {r.g: (r.lo, r.hi) for r in evals.bootstrap_ci(df.where("g = 'many'"), ["g"], "i", "v", iters=300).collect()}
    assert got["many"][2:] == pytest.approx(drawn["many"], abs=0.02)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    alone = evals.bootstrap_weighted(df.where("g = 'many'"), [], "i", "v", iters=300).first()
    assert tuple(alone) == pytest.approx(got["many"])
    assert evals.bootstrap_weighted(df.limit(0), ["g"], "i", "v").count() == 0
    assert evals.bootstrap_weighted(df.limit(0), [], "i", "v").count() == 0


def test_pin_harm(spark):
    cases = spark.createDataFrame([(i, False, "x") for i in (1, 2, 3)] + [(4, True, None)], "case_id int, negative boolean, expected_brief string")
    expected = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "case_id int, path string")
    routes = spark.createDataFrame([(1, "w"), (2, "w"), (3, "far"), (4, "w")], "query_id int, path string")
    t = "case_id int, path string, rank int"
    raw = spark.createDataFrame([(1, "x", 1), (1, "w", 2), (2, "y", 1), (2, "x", 2), (2, "w", 3), (3, "x", 1), (4, "w", 1)], t)
    pinned = spark.createDataFrame([(1, "w", 1), (1, "x", 2), (2, "w", 1), (2, "y", 2), (2, "x", 3), (3, "x", 1), (4, "w", 1)], t)
    got = {r.case_id: (r.wrong_route, r.applied, r.regression) for r in evals.pin_harm(cases, expected, routes, raw, raw, pinned, 2).collect()}
    assert got == {
        1: (True, True, "rank1_lost"),
        2: (True, True, "severe"),
        3: (True, False, "none"),
        4: (True, True, "none"),
    }


# --- answer quality --------------------------------------------------------------------------------------


def test_judge_output(spark):
    out = {
        "scores": [
            {"label": "A", "correctness": 5, "grounding": 1.6, "fabrication": -1, "abstained": False},
            {"label": "answer c", "correctness": 1, "grounding": 0, "fabrication": 1, "abstained": True},
            {"label": "Z", "correctness": 1, "grounding": 0, "fabrication": 0, "abstained": False},
        ],
        "ranking": ["Answer C", "A"],
        "reason": "r",
    }
    raw = spark.createDataFrame([("c1", 0, ["plugin", "bare", "recall"], json.dumps(out))], "case_id string, pass int, order array<string>, output string")
    j = answers.parse_judgments(raw).first()
    assert j.ranking == ["recall", "plugin", "bare"]
    assert set(j.scores) == {"plugin", "recall"}
    assert (j.scores["plugin"].correctness, j.scores["plugin"].grounding, j.scores["plugin"].fabrication) == (2, 2, 0)


def judged(spark):
    def sc(c, g, f, a=False):
        return {"correctness": c, "grounding": g, "fabrication": f, "abstained": a}

    rows_ = []
    ranks = {  # per case: two passes
        "c1": (["recall", "bare", "plugin"], ["recall", "bare", "plugin"]),
        "c2": (["recall", "bare", "plugin"], ["bare", "recall", "plugin"]),
        "c3": (["recall", "plugin", "bare"], ["plugin", "recall", "bare"]),
    }
    for cid, passes in ranks.items():
        for p, ranking in enumerate(passes):
            scores = {"bare": sc(0, 0, 1), "recall": sc(2, 2, 0, True), "plugin": sc(1, 1, 1)}
            rows_.append((cid, p, ranking, scores, f"{cid}-{p}"))
    t = "case_id string, pass int, ranking array<string>, scores map<string,struct<correctness:int,grounding:int,fabrication:int,abstained:boolean>>, reason string"
    return spark.createDataFrame(rows_, t)


def test_outcomes_and_summary(spark):
    j = judged(spark)
    cases = spark.createDataFrame([("c1", "f", False), ("c2", "f", False), ("c3", "g", True)], "id string, stratum string, negative boolean")
    out = {(r.case_id, r.condition): r.outcome for r in answers.case_outcomes(j).collect()}
    assert [out[c, "recall"] for c in ("c1", "c2", "c3")] == ["win", "tie", "win"]
    assert [out[c, "plugin"] for c in ("c1", "c2", "c3")] == ["loss", "loss", "win"]
    assert out["c1", "bare"] is None
    ans = spark.createDataFrame(
        [("c1", "recall", 10, 0.5, None), ("c2", "recall", 30, None, None), ("c3", "plugin", 5, 0.1, "boom")],
        "case_id string, condition string, latency_ms int, cost_usd double, error string",
    )
    s = {r.condition: r for r in answers.condition_summary(cases, ans, j, iters=100).collect()}
    assert (s["recall"].wins, s["recall"].ties, s["recall"].losses) == (2, 1, 0)
    assert (s["plugin"].wins, s["plugin"].losses, s["plugin"].fabrication_rate, s["plugin"].errors) == (1, 2, 1.0, 1)
    assert s["recall"].win_rate == pytest.approx(2 / 3) and s["recall"].negative_abstain_rate == 1.0
    assert (s["recall"].mean_latency_ms, s["recall"].mean_cost_usd, s["recall"].fully_correct_rate) == (20.0, 0.5, 1.0)
    assert (s["bare"].win_rate, s["bare"].lo, s["bare"].n) == (0.0, 0.0, 3)
    strata = {(r.stratum, r.condition): r for r in answers.stratum_summary(cases, answers.case_outcomes(j)).collect()}
    assert strata["f", "recall"].win_rate == 0.5 and strata["f", "bare"].win_rate is None and strata["g", "recall"].n == 1
    lost = answers.losses(cases, answers.case_outcomes(j), j)
    assert rows(lost, "case_id", "lost", "reason") == [("c1", ["plugin"], "c1-0"), ("c2", ["plugin"], "c2-0")]


def test_plans_orders_and_prompts(spark):
    t = "id string, question string, gold string, negative boolean, notes string, draft boolean"
    cases = spark.createDataFrame([("a", "Q?", "G", False, None, None), ("d", "Q", "G", True, "n", True), ("n", "Q", "G", True, "hint", False)], t)
    kept = answers.select_cases(cases)
    assert rows(kept, "id") == [("a",), ("n",)]
    assert answers.select_cases(cases, True, ["d"]).count() == 1 and answers.select_cases(cases, limit=1).count() == 1
    plan = answers.answer_plan(kept)
    cached = spark.createDataFrame([("a", "bare", None), ("a", "recall", "x")], "case_id string, condition string, error string")
    todo = answers.pending(plan, cached, ["case_id", "condition"])
    assert plan.count() == 6 and todo.count() == 5 and ("a", "recall") in rows(todo, "case_id", "condition")
    o1 = rows(answers.shown_order(answers.judge_plan(kept, 3)), "case_id", "pass", "order")
    assert o1 == rows(answers.shown_order(answers.judge_plan(kept, 3)), "case_id", "pass", "order")
    assert all(sorted(x[2]) == sorted(answers.CONDITIONS) for x in o1) and len({str(x[2]) for x in o1}) > 1
    ans = spark.createDataFrame([("n", "bare", " text ", None), ("n", "recall", None, "late")], "case_id string, condition string, text string, error string")
    order = spark.createDataFrame([("n", 0, ["recall", "bare", "plugin"])], "case_id string, pass int, order array<string>")
    p = answers.judge_prompts(kept, ans, order).first().prompt
    assert "### Answer A\n\n(no answer: late)\n\n### Answer B\n\ntext\n\n### Answer C\n\n(no answer)" in p
    assert answers.NEGATIVE_NOTE in p and "Judge notes: hint" in p
    q = spark.createDataFrame([("a", None, "Q"), ("b", "ctx", "Q")], "case_id string, injected string, question string")
    assert rows(answers.recall_prompts(q), "case_id", "prompt") == [("a", "Q"), ("b", "ctx\n\n---\n\nQ")]


def test_draws_of_the_bootstrap_are_never_rows(spark, monkeypatch):
    data = {"g": [0.0, 1.0, 7.0, 0.5, 2.0, 3.0, 9.0, 4.0, 4.5, 8.0], "h": [2.0, 5.0]}
    df = spark.createDataFrame([(g, i, v) for g, vs in data.items() for i, v in enumerate(vs)], "g string, i int, v double")
    monkeypatch.setattr(evals, "VALUE_BLOCK", 4, raising=False)
    monkeypatch.setattr(evals, "DRAWS_PER_TASK", 300, raising=False)
    out = evals.bootstrap_ci(df, ["g"], "i", "v", iters=200)
    assert {r.g: (r.n, r.lo, r.hi) for r in out.collect()} == {g: (len(vs), *map(pytest.approx, lcg_bootstrap(vs, 200, 42))) for g, vs in data.items()}
    assert "posexplode" not in out._jdf.queryExecution().analyzed().toString()
