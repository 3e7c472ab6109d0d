import pytest
from conftest import note
from pyspark.sql import functions as F

from quillspark.functions import dates, markdown, redact, text


def test_frontmatter_split_and_fields(vault):
    raw = (
        "---\ntitle: 'It''s here'\ntags: [Type/Brief, b]\ncreated: 2026-01-02\nkeywords: Alpha, beta\n"
        "aliases:\n  - One\n  - \"Two\"\nsource:\nedits:\n  - section: A\n    action: replace\n    content: |\n      x\n"
        "  - section: B\n    action: nope\n    content: y\n---\n\n# H1\n\nBody #Inline #1x\n"
    )
    n = vault({"a/b.md": raw}).first()
    assert n.title == "It's here"
    assert n.tags == ["b", "inline", "type/brief"]
    assert str(n.created_at) == "2026-01-02 00:00:00"
    assert n.fm.keywords == ["Alpha", "beta"] and n.fm.aliases == ["One", "Two"]
    assert n.fm.source is None
    assert n.content.startswith("\n# H1")
    assert [e.section for e in n.fm.edits] == ["A", "B"]


def test_no_frontmatter_and_empty_block(vault):
    n = {r.path: r for r in vault({"x.md": "plain", "y.md": "---\n---\nbody\n---\n", "z.md": "--- a\nb"}).collect()}
    assert n["x.md"].content == "plain" and n["x.md"].title == "x"
    assert n["y.md"].content == "body\n---\n"
    assert n["z.md"].content == "--- a\nb"


@pytest.mark.parametrize(
    ("raw", "path", "want"),
    [
        (note("'  '", body="# H1 title\n"), "a.md", "H1 title"),
        ("text only", "a/b.md", "b"),
        (note(" Padded "), "a.md", "Padded"),
    ],
)
def test_title_cascade(vault, raw, path, want):
    assert vault({path: raw}).first().title == want


def test_created_fallback_and_malformed(vault):
    rows = {
        r.path: (str(r.created_at), r.malformed)
        for r in vault(
            {
                "a.md": note(created="'2026-01-02T03:04:05.000Z'"),
                "b.md": note(created="not-a-date"),
                "c.md": "none",
            }
        ).collect()
    }
    assert rows == {
        "a.md": ("2026-01-02 03:04:05", False),
        "b.md": ("2026-06-01 00:00:00", True),
        "c.md": ("2026-06-01 00:00:00", False),
    }


def test_code_blocks_keep_line_count(one):
    src = "a\n```js\n## no\n~~~\n````\nb\n~~~\n```\nstill\n"
    out = one(markdown.strip_code_blocks("c"), c=src)
    assert out == "a\n\n\n\n\nb\n\n\n\n"
    assert one(markdown.strip_code_blocks("c"), c="x `y` z") == "x `y` z"


def test_section_items(one):
    body = "# T\n\n```\n## Topics\n- code\n```\n\n## Topics\n\n- one\n- two (x)\n\n## Next\n- no\n"
    assert one(markdown.section_items("c", "Topics"), c=body) == ["one", "two (x)"]
    assert one(markdown.section_items("c", "A.b (c)"), c="## A.b (c)\n- x") == ["x"]
    assert one(markdown.section_items("c", "Missing"), c=body) == []


def test_iso_weeks(one):
    ts = F.col("c").cast("timestamp")
    for day, want in (
        ("2026-06-10", "2026-W24"),
        ("2025-12-29", "2026-W01"),
        ("2026-06-08 10:00:00", "2026-W24"),
        ("2021-01-03 12:00:00", "2020-W53"),
    ):
        assert one(dates.iso_week(ts), c=day) == want
    assert one(dates.year_month(ts), c="2026-06-10") == "2026-06"


def test_routing_tokens(one):
    assert one(text.routing_tokens("c"), c="How do the JWT-tokens of RLS work, a b2?") == [
        "jwt", "tokens", "rls", "b2",
    ]


def test_chunks(one):
    c = "# Title\n\nIntro\n\n## One\nbody 1\n\n## Two\n\n## \nraw\n"
    rows = one(markdown.section_chunks(F.lit("T"), "c"), c=c)
    assert [(r.heading, r.text) for r in rows] == [
        ("", "T\nIntro"),
        ("One", "T\nOne\nbody 1"),
        ("Two", "T\nTwo\n## \nraw"),
    ]
    assert len(one(markdown.section_chunks(F.lit("T"), "c"), c="just text")) == 1
    assert one(markdown.section_chunks(F.lit("T"), "c"), c="# only h1\n\n") == []


def test_snippets(one):
    snip = lambda tags, q: text.snippet("c", F.array(*[F.lit(t) for t in tags]), F.lit(q))
    assert one(snip(["type/brief"], "x"), c="> TL;DR: the point \n\nrest") == "the point"
    sess = "# T\n\n## Topics\n\n- a\n- b\n\n## Files Changed\n- f\n"
    assert one(snip(["type/session"], "x"), c=sess) == "- a\n- b"
    facts = "## Key Facts\n" + "x" * 400 + "\n\n## End\n"
    assert one(snip(["type/note"], "x"), c=facts) == "x" * 300 + "..."
    body = "a" * 200 + " needle " + "b" * 300
    out = one(snip(["type/note"], "Needle"), c=body)
    assert out.startswith("...aaa") and "needle" in out and out.endswith("b...")
    assert len(out) == 6 + 80 + 120


def test_truncate_at_section(one):
    cutter = lambda n: text.truncate_at_section("c", F.lit(n))
    assert one(cutter(100), c="short") == "short"
    assert one(cutter(0), c="short") == ""
    late = "a" * 60 + "\n## H\n" + "b" * 100
    assert one(cutter(80), c=late) == "a" * 60
    para = "a" * 60 + "\n\n" + "b" * 100
    assert one(cutter(80), c=para) == "a" * 60
    assert one(cutter(80), c="a" * 200) == "a" * 80
    early = "a" * 10 + "\n## H\n" + "b" * 200
    assert len(one(cutter(80), c=early)) == 80


def test_stale_references(one):
    t = "See src/vault/hybrid.ts and scripts/memory-eval.mjs:42, around line 17."
    assert one(text.stale_references("c"), c=t) == ["src/vault/hybrid.ts", "scripts/memory-eval.mjs", "line 17"]
    assert one(text.stale_references("c"), c="plain prose, headline 5x") == []


def test_keyword_match_is_whole_word(one):
    m = lambda k: text.matches_keyword("c", F.lit(k))
    assert one(m("rls"), c="the girls") is False
    assert one(m("RLS"), c="about rls.") is True
    assert one(m("time tracking"), c="On Time Tracking now") is True
    assert one(m("a.b"), c="axb") is False
    assert one(m("ligne"), c="éligne") is True  # only ASCII letters make words


def test_wikilinks(one):
    c = "[[Note A]] [[Note B|alias]] [[Note C#section]] ![[Embed]] `[[code]]` [[...tool]]\n```\n[[fenced]]\n```\n"
    assert one(markdown.wikilink_targets("c"), c=c) == ["Note A", "Note B", "Note C", "Embed"]


def test_keyword_list(one):
    e = text.keyword_list(F.array(F.lit(" JWT "), F.lit("auth")), F.array(F.lit("jwt"), F.lit("")))
    assert one(e, c="x") == ["jwt", "auth"]


@pytest.mark.parametrize(
    ("prompt", "ok"),
    [("", False), ("/help me with this now", False), ("yes please do", False), ("how does auth work", True), ("a - b - c", False)],
)
def test_prompt_eligibility(one, prompt, ok):
    assert one(text.prompt_is_eligible("c"), c=prompt) is ok


def test_summary_line(one):
    assert one(text.summary_line("c"), c="> TL;DR: use [[a|b]] and [[c]]") == "use b and c"
    assert one(text.summary_line("c"), c="# T\n\n| a |\n\nfirst\nline\n\nsecond") == "first line"
    out = one(text.summary_line("c"), c="w" * 300)
    assert len(out) == 120 and out.endswith("…")


def test_slugs_and_log_fields(one):
    assert one(text.project_slug("c"), c="My App!!x") == "my-app-x"
    assert one(text.title_slug("c"), c="***") == "proposal"
    assert one(text.clean_log_field("c"), c=" a | b\n c ") == "a b c"


def test_strip_markup(one):
    s = "<system-reminder>x\ny</system-reminder>Hello <b>you</b>\n there"
    assert one(text.strip_markup("c"), c=s) == "Hello you there"


# --- section edits -----------------------------------------------------------------------------

EDIT_CASES = [
    ("## A\nold\n\n## B\nb", [("A", "replace", "new")], "## A\nnew\n\n## B\nb", ["A"]),
    ("## A\nold", [("a ", "replace", "new")], "## A\nnew", ["a "]),
    ("## A\nold\n\n## B\nb", [("A", "append", "more")], "## A\nold\nmore\n\n## B\nb", ["A"]),
    ("## A\nx\n### Sub\ny\n## B", [("A", "replace", "n")], "## A\nn\n\n## B", ["A"]),
    ("## A\nx\n### Sub\ny\n## B", [("Sub", "replace", "n")], "## A\nx\n### Sub\nn\n\n## B", ["Sub"]),
    ("text\n\n", [("New", "append", "c1\nc2")], "text\n\n## New\n\nc1\nc2", ["New"]),
    ("## A\n", [("A", "append", "x")], "## A\nx\n", ["A"]),
    ("# A\n1\n## A2\n2", [("A", "append", "z"), ("A2", "replace", "q")], "# A\n1\n## A2\nq", ["A", "A2"]),
]


@pytest.mark.parametrize(("body", "edits", "want", "changed"), EDIT_CASES)
def test_apply_edits(spark, body, edits, want, changed):
    df = spark.createDataFrame([(body, edits)], f"body string, edits {markdown.EDITS_TYPE}")
    r = df.select(markdown.apply_edits("body", "edits").alias("r")).first()["r"]
    assert (r.body, r.changed, r.error) == (want, changed, None)


def test_replace_of_missing_section_is_an_error(spark):
    edits = [("A", "append", "x"), ("Gone", "replace", "y")]
    df = spark.createDataFrame([("## A\nb", edits)], f"body string, edits {markdown.EDITS_TYPE}")
    r = df.select(markdown.apply_edits("body", "edits").alias("r")).first()["r"]
    assert r.body == "## A\nb" and r.changed == []
    assert r.error == 'Cannot replace missing section "Gone"'


# --- redaction -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("src", "want"),
    [
        ("NEON_API_KEY=abc123def456", "NEON_API_KEY=[REDACTED]"),
        ("my_secret: 'long enough value'", "my_secret: [REDACTED]"),
        ("API_KEY=your-key-goes-here", "API_KEY=your-key-goes-here"),
        ("API_KEYS=[1, 2, 3, 4, 5]", "API_KEYS=[1, 2, 3, 4, 5]"),
        ("DB_PASSWORD=short", "DB_PASSWORD=short"),
        ("DB_PASSWORD=$DB_PASSWORD_PROD", "DB_PASSWORD=$DB_PASSWORD_PROD"),
        ("DB_PASSWORD=${SOME_VARIABLE}x", "DB_PASSWORD=${SOME_VARIABLE}x"),
        ("token = abcdefghijk", "token = abcdefghijk"),
        ("ghp_" + "a" * 24, "gh?_[REDACTED]"),
        ("postgres://bob:hunter2@db/x", "postgres://[REDACTED]@db/x"),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
        ("eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl", "[REDACTED_JWT]"),
        ("A_TOKEN=abcdefgh1 B_TOKEN=<your token> C_KEY=\"abc def ghi\"", "A_TOKEN=[REDACTED] B_TOKEN=<your token> C_KEY=[REDACTED]"),
    ],
)
def test_redaction(one, src, want):
    assert one(redact.redact_secrets("c"), c=src) == want


def test_strict_redaction_and_counts(spark):
    df = spark.createDataFrame([(1, "token = abcdefghijk sk-" + "a" * 30), (2, "clean")], "id int, t string")
    rows = {r.id: r for r in redact.redaction_counts(df, "t", strict=True).collect()}
    assert rows[1].redacted == "token = [REDACTED] sk-[REDACTED]"
    assert [(h.rule, h.hits) for h in rows[1].hits] == [("sk_key", 1), ("named_value", 1)]
    assert rows[2].hits == [] and rows[2].redacted == "clean"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(text.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(0.70710678) and got[1] == 0.0


def test_rules_are_tried_only_where_their_signs_are(spark):
    hits = [
        "napi_" + "a1" * 12, "npg_abcdefgh1", "github_pat_" + "a" * 22, "ghs_" + "Z" * 20, "xoxb-1234567890a", "sk-" + "k" * 20, "AKIA" + "A1" * 8, "ASIA" + "B2" * 8,
        "eyJabcde.abcde.x", "eyJ" + "a" * 20 + ".bcdef", "eyJ" + "a" * 37, "Postgres://me:pw@host", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----",
        "my_Token = abcdefghij", 'API_KEYS": "abcdefghij"',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*hits, "plain text", "", None, "the key is here"])], "i int, t string")
    got = {r.i: (r.redacted, [h.rule for h in r.hits]) for r in redact.redaction_counts(df, "t").collect()}
    assert [got[i][1] for i in range(13)] == [[n] for n in redact.RULE_NAMES[:13]] and got[13][1] == got[14][1] == ["named_value"]
    once = {r.i: r.out for r in df.select("i", redact.redact_secrets("t").alias("out")).collect()}
    assert once == {i: text for i, (text, _) in got.items()} and once[17] is None
    assert set(redact.SIGNS) == set(redact.RULE_NAMES) - {"named_value"}
