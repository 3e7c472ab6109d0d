"""Operators with one result per document: fingerprints, quality, personal data, BPE, licences."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from messy_rows import messy, nothing, rows  # noqa: F401

from quillspark.llm import bpe, licenses, merkle, pii, quality
from quillspark.llm.common import pick

WORD = re.compile("[^\x20\x09-\x0d]+")


def as_counter(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# --- fingerprints -------------------------------------------------------------------------------------------


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_half_edits_against_a_list(messy, rows, parts):
    got = as_counter(
        merkle.half_edits(messy, parts=parts), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
    want = Counter()
    docs = order(rows)
    for one, after in zip(docs, docs[1:] + docs[:1], strict=True):
        a, b = one[1] or "", after[1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        f, g, h = (merkle.written_out(merkle.tree(x)) for x in (a, edited, b))
        want[one[0], len(a), hashlib.sha256(edited.encode()).hexdigest(), f, g, merkle.likeness(f, g), merkle.likeness(f, h)] += 1
    assert got == want


def test_half_edits_of_nothing_and_of_one(spark, nothing):
    assert merkle.query(nothing).collect() == []
    one = merkle.query(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    none = merkle.query(spark.createDataFrame([(None, "ab"), (None, None)], "doc_id long, text string")).collect()
    assert {r.edited_sha256 for r in none} == {hashlib.sha256(x).hexdigest() for x in (b"", b"a")}


def test_tree_covers_every_character_and_edits_are_found():
    rnd = random.Random(3)
    lines = [" ".join(f"w{rnd.randrange(900)}" for _ in range(30)) for _ in range(120)]
    text = "\n".join(lines)
    one = merkle.written_out(merkle.tree(text))
    for other in (text + " ", text + "\n", text.replace("w1", "W1", 1), "\n" + text):
        assert merkle.written_out(merkle.tree(other)).partition(":")[0] != one.partition(":")[0]
    changed = lines[:60] + [lines[60].replace(" ", "  ", 1)] + lines[61:]
    two = merkle.written_out(merkle.tree("\n".join(changed)))
    found = merkle.edits(two, one)
    assert len(found) == 1 and found[0][2] == "changed"
    assert 0.9 < merkle.likeness(one, two) < 1 and merkle.likeness(one, one) == 1
    assert merkle.likeness(one, merkle.written_out(merkle.tree(""))) == 0
    assert merkle.read_back(one)[1] == [(merkle.section_digest(s), s) for s in merkle.tree(text)]
    assert merkle.edits(one, one) == []


def test_roots_tell_texts_apart_whose_short_digests_are_equal(monkeypatch):
    # With inner digests of one letter, nearly all short texts share them.
    monkeypatch.setattr(merkle, "_digest", lambda data, size=merkle.DIGEST: "1" * 2 * size)
    texts = ["", "\n", "\n\n", "a", "a\n", "a\n\nb", "a\n\nc", *(f"text {i}" for i in range(2000))]
    marks = [merkle.written_out(merkle.tree(t)) for t in texts]
    assert len({m.partition(":")[0] for m in marks}) == len(texts) and len({len(m.partition(":")[0]) for m in marks}) == 1


def test_fingerprints_alone(messy, rows):
    got = as_counter(merkle.fingerprints(messy), "doc_id", "root", "fingerprint")
    marks = [(i, merkle.written_out(merkle.tree(t or ""))) for i, t, _ in rows]
    assert got == Counter((i, m.partition(":")[0], m) for i, m in marks)


# --- quality rules ------------------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed)


def brute_verdicts(rows, min_docs, share):
    def lines(text):
        out = Counter()
        for line in (text or "").split("\n"):
            if w := WORD.findall(line):
                out[re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(w))] += len(w)
        return out

    hosts, held = {}, {}
    for i, t, s in rows:
        hosts.setdefault(s, set()).add(t or "")
        for key in lines(t):
            held.setdefault((s, key), []).append((t or "", i, brute_base(t)[-1]))
    keeper = {}
    for (s, key), found in held.items():
        if len({t for t, _, _ in found}) > max(min_docs, share * len(hosts[s])):
            keeper[s, key] = min((i for _, i, failed in found if not failed and i is not None), default=None)
    out = Counter()
    for i, t, s in rows:
        base = brute_base(t)
        gone = sum(n for key, n in lines(t).items() if (s, key) in keeper and keeper[s, key] != i)
        left = base[0] - gone
        out[(i, *base, gone, not base[-1] and not (gone > 0 and (left < 20 or 100 * left < 30 * base[0])))] += 1
    return out


@pytest.mark.parametrize(("min_docs", "share"), [(30, 0.001), (2, 0.0), (1, 0.3)])
def test_quality_against_brute_force(messy, rows, min_docs, share):
    got = quality.verdicts(messy, min_docs=min_docs, share=share)
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_removed kept".split()
    assert as_counter(got, *names) == brute_verdicts(rows, min_docs, share)


def test_depleted_documents_go_but_one_keeps_the_lines(spark, nothing):
    menu = "\n".join(" ".join(f"menu{k}x{j}" for j in range(12)) for k in range(3))
    rows = [(i, f"{menu}\nunique {i} text", "h") for i in range(40)]
    rows += [(100 + i, " ".join(f"w{i}x{k}" for k in range(60)) + "\n" + menu, "h") for i in range(5)]
    rows += [(200 + i, menu, "h") for i in range(500)]  # exact copies are one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = {"min_docs": 30, "share": 0.001}
    kept = {r.doc_id for r in quality.verdicts(docs, **limits).where("kept").collect()}
    assert kept == {0, *range(100, 105)}
    assert {r.doc_id for r in quality.accepted(docs, **limits).collect()} == kept
    assert quality.verdicts(nothing).collect() == [] and quality.accepted(pick(nothing, doc_id="doc_id", text="text", source="source")).collect() == []


def test_many_copies_alone_are_clean(spark):
    text = "\n".join(" ".join(f"w{k}x{j}" for j in range(12)) for k in range(5))
    docs = spark.createDataFrame([(i, text, "h") for i in range(200)], "doc_id long, text string, source string")
    assert quality.verdicts(docs).where("kept").count() == 200


# --- personal data ------------------------------------------------------------------------------------------

DISGUISED = [
    ("write to john dot doe at example dot com today", "email", 9),
    ("john.doe [at] example [dot] com", "email", 0),
    ("x john(at)example.com", "email", 2),
    ("jоhn@exаmple.com", "email", 0),
    ("john @ example.com", "email", 0),
    ("john @ mail . example . com", "email", 0),
    ("john [at] example dot com", "email", 0),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", 0),
    ("call plus four nine one seven zero one two three four five six now", "phone", 5),
    ("pay ４１１１ １１１１ １１１１ １１１１", "card", 4),
    ("four one one one one one one one one one one one one one one one", "card", 0),
    ("host one nine two dot one six eight dot zero dot one", "ip", 5),
    ("uno nueve dos punto uno seis ocho punto cero punto uno", "ip", 0),
]


@pytest.mark.parametrize(("text", "kind", "start"), DISGUISED)
def test_disguises(text, kind, start):
    plain, added = pii.all_spans(text)
    assert plain == [] and [s[:2] for s in added] == [(kind, start)]
    assert text[slice(*added[0][1:])].strip() == text[slice(*added[0][1:])]
    assert f"<{kind.upper()}>" in pii.masked(text, added)


NEWLY_FOUND = [
    ("user@example . com", "email", 0),
    ("write user﹫example﹒com", "email", 6),
    ("call ﹢49 170 1234567", "phone", 5),
    ("call +๔๙ ๑๗๐ ๑๒๓๔๕๖๗", "phone", 5),
    ("pay ৪১১১ ১১১১ ১১১১ ১১১১", "card", 4),
    ("¹9².168.0.¹", "ip", 0),
    ("oﬃce@example.com", "email", 0),
    ("ⅽarl@exaⅿple.com", "email", 0),
    ("call +49 170 one two three 4567", "phone", 5),
    ("call plus 49 170 one two 34567", "phone", 5),
    ("pay 4111 1111 1111 one 111", "card", 4),
    ("host 192.168.one.1", "ip", 5),
    ("“four one one one 111111111111”", "card", 1),
]


@pytest.mark.parametrize(("text", "kind", "start"), NEWLY_FOUND)
def test_disguises_that_have_no_common_trace(text, kind, start):
    added = pii.all_spans(text)[1]
    assert [s[:2] for s in added] == [(kind, start)]
    assert pii.masked(text, added).startswith(text[:start] + f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["0.1 null 0.2 null 0.3", "0.5, null, 3.2, 1.1", "one of 3 two", "in 2004 one of 12 345 678 901 234"])
def test_figures_beside_words_are_left_alone(text):
    assert pii.all_spans(text) == ([], [])


def test_gate_leaves_nothing_out():
    def check(text):
        plain, added = pii.all_spans(text)
        assert added == pii.added_spans(text, plain), repr(text)

    for code in range(0x80, 0x110000):
        c = chr(code)
        if pii.fold_characters(pii.Rewritten.of(c)).text != c:
            assert pii.disguised(c), hex(code)
    # Characters that the patterns may take for letters, whatever the fold does.
    for code in [*range(0x80, 0x3100), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)]:
        check(f"ab{chr(code)}c@exam.com f{chr(code)}ve 1 one two three four 4")
    rnd = random.Random(11)
    pool = [*pii.SPELLED, "FİVE", "sıx", "“", "’", " ", " ", ".", " . ", " @ ", "@", "dot", " at ", "[at]", "(dot)", "_at_", "com", "ab", "+", "plus ", "-", ", ", "49", "170", "4111", "٤", "²", "\n", "_", "ñ", " dash "]
    for _ in range(20000):
        check("".join(rnd.choice(pool) + rnd.choice(["", " "]) for _ in range(rnd.randint(2, 14))))


@pytest.mark.parametrize(
    "text",
    ["look at the dot on the map", "un de les un le", "one two three go", "seen at home. The end", "eins zwei drei und los", "he is at work dot", ""],
)
def test_prose_is_left_alone(text):
    assert pii.all_spans(text) == ([], [])


def brute_base_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_brute_force(spark, messy, rows):
    rnd = random.Random(5)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111111111111112", "+49 170 1234567", "+1 (2) 3", " ", "é", "-", "7"]
    texts = [t or "" for _, t, _ in rows] + ["".join(rnd.choice(parts) for _ in range(12)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.query(docs).collect():
        base = brute_base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda s: (s[1], pii.KINDS.index(s[0]))))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert pii.query(messy).count() == len(rows)


def test_pii_of_nothing(nothing):
    assert pii.query(nothing).collect() == []


# --- BPE ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_against_tiktoken(messy, rows, nothing, reference):
    def line(i, t):
        ids = reference.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = as_counter(bpe.query(messy), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == Counter(line(i, t) for i, t, _ in rows)
    assert bpe.query(nothing).collect() == []


def test_encode_offsets_and_decode(messy, rows, reference):
    encoded = bpe.encode(messy)
    texts = Counter((i, t or "") for i, t, _ in rows)
    assert as_counter(bpe.decode(encoded), "doc_id", "text") == texts
    found = Counter()
    for r in encoded.collect():
        text = next(t for i, t in texts if i == r.doc_id and reference.encode_ordinary(t) == r.ids)
        found[r.doc_id, text] += 1
        at = 0
        data = text.encode()
        for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            piece = reference.decode_single_token_bytes(i)
            # The span holds just the characters that the token's bytes touch.
            assert len(text[:a].encode()) <= at and at + len(piece) <= len(text[:b].encode())
            assert data[at : at + len(piece)] == piece and b - a <= len(piece)
            at += len(piece)
        assert at == len(data)
    assert found == texts


def test_pieces_and_slabs(reference, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "SLAB", 8)
    pieces = bpe.Pieces(bpe.ranks_tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), kept=40)
    rnd = random.Random(1)
    pool = [*"ab AB  \n\n\t\r\x0b\x1c\x85\xa0　é’.,12²߀中​", "'s", " don't", "\r\n", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))
        joined = b"".join(pieces.slab(text[a:b]) for a, b in bpe.slabs(text, 8))
        assert list(memoryview(joined).cast("I")) == reference.encode_ordinary(text)


# --- licences -----------------------------------------------------------------------------------------------


def test_licences(spark, nothing):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    shouted = "Copyright (c) 2020 Some One\n\n" + mit.replace("sublicense", "SUBLICENCE").replace(",", " ,").upper().replace("\n", "\n\n")
    rows = [
        (1, mit), (2, shouted), (3, mit + "\nand more"), (4, "Some text.\n  Released under the M-I-T license"),
        (5, "Some text.\nRELEASED under the MIT Licence!\nLicensed under CC-BY-NC 4.0\nReleased under the MIT License."), (6, None), (7, ""),
        (1, mit), (None, "Licensed under the Apache License, Version 2.0."), (8, "© 2021 X\n(c) Y"), (9, "word " * 50000),
    ]
    docs = spark.createDataFrame([(i, t, "no", "no") for i, t in rows], "doc_id long, text string, TEXT string, license string")
    got = {(r.doc_id, r.license, r.notices, r.n_notices) for r in licenses.query(docs).collect()}
    assert {(1, "MIT", None, 0), (2, "MIT", None, 0), (3, None, None, 0), (4, None, None, 0), (5, None, "CC-BY-NC-4.0,MIT", 3)} <= got
    assert {(6, None, None, 0), (7, None, None, 0), (None, "Apache-2.0", "Apache-2.0", 1), (8, None, None, 0)} <= got
    assert licenses.query(docs).count() == len(rows)
    assert licenses.query(nothing).collect() == []
    empty = spark.createDataFrame([], "digest string, license string")
    assert {r.license for r in licenses.scan(docs, empty).collect()} == {None}


def test_whole_licences_in_any_flow(spark):
    import textwrap
    from pathlib import Path

    assert licenses.WHOLE_TEXTS.read_text().splitlines() == licenses.whole_digests(spark)
    files = sorted(Path(licenses.__file__).with_name("license_texts").glob("*.txt"))
    rows = []
    for path in files:
        text, name = path.read_text(), path.stem.partition("+")[0]
        parts = re.split(r"\n[ \t]*\n", text)
        flows = [text, text.replace("\n", "\r\n"), "\n\n".join(" ".join(p.split()) for p in parts)]
        # A copyright notice on top keeps its lines: what is left of a broken one is no copyright line.
        top = parts[:1] if parts[0].startswith("Copyright") else []
        body = [" ".join(p.split()) for p in parts[len(top) :]]
        flows += ["\n\n".join([*top, *(textwrap.fill(p, width, break_on_hyphens=False) for p in body)]) for width in (40, 66, 72, 80, 100)]
        rows += [(len(rows) + k, name, t) for k, t in enumerate(flows)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.query(docs).collect()}
    assert [(i, got[i]) for i, *_ in rows] == [(i, name) for i, name, _ in rows]
    cut = spark.createDataFrame([(k, p.read_text()[:-200]) for k, p in enumerate(files)], "doc_id long, text string")
    assert {r.license for r in licenses.query(cut).collect()} == {None}


def test_licence_plan_has_no_python(messy):
    plan = licenses.query(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_licence_sql_on_unusual_rows(spark, messy, rows):
    import pandas as pd

    unique = {i: t for i, t, _ in rows if i is not None}
    documents = pd.DataFrame({"doc_id": list(unique), "text": list(unique.values())})  # noqa: F841
    want = {tuple(r) for r in duckdb.sql(licenses.ORACLE).fetchall()}
    docs = spark.createDataFrame(list(unique.items()), "doc_id long, text string")
    assert {tuple(r) for r in licenses.query(docs).collect()} == want
