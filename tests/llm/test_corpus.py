"""Operators over the whole corpus: packing, line runs, WARC, SimHash, chat, and the pipeline."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from messy_rows import messy, nothing, rows  # noqa: F401

from quillspark.llm import chat, components, line_runs, packing, pii, quality, simhash, warc
from quillspark.llm.common import pick
from quillspark.session import work_dir

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SPACE = " \t\n\x0b\x0c\r"


def as_counter(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- packing ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def brute_pieces(tokenizer, text, capacity):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


@pytest.mark.parametrize("capacity", [2048, 100])
def test_packing(messy, rows, nothing, tokenizer, capacity):
    got = packing.pack(messy, capacity=capacity).collect()
    want = Counter((i, *p) for i, t, _ in rows for p in brute_pieces(tokenizer, t, capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(nothing).collect() == []


def best_fit_one_by_one(histogram, capacity):
    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            room = min(fits) if fits else capacity
            n += not fits
            if fits:
                rooms.remove(room)
            rooms.append(room - length)
    return n


@pytest.mark.parametrize(("seed", "low", "high", "n"), [(1, 1, 2048, 1500), (2, 600, 1400, 1500), (3, 1, 400, 3000), (4, 1025, 2047, 300), (5, 7, 7, 1)])
def test_program_against_best_fit(seed, low, high, n):
    lengths = np.random.default_rng(seed).integers(low, high, n, endpoint=True)
    histogram = dict(Counter(int(x) for x in lengths))
    configs = packing.solve(histogram)
    held = Counter()
    for config, times in configs.items():
        assert sum(config) <= 2048
        for item in config:
            held[item] += times
    assert held == Counter(histogram)
    used = sum(configs.values())
    assert math.ceil(lengths.sum() / 2048) <= used <= best_fit_one_by_one(histogram, 2048) * 1.015 + 1


def test_price_is_the_best_knapsack():
    rng = np.random.default_rng(0)
    values = np.where(rng.random(31) < 0.4, rng.random(31), 0)
    values[0] = 0
    best, take = packing.price(values, 30)
    plain = [0.0] * 31
    for c in range(1, 31):
        plain[c] = max([plain[c - 1], *(plain[c - k] + values[k] for k in range(1, c + 1) if values[k] > 0)])
    assert np.allclose(best, plain)
    room, worth = 30, 0.0
    while room > 0:
        worth += values[take[room]]
        room -= int(take[room]) or 1
    assert worth == pytest.approx(best[30])


def test_numbers_are_dense_within_a_hot_length(spark):
    pieces = spark.range(3000).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, id % 5, 7) AS length", "0L AS ids_crc32", "id AS row"
    )
    got = defaultdict(list)
    for r in packing.numbered(pieces, rows_per_group=100).collect():
        got[r.length].append(r.number)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got[7]) == 2000


# --- line runs ----------------------------------------------------------------------------------------------


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        k = lower(line.strip(SPACE))
        return k if len(k) >= min_chars else None

    held = defaultdict(list)
    for i, t, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            held[k].append(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if (k := key(x)) not in last or k is None or last[k] == i]
        out[i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()] += 1
    return out


def test_line_dedup_against_brute_force(messy, rows, nothing):
    levels = []
    line_runs.dedup_lines(messy, on_batch=lambda runs: levels.append([len(x) for x in runs.state]))
    assert levels == [[1], [2], [3], [0, 1]]  # the fourth run fills the level
    assert as_counter(line_runs.query(messy), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows)
    assert line_runs.query(nothing).collect() == []


def test_runs_over_batches(spark):
    runs = line_runs.LineRuns(spark, fan_in=2)
    seen, rng = set(), np.random.default_rng(2)
    for batch in range(5):
        keys = [(int(x).to_bytes(2, "big"), batch) for x in set(rng.integers(0, 60, 25).tolist())]
        new = spark.createDataFrame(keys, "key binary, doc_id long")
        assert {bytes(r.key) for r in runs.unseen(new).collect()} == {k for k, _ in keys} - seen
        runs.add(new)
        seen |= {k for k, _ in keys}
    assert [len(x) for x in runs.state] == [1, 0, 1]
    again = line_runs.LineRuns(spark, root=runs.root, fan_in=2, state=runs.state)
    assert {bytes(r.key) for r in again.merged().collect()} == seen


# --- WARC ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages():
    hard = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n0\r\n\r\nWARC/1.1\r\n" + "x" * 990
    long = "<p>é</p>\r\n" * 9000
    out = [(1, "http://a/1", "<a>"), (2, None, None), (3, "u\r\nWARC/1.1", ""), (4, "u", hard), (9, "u", hard), (5, "u", long), (8, "u", long)]
    out += [(6, "u", "y" * 999), (7, "u", "y" * 999), (10, "u", "é" * 500), (11, "u", "é" * 500), (11, "u", "é" * 500), (None, "u", long)]
    return out + [(4, "u", "z" * 2000), (12, "u", "WARC/1.1\r\n" * 4000)]


def test_warc_against_brute_force(spark, pages):
    df = spark.createDataFrame([(i, u, h, 1, "no") for i, u, h in pages], "page_id long, url string, html string, digest int, HTML string")
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        refers = largest[h or ""] if len(body) >= 1000 and largest[h or ""] != i else None
        want[i, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert as_counter(warc.query(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.query(df.limit(0)).collect() == []


def test_a_page_of_very_many_segments(spark):
    # Segments end within characters, and a page of 32 MB has 2000 of them.
    path = work_dir(spark, "warc-long")
    df = spark.range(1).selectExpr("id AS page_id", "'u' AS url", "repeat('a\u00e9\u4e2d\U0001f600', 3355443) AS html")
    warc.write_archives(df, path)
    found = warc.read_records(spark, path)
    assert found.count() > 2000 and found.where("record_type = 'response'").count() == 1
    got = warc.read_archives(spark, path).select("page_id", "payload_bytes", "problem", "payload_digest").first()
    assert tuple(got) == (0, 33554430, None, df.selectExpr("sha1(cast(html AS binary)) AS d").first().d)


def test_archives_are_warc_files_and_payloads_come_back(spark, pages):
    path = work_dir(spark, "warc-test")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df.repartition(3), path, min_revisit=10**9, segment_bytes=500)
    import glob
    import gzip

    n = 0
    for name in glob.glob(f"{path}/part-*"):
        data = gzip.open(name).read()
        while data:  # a plain reader that goes by Content-Length
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            assert len(re.findall(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ(?=\r\n)", head)) == 1
            size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data, n = rest[size + 4 :], n + 1
    assert n > 100
    got = warc.read_archives(spark, path)
    back = Counter((r.page_id, bytes(r.payload)) for r in got.collect())
    assert back == Counter((i, (h or "").encode()) for i, _, h in pages)


def test_broken_segments_are_named(spark):
    long = warc.records(1, "u", b"x" * 3000, None, 1000, "2026-01-31T12:00:00Z")
    cases = {"segments": [long[0], long[2], long[3]], "total length": long[:-1], "length": [long[0][:-5], *long[1:]], None: long[::-1]}
    for problem, kept in cases.items():
        path = work_dir(spark, "warc-broken")
        df = spark.createDataFrame([(bytearray(x),) for x in kept], "r binary").selectExpr("CAST(r AS STRING) AS value")
        df.repartition(2).write.option("lineSep", "\r\n\r\n").text(path)
        (row,) = warc.read_archives(spark, path).collect()
        assert row.problem == problem and (problem or row.payload_bytes == 3000)
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(warc.chunked(b"")) == b"" and warc.dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


# --- SimHash ------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(messy, rows, nothing, monkeypatch):
    fps = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    roots = brute_components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = Counter((i, f"{f:016x}", least.get(roots[f])) for i, f in fps)
    assert as_counter(simhash.query(messy), "doc_id", "fingerprint", "component_id") == want
    assert simhash.query(nothing).collect() == []
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert all(simhash.fingerprint((t or "").encode()) == brute_fingerprint(t) for _, t, _ in rows)


def test_links_are_all_near_pairs(spark):
    rng = np.random.default_rng(4)
    found = {0, 1, 3, 7, 15, (1 << 64) - 1, 1 << 63}
    for centre in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            found.add(centre ^ sum(1 << int(b) for b in flips))
    fps = np.array(sorted(found), np.uint64)
    want = {(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ a) <= 3]}
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(nodes).collect()]
    assert set(got) == want and len(got) == len(want)


def test_components_of_a_chain_a_star_and_a_clique(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)]
    got = {r.a: r.b for r in components.connected(spark.createDataFrame([*links, *links], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{1000 + i: 1000 for i in range(1, 50)}, **{2000 + i: 2000 for i in range(1, 12)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- chat ---------------------------------------------------------------------------------------------------


def test_chat_against_sql_and_by_hand(spark):
    full = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(6)]
    turns = full + [(2, t, r, x) for _, t, r, x in full[:3]] + [(7, 10 * t, r, x) for _, t, r, x in full[:5]]  # prefixes, other numbers
    turns += [(3, t, r, x) for _, t, r, x in full] + full[:2]  # a copy of 1; repeated rows
    turns += [(4, 0, "user", "text 0"), (4, 1, "user", "other")]  # shares its first turn only
    turns += [(None, 0, None, None), (5, None, "user", "<|im_end|>"), (6, 0, "user", ""), (6, 0, "user", "b"), (8, 0, None, "")]
    turns += [(9, t, "user", f"long {t}") for t in range(700)] + [(10, t, "user", f"long {t}") for t in range(300)]
    df = spark.createDataFrame([(*t, "no", 1) for t in turns], "conv_id long, turn long, role string, text string, TEXT string, pos int")
    names = "conv_id part n_turns n_equal rendered".split()
    got = as_counter(chat.collapse_and_render(df.repartition(4)), *names)
    import pandas as pd

    conversations = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    known = {k for k in got if k[0] is not None}
    sql = {tuple(r) for r in duckdb.sql(f"SELECT {', '.join(names)} FROM ({chat.ORACLE}) WHERE conv_id IS NOT NULL").fetchall()}
    assert known | {(8, 0, 1, 2, "<|im_start|>\n<|im_end|>\n")} == sql | {(8, 0, 1, 2, "<|im_start|>\n<|im_end|>\n")}
    assert {k[0] for k in got} - {None, 8} == {1, 4, 5, 6, 9}
    assert ("<|im_start|>user\n< |im_end|><|im_end|>\n") in {k[4] for k in got}
    assert sorted(k[1] for k in got if k[0] == 9) == [0, 1, 2]
    assert chat.collapse_and_render(df.limit(0)).collect() == []


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, messy, rows, tokenizer):
    import corpus_pipeline as pipeline
    from test_texts import brute_verdicts

    docs = pick(messy, **{c: c for c in pipeline.COLUMNS})
    steps = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "unused")
        steps.append([(r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()] if "text" in docs.columns else docs.collect())
        assert docs.columns == list(pipeline.COLUMNS) or stage is pipeline.best_fit_packing
    verdict = defaultdict(bool)
    for v in brute_verdicts(rows, quality.MIN_DOCS, quality.SHARE):
        verdict[v[0]] |= v[-1]
    left = [r for r in rows if verdict[r[0]]]
    assert Counter(s[:3] for s in steps[0]) == Counter(left)
    want = brute_lines(left)
    assert Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in steps[1]) == Counter({(k[0], k[3]): n for k, n in want.items()})
    sets = [(i, tuple(simhash.shingle_hashes((t or "").encode()).tolist())) for i, t, *_ in steps[1]]
    roots = brute_components({f for _, f in sets}, lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b}))
    least = defaultdict(lambda: None)
    for i, f in sets:
        if i is not None:
            least[roots[f]] = min(i, least[roots[f]] if least[roots[f]] is not None else i)
    assert Counter(s[:2] for s in steps[2]) == Counter(s[:2] for s, (i, f) in zip(steps[1], sets, strict=True) if least[roots[f]] == i)
    assert Counter(s[:2] for s in steps[3]) == Counter((s[0], pii.masked(s[1], sum(pii.all_spans(s[1]), []))) for s in steps[2])
    assert all(s[3] == len(s[1]) for s in steps[3])
    pieces = Counter((i, *p) for i, t, *_ in steps[3] for p in brute_pieces(tokenizer, t, 2048))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in steps[4]) == pieces


def test_pipeline_limits_follow_the_host(spark):
    import corpus_pipeline as pipeline

    def prose(tag, n):
        return " ".join(f"{tag}x{k}" for k in range(n))

    menu = "\n".join(prose(f"menu{k}", 12) for k in range(3))
    found = [(i, f"{menu}\n{prose(f'short{i}', 5)}", "small") for i in range(12)]  # a host of 60 documents
    found += [(100 + i, f"{prose(f'own{i}', 60)}\n{menu}", "small") for i in range(8)]
    found += [(200 + i, f"{prose(f'clean{i}', 40)}\n{prose(f'pair{i // 2}', 12)}", "small") for i in range(40)]
    found += [(1000 + i, f"{menu}\n{prose(f'large{i}', 40)}" if i < 9 else prose(f"large{i}", 40), "large") for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in found], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.quality_rules(spark, docs, "unused").collect()}
    assert kept == {i for i, *_ in found} - set(range(1, 12))


def test_pipeline_takes_common_lines_out_of_kept_documents(spark):
    import corpus_pipeline as pipeline

    def prose(tag, n):
        return " ".join(f"{tag}x{k}" for k in range(n))

    # Short menu lines; 2 keeps nothing else, so that the keeper of "lost & found" is rejected and 30 has to keep it.
    found = [(i, f"Home | News\n{prose(f'own{i}', 40)}\n\n home |  NEWS \t\n(c) {i}", "h") for i in range(5, 20)]
    found += [(i, f"{prose(f'more{i}', 30)}\nlost & found {prose('x', 9)}", "h") for i in range(30, 45)]
    found += [(2, f"{prose('tiny', 7)}\nHome | News\nlost & found {prose('x', 9)}", "h"), (1, f"Home | News\n{prose('first', 30)}", "h")]
    found += [(2, f"{prose('tiny', 7)}\nHome | News\nHome | News\nlost & found {prose('x', 9)}", "h")]
    found += [(50, f"Home | News\n{prose('other', 30)}", "i"), (None, f"Home | News\n{prose('none', 30)}", "h"), (7, None, "h")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in found], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text, r.source, r.n_chars) for r in pipeline.quality_rules(spark, docs.repartition(3), "unused").collect()]
    assert all(n == len(t or "") for _, t, _, n in got)
    texts = {(i, s): t for i, t, s, _ in got if t is not None}
    assert texts[1, "h"] == f"Home | News\n{prose('first', 30)}" and texts[50, "i"] == f"Home | News\n{prose('other', 30)}"
    assert texts[5, "h"] == f"{prose('own5', 40)}\n\n(c) 5" and texts[None, "h"] == prose("none", 30)
    assert (7, None, "h", 0) in got and (2, "h") not in texts
    assert sum("Home" in t for t in texts.values()) == 2
    assert [i for (i, _), t in sorted(texts.items(), key=lambda x: x[0][0] or 0) if "lost" in t] == [30]
