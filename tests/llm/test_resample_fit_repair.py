"""Importance resampling against its SQL and a plain count, best-fit decreasing against a list of windows, repairs against a full table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute_repair
import duckdb
import numpy as np
import pytest
from messy_rows import messy, nothing, rows  # noqa: F401

from quillspark.llm import bestfit, importance, repair
from quillspark.llm.bpe import file_tokenizer
from quillspark.llm.common import pick, written


# --- importance resampling ----------------------------------------------------------------------------------


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, shortest, longest):
    words = WORDS.findall(text.encode().lower().decode())
    return words, [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("shortest", "longest"), [(1, 1), (1, 3), (2, 2), (3, 4)])
def test_features_over_slabs_are_those_of_the_whole_text(rows, shortest, longest):
    for _, text, _ in rows:
        words, want = runs(text or "", shortest, longest)
        for slab in (7, 50, 100_000):
            n, got = importance.buckets_of((text or "").encode(), 997, shortest, longest, slab)
            assert n == len(words)
            assert Counter(got.tolist()) == Counter(zlib.crc32(run.encode()) % 997 for run in want)


def plain_draw(docs, target, buckets=10_000, shortest=1, longest=1):
    counted = [(i, *runs(t or "", shortest, longest)) for i, t in docs]
    source = Counter(zlib.crc32(run.encode()) % buckets for _, _, own in counted for run in own)
    goal = Counter(zlib.crc32(run.encode()) % buckets for t in target for run in runs(t or "", shortest, longest)[1])
    s_all, t_all = source.total(), goal.total()
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, words, own in counted:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(run.encode()) % buckets] for run in own)
        out.append((i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    apt = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = len(apt) * 10 // 100
    lined = [(i, n, w, s, k if k <= drawn else None) for k, (i, _, n, w, s) in enumerate(apt, 1)]
    return Counter(lined + [(i, n, w, s, None) for i, words, n, w, s in out if words < 20])


@pytest.mark.parametrize(("shortest", "longest"), [(1, 1), (1, 2)])
def test_draw_against_a_plain_count(spark, messy, rows, shortest, longest):
    more = [(1000 + i, f"alpha {i} " * (5 + i), "a") for i in range(60)]
    docs = messy.union(spark.createDataFrame([(i, t, "en", s, 0, "no", "no", b"no", 1, "no", "no") for i, t, s in more], messy.schema))
    target = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "alpha")], "item_id long, text string")
    got = Counter(tuple(r) for r in importance.resample(docs, target, shortest=shortest, longest=longest).collect())
    assert got == plain_draw([(i, t) for i, t, _ in rows + more], ["alpha beta gamma", None, "alpha"], shortest=shortest, longest=longest)


def test_draw_is_what_its_sql_says(spark, messy):
    target = spark.createDataFrame([(1, "Alpha beta, gamma")], "item_id long, text string")
    got = Counter(tuple(None if v is None else int(v) for v in r) for r in importance.query(messy, target).collect())
    with duckdb.connect() as c:
        c.register("documents", pick(messy, doc_id="doc_id", text="text").toPandas().astype({"doc_id": "Int64"}))
        c.register("benchmark", target.toPandas())
        want = Counter(tuple(None if v is None else int(v) for v in r) for r in c.execute(importance.ORACLE).fetchall())
    assert got == want


def test_draw_of_nothing_and_without_a_target(spark, messy, nothing):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.query(nothing, target).collect() == []
    assert importance.query(messy, target).count() == messy.count()


def test_a_megabyte_without_a_separator_is_one_word():
    n, got = importance.buckets_of(b"x" * 1_000_000 + b" y", 10_000, 1, 1)
    assert n == 2 and got.tolist() == [zlib.crc32(b"x" * 1_000_000) % 10_000, zlib.crc32(b"y") % 10_000]


def test_ranks_run_through_all_ranges(spark):
    scored = spark.range(5000).selectExpr("id % 700 AS doc_id", "1L AS n_words", "1L AS n_features", "0L AS weight", "(id * 37) % 11 AS score")
    got = sorted((r.place, -r.score, r.doc_id) for r in importance.ranked(scored).collect())
    assert [p for p, *_ in got] == list(range(1, 5001))
    assert [r[1:] for r in got] == sorted(r[1:] for r in got)


# --- best fit -----------------------------------------------------------------------------------------------


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_chunks_give_the_ids_of_the_library(rows):
    own, tokenizer = bestfit.Words(file_tokenizer(path()), kept=50), file_tokenizer(path())
    odd = ["don't 'Ss ''s x's,y.'ll", "a\x1cb \x00 c\td", "İstanbul ΑΣ ǅ", "é é ½² ٣ ५", "<|endoftext|> </w>", "中文 字 テスト", "_a_ 1,2.3", " x y", "I'M we'RE"]
    rnd = random.Random(5)
    odd += ["".join(rnd.choice(" \nabcé.,!'sdS12_\t́Ω中") for _ in range(80)) for _ in range(300)]
    for text in [t or "" for _, t, _ in rows] + odd:
        assert own.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_best_fit_with_a_list_of_windows(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 100])
    histogram = {n: rnd.randrange(1, 30) for n in rnd.sample(range(1, capacity + 1), min(capacity, 25))}
    runs, _, sequences = bestfit.best_fit_decreasing(histogram, capacity)
    windows = []  # used, one piece after the other into the tightest window
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [(capacity - used, i) for i, used in enumerate(windows) if used + length <= capacity]
            if fits:
                windows[min(fits)[1]] += length
            else:
                windows.append(length)
    filled = Counter()
    at = {}
    for length, found in runs.items():
        assert sum(n for _, n, _, _ in found) == histogram[length]
        for begin, n, first, offset in found:
            assert [begin + k for k in range(n)] == list(range(begin, begin + n))
            for k in range(n):
                filled[first + k] += length
                at.setdefault(first + k, []).append((offset, length))
    assert sorted(filled.values()) == sorted(windows) and len(filled) == sequences
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length


def test_tightest_room_against_a_scan():
    rnd = random.Random(2)
    rooms = bestfit.Rooms(50)
    for _ in range(2000):
        room, length = rnd.randrange(51), rnd.randrange(1, 51)
        rooms.put(room, 0, rnd.randrange(3))
        want = min((r for r, held in rooms.ranges.items() if held and r >= length), default=None)
        assert rooms.tightest(length) == want
        if want is not None and rnd.random() < 0.7:
            rooms.take(want, 1)


def test_pieces_hold_every_id_once(messy, rows):
    got = bestfit.pack(messy, capacity=64).collect()
    tokenizer = file_tokenizer(path())
    want = Counter()
    for one, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), 64):
            part = ids[start : start + 64]
            want[one, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64


def test_padding_and_nothing(nothing):
    assert [bestfit.padding(n) for n in (1, 3, 1024, 4095, 4096)] == [0, 4093, 0, 1, 0]
    assert bestfit.query(nothing).collect() == []


# --- repair -------------------------------------------------------------------------------------------------


def code_of(role, fault):
    if fault in ("blank", "duplicate"):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault == "truncated" else initial


def test_audits_are_the_least_of_a_full_table():
    rnd = random.Random(1)
    for _ in range(1500):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["a.", "b", "", "c!", "d"]) + rnd.choice(["", "1", "2."])) for _ in range(rnd.randrange(14))]
        cost, audit, want, faults = brute_repair.repair(turns)
        codes = "".join(code_of(role, fault) for (role, _), fault in zip(turns, faults, strict=True))
        assert repair.whole_audit(codes) == audit
        assert repair.edited(codes, [t for t, c in zip(turns, codes, strict=True) if c != "x"], audit, 0) == (cost, list(want))


def test_blocks_reduce_to_the_matrix_of_all_their_turns():
    rnd = random.Random(4)
    for _ in range(300):
        items = [repair.turn_matrix(rnd.choice("suaoSUAOx")) for _ in range(12)]
        cut = rnd.randrange(1, 11)
        halves = [repair.block_matrix(items[:cut]), repair.block_matrix(items[cut:])]
        assert repair.block_matrix(halves) == repair.block_matrix(items)


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(9)
    out = []
    for conv in (None, 1, 2, 3, 4, 5):
        for t in range({1: 700, 2: 1}.get(conv, rnd.choice([3, 8, 60]))):
            turn = None if rnd.random() < 0.05 else rnd.randrange(t + 1) if rnd.random() < 0.3 else t
            text = rnd.choice([None, "", f"x.{t}.", "yes.", " \n", f"hm{t}", "ok!"])
            out.append((conv, turn, rnd.choice(["user", "assistant", "system", None, "tool", ""]), text))
    return out + [out[3]] * 40 + [(77, 16, "user", "gone")] + [(78, None, None, None)] * 2


@pytest.mark.parametrize(("rows_", "fan"), [(16, 4), (4096, 1024)])
def test_repairs_against_a_full_table(spark, talks, rows_, fan):
    given = spark.createDataFrame([(*t, "no", "no") for t in talks], "conv_id long, turn long, role string, text string, codes string, TURN string").repartition(3)
    fixed = written(repair.repaired(repair.damaged(given), rows_, 1 << 20, fan), "repaired")
    got = {r[0]: tuple(r[1:]) for r in repair.summaries(fixed).collect()}
    want = brute_repair.expected(talks)
    assert got == {conv: row for conv, row in want.items() if conv in got}
    gone = {conv for conv in want if conv not in got}
    assert gone == {conv for conv in want if conv not in {c for c, *_ in brute_repair.damage(talks)}}


def test_query_keeps_conversations_without_turns(spark):
    given = [(c, t, "user", "hi.") for c in range(160) for t in range(1 + c % 2)]
    got = {r[0]: tuple(r[1:]) for r in repair.query(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")).collect()}
    want = brute_repair.expected(given)
    assert got == want and len(got) == 160
    assert any(row[-2] == "" for row in want.values())
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.query(nothing).collect() == []


def test_a_text_of_a_megabyte_and_ids_of_another_type(spark):
    given = [("one", 0, "user", "y" * 1_000_000), ("one", 1, "assistant", "z" * 1_000_000 + "."), ("one", 5, "user", "."), (None, 0, "user", "?")]
    got = {r[0]: tuple(r[1:]) for r in repair.query(spark.createDataFrame(given, "conv_id string, turn long, role string, text string")).collect()}
    assert got == brute_repair.expected(given)
