"""Near copies by five-word shingles: recall on planted pairs, and nothing else merged."""

import random
from collections import defaultdict

import numpy as np
import pytest
from messy_rows import messy, nothing, rows  # noqa: F401

from quillspark.llm import simhash


def jaccard(a, b):
    one, other = (set(simhash.shingle_hashes(x.encode()).tolist()) for x in (a, b))
    return len(one & other) / len(one | other) if one or other else 1.0


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(11)
    originals = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(150, 500))] for _ in range(150)]
    out = [(10 * i, " ".join(words)) for i, words in enumerate(originals)]
    for i, words in enumerate(originals[:120]):
        for k in range(1, 4):
            changed = list(words)
            for at in rnd.sample(range(len(words)), max(1, int(len(words) * rnd.uniform(0.002, 0.025)))):
                changed[at] = f"new{rnd.randrange(10**6)}"
            out.append((10 * i + k, " ".join(changed)))
    return out


def test_nine_of_ten_planted_pairs_are_linked(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(4)
    group = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    text = dict(planted)
    bands = defaultdict(list)
    for one in text:
        for other in range(one - one % 10, one):
            if other in text and (likeness := jaccard(text[one], text[other])) >= 0.8:
                bands[min(int((likeness - 0.8) / 0.05), 3)].append(group[one] == group[other])
    assert sorted(bands) == [0, 1, 2, 3] and min(map(len, bands.values())) >= 30
    assert {band: np.mean(found) for band, found in bands.items() if np.mean(found) < 0.9} == {}
    assert all(group[doc] // 10 == doc // 10 for doc in text)  # no other documents are linked
    kept = {r.doc_id for r in simhash.near_representatives(docs).collect()}
    assert kept == set(group.values())


def test_no_link_between_groups_is_lost(spark):
    """Pairs above the threshold that share neither a sample nor a SimHash within three bits."""
    rnd, docs = random.Random(5), []
    while len(docs) < 8:
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(60, 160))]
        changed = list(words)
        for at in rnd.sample(range(len(words)), max(1, len(words) // 48)):
            changed[at] = f"new{rnd.randrange(10**6)}"
        one, other = (simhash.shingle_hashes(" ".join(x).encode()) for x in (words, changed))
        samples = any(x == y for x, y in zip(simhash.sampled(one), simhash.sampled(other), strict=True))
        if not samples and (simhash.majority(one) ^ simhash.majority(other)).bit_count() > 3 and jaccard(" ".join(words), " ".join(changed)) >= 0.8:
            docs += [(10 * len(docs), " ".join(words)), (10 * len(docs) + 1, " ".join(changed))]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {doc: doc // 10 * 10 for doc, _ in docs}


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_groups_are_those_of_all_pairs(spark, similarity):
    """Passages shared by many texts, and copies of them with a few words changed, against all pairs."""
    rnd = random.Random(3)
    passages = [[f"p{i}x{k}" for k in range(30)] for i in range(6)]
    texts = []
    for _ in range(150):
        words = [w for p in rnd.sample(passages, rnd.randrange(1, 5)) for w in p] + [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(0, 40))]
        if rnd.random() < 0.6 and texts:
            words = rnd.choice(texts).split()
            for at in rnd.sample(range(len(words)), 1 + len(words) // rnd.randrange(35, 70)):
                words[at] = f"new{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    group = list(range(len(texts)))
    for one in range(len(texts)):
        for other in range(one):
            if jaccard(texts[one], texts[other]) >= similarity:
                least, most = sorted((group[one], group[other]))
                group = [least if g == most else g for g in group]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity).collect()}
    assert got == dict(enumerate(group))
    assert 30 < len(set(group)) < len(texts) - 20


def test_prefixes_meet_in_any_order():
    rnd = np.random.default_rng(1)
    hashes = np.unique(rnd.integers(0, 1 << 63, 200, np.uint64))
    frequent = np.sort(hashes[::3])
    ordered = simhash.in_order(hashes, frequent, np.arange(len(frequent), 0, -1))
    assert sorted(ordered.tolist()) == hashes.tolist() and ordered[-1] == frequent[0]
    other = np.unique(np.append(hashes[20:], rnd.integers(0, 1 << 63, 15, np.uint64)))
    differ = len(np.setxor1d(hashes, other))
    apart = sum((int(x) ^ int(y)).bit_count() for x, y in zip(simhash.parities(hashes).view(np.uint64), simhash.parities(other).view(np.uint64), strict=True))
    assert 0 < apart <= differ


def test_links_are_similar_by_exact_sets(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = [*words[:50], "x", *words[51:]], [*words[:20], *(f"y{i}" for i in range(40)), *words[60:]]
    docs = spark.createDataFrame([(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (7, " ".join(words).upper())], "doc_id long, text string")
    assert jaccard(" ".join(words), " ".join(near)) >= 0.8 > jaccard(" ".join(words), " ".join(far))
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()} == {3: 1, 1: 1, 7: 1, 2: 2}


def test_messy_rows_and_none(messy, rows, nothing):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_groups(messy).collect())
    sets = defaultdict(set)
    for one, text, _ in rows:
        sets[simhash.shingle_hashes((text or "").encode()).tobytes()].add(one)
    assert len(got) == len(rows)
    groups = {(doc if not null else None): least for null, doc, least in got}
    for held in sets.values():
        if None not in held and all(sum(1 for i, *_ in rows if i == d) == 1 for d in held):
            assert len({groups[d] for d in held}) == 1 and groups[min(held)] <= min(held)
    kept = simhash.near_representatives(messy)
    assert kept.columns == messy.columns and kept.count() == sum(1 for null, doc, least in got if (None if null else doc) == least)
    assert simhash.near_groups(nothing).collect() == []


def test_a_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole, samples = simhash.shingle_hashes(text), simhash.sampled(simhash.shingle_hashes(text))
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert np.array_equal(simhash.shingle_hashes(text), whole) and simhash.sampled(whole) == samples
    assert len(simhash.shingle_hashes(b"x" * 1_000_000)) == 1 and simhash.majority(np.zeros(0, np.uint64)) == 0
