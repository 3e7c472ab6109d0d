"""Personal data in long runs and in texts of many spans: the same matches as the patterns', in time that grows with the text."""

import random
import re
import time

from quillspark.llm import pii


def by_pattern(text):
    """What the fixed patterns find on their own."""
    ips = [m.span() for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.groups())]
    return [m.span() for m in pii.EMAIL.finditer(text)], ips


def test_same_matches_as_the_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "_", "-", " ", "1", "25", "256", "1.2.3.4", "x@y.zz", "é", "@@", "..", "%", "\n"]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        spans = pii.plain_spans(text)
        want = by_pattern(text)
        assert [s[1:] for s in spans if s[0] == "email"] == want[0], text
        assert [s[1:] for s in spans if s[0] == "ip"] == want[1], text


def test_name_longer_than_a_step_back():
    for n in (63, 64, 65, 200, 5000):
        assert pii.plain_spans(f"x {'a' * n}@b.cd")[0] == ("email", 2, n + 7)
        assert pii.plain_spans(f"{'a' * n}@b.cd")[0] == ("email", 0, n + 5)
        assert [s[1:] for s in pii.plain_spans(f"q@b.cd_{'a' * n}@b.cd")] == [(0, 6), (6, n + 12)]


def seconds(text):
    start = time.perf_counter()
    pii.all_spans(text)
    return time.perf_counter() - start


def test_a_megabyte_without_a_space():
    for text in ("7" * 1_000_000 + " 1.2", "a" * 1_000_000 + " at @", "Zm9v" * 250_000 + " @", "a@" * 500_000, "1." * 500_000, "é" + "9" * 1_000_000 + " [at]"):
        assert seconds(text) < 5, text[:20]


def test_many_spans():
    rows = "".join(f"user{i}@host.org, call one two three four, 10.0.0.{i % 256} name{i} at host dot com; " for i in range(8000))
    start = time.perf_counter()
    plain, added = pii.all_spans(rows)
    assert time.perf_counter() - start < 8
    assert len(plain) == 16_000 and sum(k == "email" for k, _, _ in added) == 8000
    assert re.fullmatch(r"name\d+ at host dot com", rows[added[0][1] : added[0][2]])
