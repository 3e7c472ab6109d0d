"""The contract of the repair query in plain Python, by a table of all places and states."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

WHITE = " \t\n\x0b\x0c\r"
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        for _ in range(2 if how == 3 else 1):
            yield conv, turn, "user" if how == 4 else role, text


def repair(rows):
    """Cost, audit and turns of the cheapest repair: least (cost, audit) over a table, from the end to the start."""
    n, faults, seen = len(rows), [], set()
    for role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {(n, 0): (0, "", ()), (n, 3): (0, "", ())}
    for i in range(n, -1, -1):
        for _ in range(3):  # insertions may follow one another
            for state in range(4):
                asked, name = NEXT[state]
                ways = [best[(n, state)]] if i == n and (n, state) in best else []
                if (i, asked) in best:
                    cost, audit, turns = best[(i, asked)]
                    ways.append((cost + 3, "I" + audit, ((name, ""), *turns)))
                if i < n:
                    role, text = rows[i]
                    extra = 3 if faults[i] == "truncated" else 0
                    edits = [("D", 4, state, ())]
                    if faults[i] not in ("blank", "duplicate"):
                        edits.append(("R", 3 + extra, asked, ((name, text),)))
                        if (state, role[:1]) in KEPT:
                            edits.append(("K", extra, KEPT[(state, role[:1])], ((role, text),)))
                    for edit, cost, after, turn in edits:
                        if (i + 1, after) in best:
                            more, audit, turns = best[(i + 1, after)]
                            ways.append((more + cost, edit + audit, turn + turns))
                if ways:
                    best[(i, state)] = min(ways)
    return *best[(0, 0)], faults


def expected(rows):
    """All columns of the query by conv_id; rows are (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, *_ in rows:
        groups[conv]
    for conv, turn, role, text in damage(rows):
        digest = hashlib.md5(text.encode()).digest()
        groups[conv].append(((turn is not None, turn or 0, role, digest), turn, role, text))
    out = {}
    for conv, held in groups.items():
        held.sort(key=lambda row: row[0])
        cost, audit, turns, faults = repair([(role, text) for _, _, role, text in held])
        known = [turn for _, turn, _, _ in held if turn is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [role[:1] for _, _, role, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = [faults.count(kind) for kind in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out
