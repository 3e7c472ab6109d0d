"""Repair of the structure of conversations by divide and conquer over the turns.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Four states say how far it has come: 0 nothing yet, 1 after a system turn, 2 after a
user's, 3 after an assistant's. Keep costs 0, Rerole 3, Delete 4, Insert 3; blank and repeated turns must go; truncated turns that stay cost 3 more. From each
state an edit leads to one other state, so an audit, the initials of the edits in order, says all.

Hirschberg. What a turn does is a small matrix: from each state to each, the least cost and the least audit of that cost. A forward vector of four costs over the first
half and a backward one over the second meet in the middle; the state where their sum is least is the crossing. Costs may tie, so the forward vector also ranks its states by
audit: audits that end with a turn's own edit can't begin one another, so ranks can be carried on without the audits, and the least rank is the least audit.
Both halves recurse with their end states known. Only four numbers are held for each half.

Spark. Turns are sorted by range, so a conversation of any length is spread over tasks, and are cut into blocks of bounded rows and bytes. A conversation in one block is
solved there. For others each block is reduced to a matrix of its own, ``fan`` blocks to a parent's, and so on to one; the crossings between blocks are found by the same
recursion on the way down, each block is solved for itself, and only the digest of the whole reads blocks one after the other.

Defined results: turns go by turn (nulls first), role and MD5 of the text. Null roles and texts are one space, as is a null in what is hashed for the damage. A null
conv_id is one conversation. Equal rows are duplicates of the first. Without turns left a conversation has zeros, an empty audit and the digest of the empty text; an
empty table gives an empty result. Texts of any length are carried whole. Other columns may have any names, also clashing ones.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, bounded_batches, pick, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK, BLOCK_BYTES, FAN = 4096, 4 << 20, 1024
LEGAL = frozenset(("su", "ua", "au"))
#: The state after a turn of the role that each state asks for, and that role.
_NEXT = (2, 2, 3, 2)
_ASKED = ("user", "user", "assistant", "user")
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Insertions that complete a conversation ending in each state.
_TAIL = (0, 2, 1, 0)
_NEVER = 1 << 60

#: From each state: (state after, least cost, order among audits from there).
Matrix = tuple[tuple[tuple[int, int, object], ...], ...]


# --- one turn -----------------------------------------------------------------------------------------------


@functools.cache
def turn_matrix(code: str) -> Matrix:
    """``code``: x for a turn that must go, else the role's initial (o for others), upper case where truncated. The order is the audit itself."""
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state = start
        for n in range(3):  # insertions before the turn; three would lead to a state met before
            edits = [("D", DELETE, state)]
            if code != "x":
                extra = TRUNCATED if code.isupper() else 0
                edits.append(("R", REROLE + extra, _NEXT[state]))
                if code.lower() in _KEPT[state]:
                    edits.append(("K", KEEP + extra, _KEPT[state][code.lower()]))
            for edit, cost, stop in edits:
                found = (n * INSERT + cost, "I" * n + edit)
                best[stop] = min(best.get(stop, found), found)
            state = _NEXT[state]
        out.append(tuple((stop, *found) for stop, found in sorted(best.items())))
    return tuple(out)


# --- vectors and crossings ----------------------------------------------------------------------------------


def forward(items: Sequence[Matrix], start: int) -> dict[int, tuple[int, int]]:
    """By state after the items: least cost from ``start``, and its audit's rank among the four."""
    vector = {start: (0, 0)}
    for item in items:
        best: dict[int, tuple] = {}
        for state, (cost, rank) in vector.items():
            for stop, more, order in item[state]:
                found = (cost + more, rank, order)
                if stop not in best or found < best[stop]:
                    best[stop] = found
        ranked = sorted(best, key=lambda stop: best[stop][1:])
        vector = {stop: (best[stop][0], rank) for rank, stop in enumerate(ranked)}
    return vector


def backward(items: Sequence[Matrix], stop: int) -> list[int]:
    """By state before the items: least cost to ``stop``."""
    vector = [_NEVER] * 4
    vector[stop] = 0
    for item in reversed(items):
        vector = [min((more + vector[after] for after, more, _ in row), default=_NEVER) for row in item]
    return vector


def crossings(items: Sequence[Matrix], start: int, stop: int) -> list[int]:
    """The state after each item on the cheapest way from ``start`` to ``stop``, ties by audit."""
    if len(items) == 1:
        return [stop]
    middle = len(items) // 2
    ahead, behind = forward(items[:middle], start), backward(items[middle:], stop)
    cross = min(ahead, key=lambda state: (ahead[state][0] + behind[state], ahead[state][1]))
    return crossings(items[:middle], start, cross) + crossings(items[middle:], cross, stop)


def end_state(vector: dict[int, tuple[int, int]]) -> int:
    """Where a conversation's last turn leaves it, insertions after it counted."""
    return min(vector, key=lambda state: (vector[state][0] + _TAIL[state] * INSERT, vector[state][1]))


def audit_of(codes: str, start: int, stop: int) -> str:
    items = [turn_matrix(code) for code in codes]
    states = [start, *crossings(items, start, stop)]
    steps = zip(items, states, states[1:], strict=False)
    return "".join(next(order for after, _, order in item[a] if after == b) for item, a, b in steps)


def whole_audit(codes: str) -> str:
    if not codes:
        return ""
    stop = end_state(forward([turn_matrix(code) for code in codes], 0))
    return audit_of(codes, 0, stop) + "I" * _TAIL[stop]


@functools.lru_cache(maxsize=1 << 16)
def _short_audit(codes: str) -> str:
    """Short conversations look alike; their audits are kept, a bounded number of them."""
    return whole_audit(codes)


def block_matrix(items: Sequence[Matrix]) -> Matrix:
    """Several items as one."""
    return tuple(tuple(sorted((stop, *found) for stop, found in forward(items, start).items())) for start in range(4))


def edited(codes: str, turns: list[tuple[str, str]], audit: str, state: int) -> tuple[int, list[tuple[str, str]]]:
    """Cost of an audit, and the turns after it. ``turns`` has no entry for those with code x."""
    cost, out, given, coded = 0, [], iter(turns), iter(codes)
    for edit in audit:
        if edit == "I":
            cost += INSERT
            out.append((_ASKED[state], ""))
            state = _NEXT[state]
            continue
        code = next(coded)
        role, text = next(given) if code != "x" else ("", "")
        if edit == "D":
            cost += DELETE
            continue
        cost += TRUNCATED if code.isupper() else 0
        if edit == "R":
            cost += REROLE
            role, state = _ASKED[state], _NEXT[state]
        else:
            state = _KEPT[state][code.lower()]
        out.append((role, text))
    return cost, out


# --- rows ---------------------------------------------------------------------------------------------------


def damaged(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows dropped (no copies), emptied, robbed of their ends, repeated or given to the user, by a hash of their place."""
    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text).withColumn("turn", F.col("turn").cast("long"))
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    how = F.crc32(place.cast("binary")) % 20
    said = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(how == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _same(key: str, other: str) -> Column:
    return F.col(key).eqNullSafe(F.col(other))


def distinct_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, end, first, copies, text``: rows of ``damaged`` that are equal throughout are one; ``first`` if none earlier has role and text.

    ``end`` is the last character that is no white space. Duplicates go without their text.
    """
    held = turns.where("copies > 0").withColumns(
        {"digest": F.unhex(F.md5("text")), "end": F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)}
    )
    # Role and text found more than once: a partial aggregate, then a table of its own, which Spark broadcasts where its size allows.
    found = held.groupBy("conv_id", "role", "digest").agg(
        F.sum("copies").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least")
    )
    repeats = written(
        found.where("n > 1").select(F.col("conv_id").alias("r_conv"), F.col("role").alias("r_role"), F.col("digest").alias("r_digest"), "least"),
        "repeats",
    )
    on = _same("conv_id", "r_conv") & (F.col("role") == F.col("r_role")) & (F.col("digest") == F.col("r_digest"))
    known = held.join(repeats, on, "left").withColumn("first", F.col("least").isNull() | _same("turn", "least.turn"))
    names = ("conv_id", "turn", "role", "digest", "end", "first")
    once = known.where("least IS NULL").select(*names, "copies", "text")
    # Equal rows meet in a partial aggregate, so a hot one is a single row per task.
    text = F.max(F.when(F.col("first"), F.col("text"))).alias("text")
    again = known.where("least IS NOT NULL").groupBy(*names).agg(F.sum("copies").alias("copies"), text)
    return once.unionByName(again)


_COUNTS = ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns", "first_turn", "last_turn")


class _Block:
    """Turns of one conversation that follow one another."""

    def __init__(self, conv_id: object):
        self.conv_id, self.size, self.codes = conv_id, 0, []
        self.turns: list[dict] = []
        self.counts = dict.fromkeys(_COUNTS[:5], 0) | dict.fromkeys(_COUNTS[5:])
        self.head = self.tail = None

    def add(self, turn: int | None, role: str, text: str | None, end: str, first: bool, copies: int) -> None:
        """Rows equal throughout, of which the first may be sound."""
        initial, counts = role[:1], self.counts
        sound = bool(end) and first
        if sound:
            code = initial if initial in ("s", "u", "a") else "o"
            cut = end not in ".!?"
            counts["n_truncated"] += cut
            self.codes.append(code.upper() if cut else code)
            self.turns.append({"role": role, "text": text})
            self.size += len(role) + len(text)
        self.codes.append("x" * (copies - sound))
        counts["n_duplicate" if end else "n_blank"] += copies - sound
        legal = initial + initial in LEGAL
        counts["n_illegal"] += (copies - 1) * (not legal) + (self.tail is not None and self.tail + initial not in LEGAL)
        self.head, self.tail = initial if self.head is None else self.head, initial
        if turn is not None and turn != counts["last_turn"]:
            counts["n_turns"] += 1
            counts["last_turn"] = turn
            if counts["first_turn"] is None:
                counts["first_turn"] = turn
        self.size += copies


def blocks(turns: DataFrame, rows: int = BLOCK, size: int = BLOCK_BYTES) -> DataFrame:
    """Turns of ``distinct_turns`` in order, in blocks of some ``rows`` rows or ``size`` characters; ``alone`` if a block is a whole conversation."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, at long, alone boolean, codes string, head string, tail string, "
        + ", ".join(f"{name} long" for name in _COUNTS)
        + ", turns array<struct<role: string, text: string>>"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, bool]]:
        """Blocks and whether each is known to be a whole conversation: the first and the last of a task may go on elsewhere."""
        now: _Block | None = None
        before = False  # an earlier conversation ended within this task
        split = False
        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("conv_id", "turn", "role", "text", "end", "first", "copies")]
            for conv_id, turn, role, text, end, first, copies in zip(*columns, strict=True):
                if now is not None and now.conv_id != conv_id:
                    yield now, before and not split
                    now, before, split = None, True, False
                while copies:
                    if now is not None and (sum(map(len, now.codes)) >= rows or now.size >= size):
                        yield now, False
                        now, split = None, True
                    now = now or _Block(conv_id)
                    part = min(copies, rows)
                    now.add(turn, role, text, end, first, part)
                    copies, first = copies - part, False
        if now is not None:
            yield now, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, out, held = TaskContext.get().partitionId() << 33, None, [], 0
        types: dict[str, pa.DataType] = {}

        def batch_of() -> pa.RecordBatch:
            lists = {
                "conv_id": [b.conv_id for _, b, _ in out], "at": [at for at, _, _ in out], "alone": [alone for _, _, alone in out],
                "codes": ["".join(b.codes) for _, b, _ in out], "head": [b.head for _, b, _ in out], "tail": [b.tail for _, b, _ in out],
                **{name: [b.counts[name] for _, b, _ in out] for name in _COUNTS}, "turns": [b.turns for _, b, _ in out],
            }
            return pa.RecordBatch.from_arrays([pa.array(v, types[name]) for name, v in lists.items()], names=list(lists))

        def seen(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in given:
                types["conv_id"] = batch.schema.field("conv_id").type
                yield batch

        types |= {"at": pa.int64(), "alone": pa.bool_(), "codes": pa.string(), "head": pa.string(), "tail": pa.string()}
        types |= {name: pa.int64() for name in _COUNTS} | {"turns": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
        for number, (block, alone) in enumerate(cut(seen(batches))):
            out.append((part + number, block, alone))
            held += block.size
            if held >= size:
                yield batch_of()
                out, held = [], 0
        if out:
            yield batch_of()

    bounded_batches(turns.sparkSession)
    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


# --- crossings between blocks -------------------------------------------------------------------------------


_MATRIX = "matrix array<array<array<long>>>"


def _matrices(group: pd.DataFrame) -> list[Matrix]:
    return [tuple(tuple(map(tuple, row)) for row in matrix) for matrix in group.sort_values("index")["matrix"]]


def _listed(matrix: Matrix) -> list:
    return [[list(entry) for entry in row] for row in matrix]


def ends(split: DataFrame, fan: int = FAN) -> DataFrame:
    """``at, start, stop, last`` for blocks of conversations that have several, or may have."""
    kind = split.schema["conv_id"].dataType.simpleString()

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrices = [_listed(block_matrix([turn_matrix(code) for code in codes])) for codes in batch["codes"]]
            yield batch[["conv_id", "at"]].assign(matrix=matrices)

    slim = written(split.select("conv_id", "at", "codes").mapInPandas(reduced, f"conv_id {kind}, at long, {_MATRIX}"), "blocks")
    # One small row per block; sorted with spilling, not collected.
    numbered = slim.selectExpr(
        "conv_id", "at", "matrix", "row_number() OVER (PARTITION BY conv_id ORDER BY at) - 1L AS index", "lead(at) OVER (PARTITION BY conv_id ORDER BY at) IS NULL AS last"
    )
    level = written(numbered, "blocks")
    states = _descend(level.select("conv_id", "index", "matrix"), fan, kind)
    s = states.select(F.col("conv_id").alias("s_conv"), F.col("index").alias("s_index"), "start", "stop")
    return level.join(s, _same("conv_id", "s_conv") & (F.col("index") == F.col("s_index"))).select("at", "start", "stop", "last")


def _descend(level: DataFrame, fan: int, kind: str) -> DataFrame:
    """``conv_id, index, start, stop`` of each node of a level: up to one node per conversation, and down again."""
    schema = f"conv_id {kind}, index long, start int, stop int"
    if not level.where("index > 0").head(1):

        def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                stops = [end_state(forward(_matrices(batch.iloc[[i]]), 0)) for i in range(len(batch))]
                yield batch[["conv_id", "index"]].assign(start=0, stop=stops)

        return level.mapInPandas(top, schema)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        matrix = _listed(block_matrix(_matrices(group)))
        return group[["conv_id", "index"]].head(1).assign(index=group["index"].min() // fan, matrix=[matrix])

    def crossed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("index")
        start, stop = int(group["p_start"].iloc[0]), int(group["p_stop"].iloc[0])
        states = crossings(_matrices(group), start, stop)
        return group[["conv_id", "index"]].assign(start=[start, *states[:-1]], stop=states)

    parent = F.floor(F.col("index") / fan)
    above = _descend(written(level.groupBy("conv_id", parent.alias("parent")).applyInPandas(joined, f"conv_id {kind}, index long, {_MATRIX}"), "blocks"), fan, kind)
    p = above.select(F.col("conv_id").alias("p_conv"), F.col("index").alias("p_index"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"))
    both = level.join(p, _same("conv_id", "p_conv") & (parent == F.col("p_index")))
    return both.groupBy("conv_id", "p_index").applyInPandas(crossed, schema)


# --- jobs ---------------------------------------------------------------------------------------------------


def repaired(turns: DataFrame, rows: int = BLOCK, size: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Blocks of the conversations in ``turns`` (of ``damaged``): counts, ``cost``, ``audit``, and the repaired ``turns``, in the order of ``at``."""
    made = written(blocks(distinct_turns(turns), rows, size), "repair")
    split = made.where("NOT alone")
    whole = made.where("alone").selectExpr("*", "0 AS start", "-1 AS stop", "true AS last")
    found = ends(split, fan).withColumnRenamed("at", "e_at")
    rest = split.join(found, F.col("at") == F.col("e_at")).select(*made.columns, "start", "stop", "last")
    both = whole.unionByName(rest)
    kept = ["conv_id", "at", "alone", "head", "tail", *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits, texts = [], [], []
            given = (batch[name].to_pylist() for name in ("codes", "turns", "start", "stop", "last"))
            for codes, own, start, stop, last in zip(*given, strict=True):
                if stop < 0:
                    audit = _short_audit(codes) if len(codes) <= 64 else whole_audit(codes)
                else:
                    audit = audit_of(codes, start, stop) + ("I" * _TAIL[stop] if last else "")
                cost, left = edited(codes, [(t["role"], t["text"]) for t in own], audit, start)
                costs.append(cost)
                audits.append(audit)
                texts.append([{"role": role, "text": text} for role, text in left])
            arrays = [*(batch[c] for c in kept), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(texts, batch["turns"].type)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "cost", "audit", "turns"])

    types = {f.name: f.dataType.simpleString() for f in made.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "cost long", "audit string", f"turns {types['turns']}"])
    return both.mapInArrow(run, schema)


def summaries(fixed: DataFrame) -> DataFrame:
    """One row per conversation from the blocks of ``repaired``. The digest runs over all of a conversation's text, so blocks of one are read in order in one task."""
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kind = fixed.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        sums, now, audits, digest, begun = {}, None, [], hashlib.sha256(), False
        tail = last_turn = first_turn = None

        def closed() -> tuple:
            gaps = last_turn - first_turn + 1 - sums["n_turns"] if first_turn is not None else 0
            rest = (sums[n] for n in ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "cost"))
            return now, gaps, *rest, "".join(audits), digest.hexdigest()

        fresh, kind_of = True, pa.null()
        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if fresh or row["conv_id"] != now:
                    if not fresh:
                        out.append(closed())
                    fresh, now, audits, digest, begun = False, row["conv_id"], [], hashlib.sha256(), False
                    sums = dict.fromkeys((*_COUNTS[:5], "cost"), 0)
                    tail = last_turn = first_turn = None
                for name in sums:
                    sums[name] += row[name]
                sums["n_illegal"] += tail is not None and tail + row["head"] not in LEGAL
                tail = row["tail"]
                if row["first_turn"] is not None:
                    sums["n_turns"] -= row["first_turn"] == last_turn
                    first_turn = row["first_turn"] if first_turn is None else first_turn
                    last_turn = row["last_turn"]
                audits.append(row["audit"])
                for turn in row["turns"]:
                    digest.update((("\n" if begun else "") + turn["role"] + ":" + turn["text"]).encode())
                    begun = True
            if len(out) > 1000:
                yield _rows(out, kind_of)
                out = []
        if not fresh:
            out.append(closed())
            yield _rows(out, kind_of)

    def _rows(out: list[tuple], kind_of: pa.DataType) -> pa.RecordBatch:
        types = [kind_of, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["conv_id", *names, "audit", "repaired_sha256"]
        )

    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string"
    in_order = fixed.where("NOT alone").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return fixed.where("alone").mapInArrow(run, schema).unionByName(in_order.mapInArrow(run, schema))


def query(conversations: DataFrame) -> DataFrame:
    """Conversations damaged, repaired and summed up; those without turns left have a row of zeros."""
    turns = damaged(conversations)
    found = summaries(written(repaired(turns), "repaired"))
    gone = turns.groupBy("conv_id").agg(F.sum("copies").alias("n")).where("n = 0")
    zeros = [F.lit(0).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = gone.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    return found.unionByName(empty)
