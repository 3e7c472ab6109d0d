"""Packing of documents into sequences of fixed length: a configuration linear program over the length histogram.

Pieces. A document's ids end with an end mark. Only longer ones than a sequence are cut, into pieces of the full length; what is left over is the first
piece. Full pieces are sequences of their own.

Program. Minimise the number of sequences over all configurations (multisets of lengths that fit), covering the histogram. It has one row per
length, so its size doesn't grow with the corpus. It is solved by multiplicative weights: each round, a knapsack dynamic program prices all
capacities at once under the current weights; each length, longest first, gets the best configuration that holds it, if its value is within a
hundredth of the best of all, as often as half of what is left allows. Weights of lengths that are covered less than the mean rise by a factor, those of the
others fall.

Rounding. Running sums of the solution are rounded down, so that counts per length hardly move; configurations are clipped to what the histogram still
holds, and the items left go best fit, longest first, into the sequences with room and then into new ones.

Placing. Pieces of one length are numbered by a hash-salted running count (a length of a third of all pieces is spread over many groups) and a
piece's number is looked up among the places of its length. The table of places is bounded by rounds and lengths, not by the corpus.

Defined results: a null text is empty and is one piece, the end mark. Every row is packed, also where doc_id repeats or is null: pieces of each are numbered by
themselves. An empty table gives an empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.bpe import file_pieces
from quillspark.llm.common import bounded_batches, pick, texts, written

CAPACITY, END_ID, ROUNDS, RATE = 2048, 0, 32, 0.5
_NONE, _LEAST, _SLACK = 1e-9, 0.5, 0.01
Config = tuple[int, ...]  # lengths, longest first


# --- pieces -------------------------------------------------------------------------------------------------


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces_of(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each row."""
    bounded_batches(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = file_pieces(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for one, value in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
                ids = np.append(encoder.encode(value), np.uint32(end_id)).astype("<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((one, number, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the program --------------------------------------------------------------------------------------------


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value within each capacity, and the length taken there (0: none, go one down)."""
    lengths = np.flatnonzero(values > 0)
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int32)
    if not len(lengths):
        return best, take
    gain = values[lengths]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(lengths, c, side="right")
        if n:
            total = best[c - lengths[:n]] + gain[:n]
            k = int(total.argmax())
            if total[k] > best[c]:
                best[c], take[c] = total[k], lengths[k]
    return best, take


def fractional(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> dict[Config, float]:
    """Configurations and how often each is used; together they use no length more often than the histogram has it."""
    if not histogram:
        return {}
    lengths = np.array(sorted(histogram, reverse=True))
    demand, left = np.zeros(capacity + 1), np.zeros(capacity + 1)
    for length, n in histogram.items():
        demand[length] = left[length] = n
    # A sequence's worth is shared by length at first.
    weights = np.arange(capacity + 1) / capacity
    solution: dict[Config, float] = defaultdict(float)
    for _ in range(rounds):
        best, take = price(np.where(left > _NONE, weights, 0), capacity)
        # Half of what is left may go in one round, so that weights can still turn the rest elsewhere.
        budget = np.where(left > 2 * _LEAST, left * 0.5, left)
        for length in lengths[left[lengths] > _NONE].tolist():
            config, room = [length], capacity - length
            while room > 0:
                if item := int(take[room]):
                    config.append(item)
                    room -= item
                else:
                    room -= 1
            need = Counter(config)
            times = min(budget[item] / n for item, n in need.items())
            if times <= _NONE or weights[config].sum() < (1 - _SLACK) * best[capacity]:
                continue
            solution[tuple(sorted(config, reverse=True))] += times
            for item, n in need.items():
                budget[item] -= n * times
                left[item] -= n * times
        open_share = left[lengths] / demand[lengths]
        if (left[lengths] * lengths).sum() < _LEAST * capacity:
            break
        weights[lengths] *= np.exp(rate * (open_share - open_share.mean()))
    return solution


def rounded(solution: dict[Config, float], histogram: dict[int, int], capacity: int) -> dict[Config, int]:
    """Whole numbers of configurations that hold the histogram exactly."""
    left = Counter(histogram)
    counts: Counter[Config] = Counter()
    total, given = 0.0, 0
    # In the order of their longest items, neighbours stand in for each other when sums are rounded.
    for config in sorted(solution, reverse=True):
        total += solution[config]
        need = Counter(config)
        times = min(int(total + 1e-6) - given, *(left[item] // n for item, n in need.items()))
        if times > 0:
            counts[config] += times
            given += times
            for item, n in need.items():
                left[item] -= n * times
    return best_fit(counts, +left, capacity)


def best_fit(counts: dict[Config, int], items: dict[int, int], capacity: int) -> dict[Config, int]:
    """Put ``items``, longest first, where they leave the least room: into configurations in use, then into new ones."""
    counts = Counter(counts)
    by_room: dict[int, set[Config]] = defaultdict(set)
    for config in counts:
        by_room[capacity - sum(config)].add(config)
    rooms = sorted(room for room in by_room if room > 0)

    def put(config: Config, times: int) -> None:
        if config not in counts or counts[config] == 0:
            room = capacity - sum(config)
            if not by_room[room] and room > 0 and (not rooms or room not in rooms):
                bisect.insort(rooms, room)
            by_room[room].add(config)
        counts[config] += times

    for item in sorted(items, reverse=True):
        n = items[item]
        while n > 0:
            at = bisect.bisect_left(rooms, item)
            if at < len(rooms):
                room = rooms[at]
                config = next(iter(by_room[room]))
                times = min(n, counts[config])
                counts[config] -= times
                if counts[config] == 0:
                    del counts[config]
                    by_room[room].discard(config)
                    if not by_room[room]:
                        rooms.pop(at)
                put(tuple(sorted((*config, item), reverse=True)), times)
                n -= times
            else:
                fit = min(n, capacity // item)
                put((item,) * fit, n // fit)
                n -= fit * (n // fit)
    return {config: n for config, n in counts.items() if n}


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[Config, int]:
    """Configurations and how many sequences use each; together they hold the histogram exactly."""
    whole = {(capacity,): histogram[capacity]} if histogram.get(capacity) else {}
    rest = {length: n for length, n in histogram.items() if length < capacity and n}
    return whole | rounded(fractional(rest, capacity, rounds), rest, capacity)


def places(configs: dict[Config, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: numbers from which on pieces go to a run of sequences, the first sequence, the offset there."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    number: Counter[int] = Counter()
    sequence = 0
    for config in sorted(configs, reverse=True):
        offset = 0
        for item in config:
            rows[item].append((number[item], sequence, offset))
            number[item] += configs[config]
            offset += item
        sequence += configs[config]
    return {length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in rows.items()}


# --- jobs ---------------------------------------------------------------------------------------------------


def numbered(pieces: DataFrame, rows_per_group: int = 50_000) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, 2, … within each length, in groups of bounded size."""
    n = pieces.count()
    # Every row has its own place in this order, so a task that runs again gives the same numbers.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(1 + n // rows_per_group)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")
    return (
        salted.withColumn("in_group", F.row_number().over(inside))
        .join(starts, ["length", "salt"])
        .withColumn("number", F.col("from") + F.col("in_group") - 1)
        .drop("salt", "from", "in_group", "row")
    )


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    made = pieces_of(docs, doc_id, text, tokenizer, capacity, end_id)
    # Numbers of a few bytes per piece; the texts are encoded once. The row number is fixed by the written table.
    pieces = written(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # At most one row per length.
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = places(solve(histogram, capacity, rounds))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lengths, numbers = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                mine = lengths == length
                starts, first, offsets = table[length]
                at = np.searchsorted(starts, numbers[mine], side="right") - 1
                sequence[mine] = first[at] + numbers[mine] - starts[at]
                offset[mine] = offsets[at]
            kept = [batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered(pieces).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
