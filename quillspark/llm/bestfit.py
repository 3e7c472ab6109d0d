"""Packing by best-fit decreasing: a segment tree over remaining capacities finds the tightest open window.

Pieces. A document's ids end with an end mark. Overlong documents are first cut into full windows, which are sequences of their own; what is left
over at the end goes best fit. No other piece is cut but the tail below.

Best fit. The histogram of lengths, longest first, is all the packing has to know, so its size doesn't grow with the corpus. Windows that
are filled alike are one range of sequence numbers. The segment tree has one leaf for each remaining capacity and knows which ones any open range
has; descending it gives the least capacity that holds the piece. The ``n`` pieces of one length go there together: a range that is longer
than needed is split in two, and a length that fits nowhere opens new windows. Each step is a run (length, first piece, pieces, first sequence, offset).

Padding. A sequence is padded to the capacity unless its length is a power of two; ``padding`` says by how much in all. Documents shorter than a
window are not cut to fill gaps: where many short pieces follow the long ones, as in most corpora, hardly any gap is left.

Placing. Pieces of one length are numbered while they are made, task by task; a sum over the tasks' counts makes the numbers run through, so
no hot length comes together in one group. A number is looked up among the runs of its length.

Defined results: a null text is empty and is one piece, the end mark. Every row is packed, also where doc_id repeats or is null; ties in length go by
input split and row. An empty table gives an empty result. Texts of any length are encoded whole, in slabs of about a million characters. Other
columns may have any names, also clashing ones.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.bpe import file_tokenizer, slabs
from quillspark.llm.common import bounded_batches, pick, texts, written

CAPACITY, END_ID = 4096, 2
KEPT_CHUNKS, LONGEST_KEPT = 600_000, 48
#: How the tokenizer of the file splits words, for text in lower case.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN_BELOW = "֐"  # Latin, Greek, Cyrillic, Armenian

Run = tuple[int, int, int, int]  # first piece, pieces, first sequence, offset


# --- ids ----------------------------------------------------------------------------------------------------


class Words:
    """Ids of texts, put together from those of chunks between spaces and line feeds, as the tokenizer drops white space.

    Chunks met lately are known, up to ``kept`` in each of two generations. Unknown ones are split into words; unknown words are asked for as one text, in
    which the mark at each word's last token tells them apart. Anything unusual is asked for by itself.
    """

    def __init__(self, tokenizer, kept: int = KEPT_CHUNKS, suffix: str = "</w>"):
        self.tokenizer, self.kept = tokenizer, kept
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        ids = self._encode(" ".join(words))
        ends = np.flatnonzero(self.last[np.frombuffer(ids, np.uint32)]) + 1
        if len(ends) != len(words) or 4 * ends[-1] != len(ids):
            return [self._encode(word) for word in words]
        cuts = [0, *(4 * ends).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        known, older = self.known.get, self.older.get
        found: dict[str, bytes] = {}
        split: list[tuple[str, list[str]]] = []
        words: dict[str, bytes | None] = {}
        for chunk in missing:
            ids = older(chunk)
            if ids is not None:
                found[chunk] = ids
            elif not (chunk.isprintable() and (chunk.isascii() or (max(chunk) < _PLAIN_BELOW and is_normalized("NFC", chunk)))):
                found[chunk] = self._encode(chunk)
            elif chunk.isalpha():
                words[chunk] = None
            else:
                # The usual case without the pattern: a word and one sign after it.
                parts = [chunk[:-1], chunk[-1]] if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha() else _WORDS.findall(chunk)
                split.append((chunk, parts))
                for word in parts:
                    if word not in words:
                        words[word] = known(word) or older(word)
        ask = [word for word, ids in words.items() if ids is None]
        if ask:
            words.update(zip(ask, self._encode_words(ask), strict=True))
        for chunk, parts in split:
            found[chunk] = b"".join([words[word] for word in parts])
        found.update(words)
        if len(self.known) + len(found) > self.kept:
            self.older, self.known = self.known, {"": b""}
        if max(map(len, found)) <= LONGEST_KEPT:
            self.known.update(found)
        else:
            self.known.update((chunk, ids) for chunk, ids in found.items() if len(chunk) <= LONGEST_KEPT)
        return found

    def slab(self, text: str) -> bytes:
        chunks = text.encode().lower().decode().replace("\n", " ").split(" ")  # of bytes: A-Z alone
        ids = list(map(self.known.get, chunks))
        if None in ids:
            found = self._learn(list({c: None for c, known in zip(chunks, ids, strict=True) if known is None}))
            ids = [found[c] if known is None else known for c, known in zip(chunks, ids, strict=True)]
        return b"".join(ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.slab(text[a:b]) for a, b in slabs(text)), np.uint32)


@functools.cache
def words_of_file(path: str) -> Words:
    """One per Python worker: its chunks stay known from task to task."""
    return Words(file_tokenizer(path))


# --- best fit -----------------------------------------------------------------------------------------------


class Rooms:
    """A segment tree over remaining capacities: which of them an open range of windows has, and the tightest one for a piece."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: first sequence, windows

    def _mark(self, room: int) -> None:
        node = self.leaves + room
        self.any[node] = bool(self.ranges[room])
        while node > 1:
            node //= 2
            here = self.any[2 * node] or self.any[2 * node + 1]
            if self.any[node] == here:
                break
            self.any[node] = here

    def put(self, room: int, first: int, windows: int) -> None:
        if windows:
            self.ranges[room].append((first, windows))
            self._mark(room)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` windows of one range with this room; the rest of the range stays."""
        first, windows = self.ranges[room].pop()
        if windows > most:
            self.ranges[room].append((first + most, windows - most))
            windows = most
        self._mark(room)
        return first, windows

    def tightest(self, length: int) -> int | None:
        """The least room that holds ``length``: up from its leaf until an open range lies to the right, then down to the left."""
        node = self.leaves + length
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.any[2 * node])
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[Run]], Rooms, int]:
    """Runs by length, the windows with room, and the number of sequences."""
    runs: dict[int, list[Run]] = defaultdict(list)
    rooms, sequences = Rooms(capacity), 0
    for length in sorted(histogram, reverse=True):
        placed, n = 0, histogram[length]
        while placed < n:
            left = n - placed
            room = rooms.tightest(length)
            if room is None:
                room = capacity
                windows = left // min(room // length, left)
                rooms.put(room, sequences, windows)
                sequences += windows
            # No open window is tighter, so the next pieces follow into the same one as long as they fit.
            each = min(room // length, left)
            first, windows = rooms.take(room, left // each)
            for k in range(each):
                runs[length].append((placed, windows, first, capacity - room + k * length))
                placed += windows
            rooms.put(room - each * length, first, windows)
    return runs, rooms, sequences


def padding(used: int, capacity: int = CAPACITY) -> int:
    """Tokens added to a sequence of ``used`` tokens."""
    return 0 if used & (used - 1) == 0 else capacity - used


# --- jobs ---------------------------------------------------------------------------------------------------


def pieces_of(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, part, nth``: pieces, numbered within their length in the task ``part`` that made them."""
    bounded_batches(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = words_of_file(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for one, value in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
                ids = np.append(encoder.encode(value), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    out.append((one, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            columns = zip(*out, strict=True) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=fields)

    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, ", ".join(f"{name} long" for name in fields))


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece."""
    # Numbers of some 30 bytes per piece; the texts are encoded once. The table fixes which task made a piece, also after a lost executor.
    pieces = written(pieces_of(docs, doc_id, text, tokenizer, capacity, end_id), "bestfit-pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    # At most one row per length, ``capacity`` in all.
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _, _ = best_fit_decreasing(histogram, capacity)
    # Runs follow from lengths alone: some 10 000 of 32 bytes at a capacity of 4096, whatever the size of the corpus.
    columns = {length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in runs.items()}
    shared = docs.sparkSession.sparkContext.broadcast(columns)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lengths, numbers = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            found, at = np.unique(lengths[order], return_index=True)
            for length, mine in zip(found.tolist(), np.split(order, at[1:]), strict=True):
                begins, _, first, offsets = table[length]
                which = np.searchsorted(begins, numbers[mine], side="right") - 1
                sequence[mine] = first[which] + numbers[mine] - begins[which]
                offset[mine] = offsets[which]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in fields[:5]), pa.array(sequence), pa.array(offset)], names=fields)

    numbered = pieces.join(starts, ["length", "part"]).select(*fields[:5], (F.col("from") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(run, ", ".join(f"{name} long" for name in fields))


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
