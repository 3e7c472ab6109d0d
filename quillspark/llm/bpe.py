"""Byte-level BPE over Arrow batches: encoding with offsets, and decoding.

The tokenizers library does the merges. Every byte stands for one printable character in its vocabulary (the byte table), so any text can be encoded
and decoding gives the same bytes back.

A text is cut before white space that follows other characters; no match of the splitting pattern goes across such a place, so the pieces can
be encoded apart. Pieces repeat, so each Python worker keeps the ids of pieces it has met, up to a fixed number, and asks the library for the
others. Texts are worked on in slabs of about a million characters: memory doesn't grow with the longest text.

Defined results: a null text is empty and has no ids. Every row has its own result, also where doc_id repeats or is null. The strings of special
tokens in a text are ordinary text. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import bounded_batches, pick, texts

KEPT_PIECES, LONGEST_KEPT, SLAB = 600_000, 48, 1 << 20
_PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def byte_table() -> tuple[str, ...]:
    """The character of each byte: printable ones stand for themselves, the others for those from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return tuple(chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the library from a rank file: two neighbours merge if their join has a rank, lowest rank first."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_table()
    shown = {token: "".join(map(table.__getitem__, token)) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        # Every way in which two tokens join to this one.
        pairs = ((token[:cut], token[cut:]) for cut in range(1, len(token)))
        merges += [(shown[a], shown[b]) for a, b in sorted((p for p in pairs if p[0] in ranks and p[1] in ranks), key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    tokenizer = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


@functools.cache
def ranks_tokenizer(path: str, pattern: str):
    """One per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return tokenizer_of_ranks(read_ranks(path), pattern)


@functools.cache
def file_tokenizer(path: str):
    """One per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.cache
def token_bytes(path: str, pattern: str) -> list[bytes]:
    """The bytes of each id: the byte table reversed."""
    back = {c: b for b, c in enumerate(byte_table())}
    vocabulary = ranks_tokenizer(path, pattern).get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for shown, i in vocabulary.items():
        out[i] = bytes(map(back.__getitem__, shown))
    return out


def pieces_of(text: str) -> list[str]:
    """Cut before each run of spaces and line feeds that follows another character."""
    if "\0" in text or any(run in text for run in ("  ", " \n", "\n ", "\n\n")):
        return _PIECES.findall(text)
    # Runs of one alone: the same, at the speed of replace and split.
    pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return pieces if pieces[0] else pieces[1:]


class Pieces:
    """Ids of texts as little-endian unsigned 32-bit numbers, put together from the ids of pieces.

    Pieces met lately are known: up to ``kept`` in each of two generations, the older of which is given up when the younger is full.
    """

    def __init__(self, tokenizer, kept: int = KEPT_PIECES):
        self.tokenizer, self.kept = tokenizer, kept
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for shown, i in vocabulary.items():
            self.sizes[i] = len(shown)  # one character stands for one byte

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _encode_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, asked for as one text: no match goes across their borders, so the sizes of tokens tell them apart."""
        ids = self._encode("".join(pieces))
        ends = np.cumsum(self.sizes[np.frombuffer(ids, np.uint32)])
        wanted = np.cumsum([len(p.encode()) for p in pieces])
        at = np.searchsorted(ends, wanted)
        if not (len(ends) and np.array_equal(ends[np.minimum(at, len(ends) - 1)], wanted)):
            return [self._encode(p) for p in pieces]
        cuts = [0, *(4 * (at + 1)).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, missing: list[str]) -> dict[str, bytes] | None:
        """Ids of pieces that are not known. None if one of them must not be encoded apart."""
        found, ask, last = {}, [], []
        for p in missing:
            ids = self.older.get(p)
            if ids is not None:
                found[p] = ids
            elif not p[-1].isspace():
                ask.append(p)
            elif p.strip(" \n"):
                return None  # other white space at the end may belong to a longer match
            else:
                last.append(p)
        # A text's first piece may start with a letter: such pieces, and white space at the end, are asked for by themselves.
        inner = [p for p in ask if p[0] in " \n"]
        alone = [p for p in ask if p[0] not in " \n"] + last
        if inner:
            found.update(zip(inner, self._encode_all(inner), strict=True))
        found.update((p, self._encode(p)) for p in alone)
        if len(self.known) + len(found) > self.kept:
            self.older, self.known = self.known, {}
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST_KEPT)
        return found

    def slab(self, text: str) -> bytes:
        pieces = pieces_of(text)
        ids = list(map(self.known.get, pieces))
        if None in ids:
            found = self._learn(list({p: None for p, known in zip(pieces, ids, strict=True) if known is None}))
            if found is None:
                return self._encode(text)
            ids = [found[p] if known is None else known for p, known in zip(pieces, ids, strict=True)]
        return b"".join(ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.slab(text[a:b]) for a, b in slabs(text)), np.uint32)


@functools.cache
def ranks_pieces(path: str, pattern: str) -> Pieces:
    """One per Python worker: its pieces stay known from task to task."""
    return Pieces(ranks_tokenizer(path, pattern))


@functools.cache
def file_pieces(path: str) -> Pieces:
    """One per Python worker: its pieces stay known from task to task."""
    return Pieces(file_tokenizer(path))


def slabs(text: str, size: int = SLAB) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(text):
        cut = _SAFE_CUT.search(text, start + size) if len(text) - start > size else None
        end = cut.start() if cut else len(text)
        yield start, end
        start = end


def spans(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens from their sizes in bytes. Tokens that share a character both hold it."""
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(first) - 1  # of each byte
    ends = np.cumsum(sizes)
    return character[ends - sizes], character[ends - 1] + 1


def _paths(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids, starts, ends``: token ids of each text and the characters they cover."""
    bounded_batches(docs.sparkSession)
    path, pattern = _paths(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ranks_pieces(path, pattern)
        sizes = np.array([len(b) for b in token_bytes(path, pattern)], np.int64)
        for batch in batches:
            ids, starts, ends = [], [], []
            for value in texts(batch["text"]):
                own = pieces.encode(value)
                a, b = spans(value.encode(), sizes[own]) if len(own) else (own, own)
                ids.append(own.astype(np.int32))
                starts.append(a.astype(np.int32))
                ends.append(b.astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *lists], names=["doc_id", "ids", "starts", "ends"])

    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, decoded, text`` from ``doc_id, ids``: the bytes, and the text with U+FFFD for what is not UTF-8.

    Bytes of all ids are joined before they are read as text, so a character may be split between tokens. Null ids give an empty text; ids out of
    range raise an error.
    """
    path, pattern = _paths(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path, pattern)
        for batch in batches:
            data = [b"".join(map(table.__getitem__, ids or ())) for ids in batch["ids"].to_pylist()]
            read = pa.array([d.decode("utf-8", "replace") for d in data], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(data, pa.binary()), read], names=["doc_id", "decoded", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary, text string")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of the ids of each text and of the bytes decoded from them, without passing lists of ids between stages."""
    bounded_batches(docs.sparkSession)
    path, pattern = _paths(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ranks_pieces(path, pattern)
        table = token_bytes(path, pattern)
        number = [str(i) for i in range(len(table))]
        for batch in batches:
            counts, ids_digest, decoded_digest = [], [], []
            for value in texts(batch["text"]):
                count, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for start, end in slabs(value):
                    ids = np.frombuffer(pieces.slab(value[start:end]), np.uint32).tolist()
                    listed.update(((" " if count else "") + " ".join(map(number.__getitem__, ids))).encode())
                    decoded.update(b"".join(map(table.__getitem__, ids)))
                    count += len(ids)
                counts.append(count)
                ids_digest.append(listed.hexdigest())
                decoded_digest.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(decoded_digest)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
