"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of long paragraphs.

Tree. Paragraphs are lines, their ends included, so the tree covers every character. A section begins at a heading line or after a
blank line, and after a paragraph whose own digest says so (one in sixteen), so that running text has sections too and an edit moves the borders of
the sections next to it alone. A paragraph is cut into pieces of at least ``PIECE`` code points, each ending with a word, counted from its start. A piece
has a digest of 32 bits; the digest of a paragraph and a section hash those below. The root has 128 bits and hashes 128-bit digests of the sections' full
texts, which are not printed: equal roots mean equal texts. Where roots differ, only sections and paragraphs with differing digests are compared further.

Fingerprint: ``root:section(paragraph.paragraph)section(…)``, a paragraph being the digests of its pieces, in hexadecimal. It holds the whole
tree, so likeness and places of edits come from fingerprints alone.

Likeness: the share of pieces that two trees have in common, ``2 x common / (pieces of both)``, repeats counted; 1 for equal roots (also of
two empty texts), 0 if only one is empty.

Order of documents. ``with_next`` deals documents out by ranges of doc_id, once, and reads each range in order; the first document of a
range is also sent to the range before it. No text is sorted in one task and none goes to the driver.

Defined results: a null text is empty and has the root of no pieces. Documents are ordered by doc_id from the largest, nulls last, rows with equal ids by
text; each row is a document. After the last comes the first; a single document is its own next. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, pick

PIECE, DIGEST, ROOT = 64, 4, 16
_HEADING = re.compile(r"[ ]{0,3}(#{1,6}([ \t]|$)|={3,}\s*$|-{3,}\s*$)")
_PIECE = re.compile(rf".{{{PIECE}}}[^\s]{{0,{PIECE}}}\s*|.+", re.S)


class Tree(list[list[list[str]]]):
    """Sections of paragraphs of piece digests, and the root over the sections' full texts."""

    root: str


def _digest(data: bytes, size: int = DIGEST) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def tree(text: str) -> Tree:
    sections = Tree()
    whole = hashlib.blake2b(digest_size=ROOT)
    own = None  # of the section's bytes
    fresh = True
    for line in _lines(text):
        blank = not line.strip()
        if fresh or (_HEADING.match(line) and not blank):
            sections.append([])
            if own:
                whole.update(own.digest())
            own = hashlib.blake2b(digest_size=ROOT)
        own.update(line.encode("utf-8", "surrogatepass"))
        pieces = [_digest(p.encode("utf-8", "surrogatepass")) for p in _PIECE.findall(line)]
        sections[-1].append(pieces)
        # The last hexadecimal digit of a paragraph's last piece decides.
        fresh = blank or pieces[-1][-1] == "0"
    if own:
        whole.update(own.digest())
    sections.root = whole.hexdigest()
    return sections


def _lines(text: str) -> list[str]:
    """Lines with their ends, cut at line feeds alone."""
    lines = text.split("\n")
    return [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def section_digest(section: list[list[str]]) -> str:
    return _digest(".".join("".join(p) for p in section).encode())


def written_out(sections: Tree) -> str:
    """The fingerprint of a tree."""
    parts = [(section_digest(s), ".".join("".join(p) for p in s)) for s in sections]
    return sections.root + ":" + "".join(f"{d}({p})" for d, p in parts)


_SECTION = re.compile(r"([0-9a-f]+)\(([0-9a-f.]*)\)")


def read_back(fingerprint: str) -> tuple[str, list[tuple[str, list[list[str]]]]]:
    """Root, and (digest, paragraphs of piece digests) of each section."""
    root, _, rest = fingerprint.partition(":")
    wide = 2 * DIGEST
    sections = []
    for digest, body in _SECTION.findall(rest):
        sections.append((digest, [[p[i : i + wide] for i in range(0, len(p), wide)] for p in body.split(".")]))
    return root, sections


def likeness(one: str, other: str) -> float:
    """Of two fingerprints, 0 to 1. Sections with equal digests are counted without being opened."""
    if one.partition(":")[0] == other.partition(":")[0]:
        return 1.0
    sides = []
    sections = [read_back(x)[1] for x in (one, other)]
    for found in sections:
        sides.append(Counter(piece for _, paragraphs in found for p in paragraphs for piece in p))
    total = sum(sides[0].values()) + sum(sides[1].values())
    return 2 * sum((sides[0] & sides[1]).values()) / total if total else 1.0


def edits(one: str, other: str) -> list[tuple[int, int, str]]:
    """Where ``one`` differs from ``other``: (section, paragraph, kind) with kind "changed" (some pieces are found again) or "new"."""
    a, b = read_back(one), read_back(other)
    if a[0] == b[0]:
        return []
    there = {digest for digest, _ in b[1]}
    paragraphs = {"".join(p) for _, ps in b[1] for p in ps}
    pieces = {x for _, ps in b[1] for p in ps for x in p}
    out = []
    for i, (digest, ps) in enumerate(a[1]):
        if digest in there:
            continue
        out += [(i, j, "changed" if pieces.intersection(p) else "new") for j, p in enumerate(ps) if "".join(p) not in paragraphs]
    return out


# --- jobs ---------------------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, root, fingerprint`` per row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written_out(tree(t.as_py() or "")) for t in batch["text"]]
            roots = [f.partition(":")[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(roots, pa.string()), pa.array(found, pa.string())], names=["doc_id", "root", "fingerprint"]
            )

    return pick(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, root string, fingerprint string")


def range_bounds(ids: DataFrame, parts: int) -> list[int]:
    """The largest doc_id of each of at most ``parts`` ranges, largest first: as many numbers as there are partitions."""
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)), F.lit(1.0))
    row = ids.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 100 * parts))).alias("at"), F.max("doc_id").alias("top")).first()
    return sorted({*(row["at"] or ()), *([] if row["top"] is None else [row["top"]])}, reverse=True)


def with_next(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` (doc_id, text) dealt out by range: ``part``, and ``ghost`` rows that stand after the last row of a part.

    Sorted within partitions: by part, then documents from the largest doc_id, then the ghost.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(rows.select("doc_id"), parts)
    n = max(1, len(bounds))
    rising = np.array(bounds[::-1], np.int64)

    @F.arrow_udf("array<int>")
    def parts_of(ids: pa.Array) -> pa.Array:
        # The part, and for the first document of a part the part before it.
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        exact = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(rising, exact)
        part = np.where(missing | (len(rising) == 0), n - 1, n - 1 - at)
        first = ~missing & np.isin(exact, rising)
        return pa.array([[p, (p - 1) % n] if f else [p] for p, f in zip(part.tolist(), first.tolist(), strict=True)], pa.list_(pa.int32()))

    placed = rows.select("doc_id", "text", F.posexplode(parts_of("doc_id")).alias("ghost", "part"))
    order = [F.asc("part"), F.asc("ghost"), F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")]
    return placed.repartitionByRange(parts, "part").sortWithinPartitions(*order)


ROWS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def half_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document against its edited text (the last half replaced by as much of the next document) and against the next document."""
    bounded_batches(docs.sparkSession)
    names = [part.split()[0] for part in ROWS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def against(one: tuple[int | None, str, str], after: tuple[str, str]) -> tuple:
        doc, body, own = one
        half = len(body) // 2
        edited = body[: len(body) - half] + after[0][:half]
        mark = written_out(tree(edited))
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(body), sha, own, mark, likeness(own, mark), likeness(own, after[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int, tuple] | None = None  # part and document that still lacks its next one
        first: tuple[str, str] | None = None  # of the only part, if it ends without a ghost
        for batch in batches:
            out = []
            for doc, value, ghost, part in zip(*(batch[c] for c in ("doc_id", "text", "ghost", "part")), strict=True):
                part, body = part.as_py(), value.as_py() or ""
                if waiting is not None and waiting[0] != part:
                    out.append(against(waiting[1], first))
                    waiting = None
                if ghost.as_py() and waiting is None:
                    continue  # a further ghost: a repeated row
                own = written_out(tree(body))
                if waiting is not None:
                    out.append(against(waiting[1], (body, own)))
                elif not ghost.as_py():
                    first = (body, own)
                waiting = None if ghost.as_py() else (part, (doc.as_py(), body, own))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
        if waiting is not None:
            columns = zip(against(waiting[1], first), strict=False)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return with_next(pick(docs, doc_id=doc_id, text=text), parts).mapInArrow(run, ROWS)


def query(docs: DataFrame) -> DataFrame:
    return half_edits(docs)
