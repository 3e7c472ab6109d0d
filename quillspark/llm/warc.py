"""WARC archives: written by Spark's text sink, read back record by record, segments put together again.

Writing. Each page becomes a ``response`` record, or a ``revisit`` record where a page with a larger id has the same
payload of at least ``min_revisit`` bytes. The HTTP body has chunked transfer framing. Blocks longer than ``segment_bytes``
are cut: the first segment is the response record, the others are ``continuation`` records that name it by
``WARC-Segment-Origin-ID``; the last one has ``WARC-Segment-Total-Length``. A segment may lie in any file.

Every record has the time at which its archives were begun as WARC-Date.

Reading. The archives are read as text with the version line as the separator: one row per record. A gzip file is read
by one task, so files are bounded: ``max_records`` records of at most ``segment_bytes`` and their headers. The writer never lets the version line appear inside a block: a chunk or a segment ends
within it. Continuation records are grouped by their origin (one group holds one page), ordered by segment number, their
total length is verified, and the chunked framing is decoded. A record whose length or digest doesn't hold has
``problem`` set and keeps its row.

Defined results: a null html is an empty payload. Every row is a record of its own, also where page ids repeat; a
repeated page id within a group of equal payloads is a response in each of its rows with the largest id. A null page_id is
smaller than any other and is written as an absent header. An empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, pick
from quillspark.session import work_dir

VERSION = b"WARC/1.1\r\n"
MIN_REVISIT, SEGMENT_BYTES, CHUNK_BYTES, MAX_RECORDS = 1000, 16384, 4096, 8192
_END = b"\r\n\r\n"


# --- one record ---------------------------------------------------------------------------------------------


def _cuts(data: bytes, size: int) -> list[int]:
    """Ends of pieces of ``size`` bytes, with further ends inside each version line in ``data``."""
    ends = set(range(size, len(data), size))
    found = data.find(VERSION)
    while found >= 0:
        ends.add(found + 4)
        found = data.find(VERSION, found + 1)
    return [*sorted(ends), len(data)]


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing (RFC 9112, section 7.1)."""
    out, start = [], 0
    for end in _cuts(payload, size) if payload else []:
        out.append(b"%x\r\n%s\r\n" % (end - start, payload[start:end]))
        start = end
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line_end = body.index(b"\r\n", at)
        size = int(body[at:line_end].split(b";")[0], 16)
        at = line_end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its end mark, which the sink writes as its line separator."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return VERSION + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int, date: str
) -> list[bytes]:
    """The records of one page; ``date`` as in ``2026-01-31T12:00:00Z``."""
    digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    own = f"<urn:uuid:{uuid.uuid4()}>"
    url = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", url.replace("WARC/1.1", "WARC%2F1.1") if url is not None else None),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Page-ID", refers_to),
            ("WARC-Refers-To-Date", date),
        ]
        return [_record(head, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record(head, block)]
    out, start = [], 0
    ends = range(segment_bytes, len(block) + segment_bytes, segment_bytes)
    for number, end in enumerate(ends, 1):
        piece = block[start:end]
        if number == 1:
            out.append(_record([*head, ("WARC-Segment-Number", 1)], piece))
        else:
            last = len(block) if end >= len(block) else None
            names = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", own),
                ("WARC-Segment-Number", number),
                ("WARC-Segment-Total-Length", last),
            ]
            out.append(_record(names, piece))
        start = end
    return out


def parse(record: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers and block of what stands between two version lines; block None where it is cut short."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    length = int(headers.get("content-length", "-1"))
    # What follows the block is its end mark alone.
    if length < 0 or rest[length:] != _END:
        return headers, None
    return headers, rest[:length]


# --- jobs ---------------------------------------------------------------------------------------------------


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit: int = MIN_REVISIT,
    segment_bytes: int = SEGMENT_BYTES,
    max_records: int = MAX_RECORDS,
) -> None:
    """Write ``pages`` as gzip-compressed WARC files below ``path``."""
    bounded_batches(pages.sparkSession, 500)
    # One value for all tasks, also for those that run again.
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pick(pages, page_id=page_id, url=url, html=html)
    body = F.coalesce(F.col("html"), F.lit(""))
    slim = rows.select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size"))
    # Counts per payload are combined before the shuffle, so a payload of a third of all pages is one row per task.
    owners = (
        slim.where(F.col("size") >= min_revisit)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    revisits = (
        slim.join(owners, ["digest", "size"])
        .where("NOT page_id <=> owner")
        .groupBy(F.col("page_id").alias("of_page"))
        .agg(F.collect_set(F.struct("digest", "owner")).alias("owners"))
    )
    marked = rows.join(revisits.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("of_page")), "left").select(
        "page_id", "url", body.cast("binary").alias("payload"), "owners"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for one, address, payload, owners in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                payload = payload or b""
                refers = None
                if owners:  # a repeated id may stand for several payloads
                    digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                    refers = next((o["owner"] for o in owners if o["digest"] == digest), None)
                out += records(one, address, payload, refers, segment_bytes, date)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # The cast keeps the bytes as they are.
    made = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    (
        made.write.option("lineSep", _END.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max_records)
        .text(path)
    )


RECORD = (
    "page_id long, record_type string, record_id string, origin_id string, segment int, total_length long, "
    "refers_to long, digest string, block binary, problem string"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, payloads not decoded yet."""
    bounded_batches(spark, 500)
    raw = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("record"))

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
        types = [kinds[part.split()[1]] for part in RECORD.split(", ")]
        for batch in batches:
            out = []
            for record in batch["record"].to_pylist():
                if not record:
                    continue
                h, block = parse(record)
                digest = h.get("warc-payload-digest")
                out.append(
                    (
                        number(h.get("warc-page-id")),
                        h.get("warc-type"),
                        h.get("warc-record-id"),
                        h.get("warc-segment-origin-id", h.get("warc-record-id")),
                        number(h.get("warc-segment-number")),
                        number(h.get("warc-segment-total-length")),
                        number(h.get("warc-refers-to-page-id")),
                        None if digest is None else digest.removeprefix("sha1:"),
                        block,
                        "length" if block is None else None,
                    )
                )
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return raw.mapInArrow(run, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """Responses and revisits with whole blocks: continuation records are put behind their origin.

    Only segmented records are shuffled. ``problem`` is "segments" where one is missing or doubled and
    "total length" where the last segment states another length.
    """
    plain = found.where("segment IS NULL").drop("segment", "total_length", "origin_id")
    piece = F.struct("segment", "total_length", "block", "problem")
    whole = (
        found.where("segment IS NOT NULL")
        .groupBy("origin_id")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
            F.max("digest").alias("digest"),
            # A group is one page.
            F.array_sort(F.collect_list(piece)).alias("pieces"),
        )
        .select(
            "page_id",
            "record_type",
            F.col("origin_id").alias("record_id"),
            F.lit(None).cast("long").alias("refers_to"),
            "digest",
            # Joined at once, as strings: the casts keep the bytes as they are.
            F.expr("cast(array_join(transform(pieces, p -> cast(p.block AS string)), '') AS binary)").alias("block"),
            F.expr(
                "CASE WHEN exists(pieces, p -> p.problem IS NOT NULL) THEN 'length' "
                "WHEN transform(pieces, p -> p.segment) <> sequence(1, size(pieces)) THEN 'segments' "
                "WHEN NOT coalesce(element_at(pieces, -1).total_length = aggregate(pieces, 0L, (a, p) -> a + octet_length(p.block)), false) "
                "THEN 'total length' END"
            ).alias("problem"),
        )
    )
    return plain.unionByName(whole)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, record_id, refers_to, payload, payload_bytes, payload_digest, problem`` per page.

    The digest of a response is computed from its decoded payload. A revisit has no payload; its length is that of its stored HTTP
    headers and its digest that of its record.
    """
    whole = reassemble(read_records(spark, path))
    names = "page_id record_type record_id refers_to payload payload_bytes payload_digest problem".split()
    schema = (
        "page_id long, record_type string, record_id string, refers_to long, payload binary, payload_bytes long, "
        "payload_digest string, problem string"
    )

    def decode(block: bytes | None, kind: str, digest: str | None, problem: str | None) -> tuple:
        if problem or block is None:
            return None, None, digest, problem or "length"
        head, _, body = block.partition(b"\r\n\r\n")
        fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
        if kind == "revisit":
            return None, int(fields.get(b"content-length", b"0")), digest, None
        try:
            payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
        except ValueError:
            return None, None, digest, "framing"
        real = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
        return payload, len(payload), real, None if digest in (None, real) else "digest"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [
                decode(b, k, d, p)
                for b, k, d, p in zip(*(batch[c].to_pylist() for c in ("block", "record_type", "digest", "problem")), strict=True)
            ]
            payload, size, digest, problem = zip(*got, strict=True) if got else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in names[:4]),
                    pa.array(payload, pa.binary()),
                    pa.array(size, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(problem, pa.string()),
                ],
                names=names,
            )

    return whole.mapInArrow(run, schema)


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
  FROM pages
), m AS (
  SELECT *, CASE WHEN size >= 1000 AND owner <> page_id THEN owner END AS refers_to FROM p
)
SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM m
"""
