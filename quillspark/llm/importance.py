"""Target-distribution importance resampling over hashed word runs.

Words. Texts are lower-cased in A-Z alone. A Regex Split of the tokenizers library, untrained, leaves out separators and returns words with their
offsets. A window over the offset pairs of consecutive words is one feature: runs of ``shortest`` to ``longest`` words, joined by one space. Its bucket is the
CRC-32 of its UTF-8 bytes modulo ``buckets``. Each text is split once; its buckets are written as numbers, and all later steps read these.

Gains. Buckets of all documents and of all target texts are counted into two histograms of fixed length, summed within each task first. A bucket's gain is the
logarithm of its smoothed share in the target over that in the documents, in thousandths, rounded down. A document's weight is the sum over its
features.

Draw. Gumbel noise from a hash of seed and id is added; of the documents with enough words, a fixed percentage with the highest scores is drawn, which is
sampling without replacement by weight. Ranks come from a sort by range: sorted ranges are numbered by themselves and start after those before.

Defined results: a null or empty text has no features, weight 0, and is never drawn. Every row is scored, also where doc_id repeats or is null (a null id is
hashed as the empty string and comes last among ties); rows of one id and score go by number of features, then in any order, as they are equal. Without
documents the result is empty; without target texts all gains come from smoothing alone. A text is split in slabs of some 100 000
characters that end at a separator, so memory doesn't grow with the longest text but with the longest word. Other columns may have any names, also
clashing ones.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, pick, utf8, written

BUCKETS, SHORTEST, LONGEST = 10_000, 1, 1
SEED, PERCENT, MIN_WORDS = 2024, 10, 20
#: Fixed value: all characters below U+0080 that are no digit or small letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SLAB = 100_000
_SEPARATOR = re.compile(SEPARATORS)


# --- features -----------------------------------------------------------------------------------------------


@functools.cache
def splitter():
    """One per Python worker."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(SEPARATORS + "+"), behavior="removed")


def slabs(text: str, size: int) -> Iterator[str]:
    """Parts of ``size`` characters or more that end at a separator."""
    start = 0
    while start < len(text):
        cut = _SEPARATOR.search(text, start + size) if len(text) - start > size else None
        end = cut.end() if cut else len(text)
        yield text[start:end] if (start, end) != (0, len(text)) else text
        start = end


def buckets_of(data: bytes, buckets: int, shortest: int, longest: int, slab: int = SLAB) -> tuple[int, np.ndarray]:
    """Number of words of a UTF-8 text, and the bucket of each feature."""
    crc32 = zlib.crc32
    n_words, parts, before = 0, [], ""
    for part in slabs(data.lower().decode(), slab):  # of bytes: A-Z alone
        # The last words of the slab before come first, so that windows may go across.
        text = before + part
        pairs = [pair for _, pair in splitter().pre_tokenize_str(text)]
        old = min(longest - 1, n_words)
        n_words += len(pairs) - old
        for n in range(shortest, longest + 1):
            skip = max(old - n + 1, 0)  # windows of old words alone were counted before
            if n == 1:
                runs = [text[a:b] for a, b in pairs[skip:]]
            else:
                runs = [" ".join([text[a:b] for a, b in pairs[i : i + n]]) for i in range(skip, len(pairs) - n + 1)]
            parts.append(np.fromiter((crc32(run.encode()) % buckets for run in runs), np.int32, len(runs)))
        before = "".join(text[a:b] + " " for a, b in pairs[max(len(pairs) - longest + 1, 0) :]) if longest > 1 else ""
    return n_words, np.concatenate(parts) if parts else np.zeros(0, np.int32)


def features(
    docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text", buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST
) -> DataFrame:
    """``doc_id, n_words, buckets`` of each row. Without ``doc_id`` the ids are null."""
    if not 1 <= shortest <= longest or not 1 <= buckets < 1 << 31:
        raise ValueError("runs have one word or more, and buckets are positive ints")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [buckets_of(value, buckets, shortest, longest) for value in utf8(batch["text"])]
            lists = pa.ListArray.from_arrays(
                np.cumsum([0, *(len(own) for _, own in counted)]).astype(np.int32),
                np.concatenate([own for _, own in counted]) if counted else np.zeros(0, np.int32),
            )
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([n for n, _ in counted], pa.int64()), lists], names=["doc_id", "n_words", "buckets"])

    rows = pick(docs, text=text, **({"doc_id": doc_id} if doc_id else {}))
    rows = rows.select((F.col("doc_id") if doc_id else F.lit(None)).cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, buckets array<int>")


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of the features of all rows; a task sends at most one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch["buckets"].flatten().to_numpy(), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return counted.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, from the two histograms: two rows per bucket at most come to the driver."""
    both = source.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for row in both.collect():
        counts[row["side"], row["bucket"]] = row["n"]
    (s, t), (s_all, t_all) = counts.tolist(), counts.sum(axis=1).tolist()
    return np.array(
        [math.floor(1000 * math.log((a + 1) * (s_all + buckets) / ((b + 1) * (t_all + buckets)))) for a, b in zip(t, s, strict=True)], np.int64
    )


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: gains summed per row."""
    shared = counted.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["buckets"]
            ends = np.concatenate([[0], np.cumsum(shared.value[lists.flatten().to_numpy()])])
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            weight = ends[at[1:]] - ends[at[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_words"], pa.array(sizes), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


# --- draw ---------------------------------------------------------------------------------------------------


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from 32 bits of SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame) -> DataFrame:
    """``scored`` with ``place`` 1, 2, 3… by score downwards, then id, over all rows: no single task holds them."""
    # The last key lets equal rows, of one repeated id, lie in several ranges.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("copy").asc()]
    ranges = scored.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # Sorted ranges are written; part and row are read off the running number that Spark gives within them.
    lined = written(ranges.withColumn("row", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("row", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = lined.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return lined.withColumn("part", part).join(starts, "part").withColumn("place", F.col("from") + within + 1).drop("part", "row", "from", "copy")


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    shortest: int = SHORTEST,
    longest: int = LONGEST,
    seed: int = SEED,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs``; ``rank`` is null where it isn't drawn."""
    counted = written(features(docs, doc_id, text, buckets, shortest, longest), "features")
    goal = histogram(features(target, None, target_text, buckets, shortest, longest), buckets)
    gain = gains(histogram(counted, buckets), goal, buckets)
    scored = weighed(counted, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    apt = F.col("n_words") >= min_words
    drawn = counted.where(apt).count() * percent // 100
    # Those with too few words need no place; they stay out of the sort.
    placed = ranked(scored.where(apt)).select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    short = scored.where(~apt).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.unionByName(short)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)


ORACLE = r"""
WITH table256 AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
), lowered AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT 1, 0, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
  SELECT side, row, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM lowered
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(word))) // 2 + 1),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), table256
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT count(*) FILTER (side = 0) AS s_all, count(*) FILTER (side = 1) AS t_all FROM words
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM counts, totals
), weights AS (
  SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM lowered d LEFT JOIN weights USING (row) WHERE side = 0
), placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
"""
