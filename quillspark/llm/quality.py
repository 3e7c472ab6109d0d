"""Quality rules: base counts of a text, and cross-document line frequency per host.

Base. Words are runs without ``[\\x20\\x09-\\x0D]``. A document fails with fewer than ``MIN_WORDS`` words, or if more than 30 % of its
words lie in 8-word windows found twice or more in it.

Line frequency. Lines are normalised (stripped, A-Z lower-cased, white space made single spaces) and hashed to 128 bits. For each host
(``source``) and line the distinct documents are counted; exact copies of a text are one document. A line is above the limit if more than
``max(MIN_DOCS, SHARE x the host's distinct documents)`` of them hold it, or, as hosts may be small, more than ``max(FEW_DOCS, FEW_SHARE x those)``:
menus and footers of a host, not passages that a group of copies shares. Lines above the limit are removed, but for the smallest doc_id of the
host that holds it and passes the base rules, so that no content leaves the corpus as a whole. A document is depleted, and rejected, if lines were
removed and fewer than ``MIN_WORDS`` words or less than 30 % of its words are left.

Every count is taken over all documents; counts are combined before they are shuffled, and only hashes are shuffled, never texts.

Defined results: a null text has no words and fails. A null source is a host of its own. Every row is a document and gets its own verdict, also
where doc_id repeats; of rows with the smallest doc_id all keep the line. A null doc_id is larger than any other. An empty table gives an empty
result. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, bounded_batches, pick, utf8, written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_DOCS, SHARE, MIN_LEFT_PERCENT = 100, 0.01, 30
#: Limits of hosts of any size: a line needs no more documents than these ask for, however large ``MIN_DOCS`` is.
FEW_DOCS, FEW_SHARE = 10, 0.05
_SYMBOLS = [c.encode() for c in "#*$%&|<>"]
_SPACES = [c.encode() for c in SPACE]
_NO_WORD = np.uint64(0)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in windows of ``size`` words found twice or more, the first find included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    # A rolling hash finds the windows that may repeat; they are then compared word by word.
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = mixed * _MIX + codes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order][1:] == mixed[order][:-1]
    if not equal.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][equal]] = True
    maybe[order[:-1][equal]] = True
    at = np.flatnonzero(maybe)
    windows = [tuple(words[i : i + size]) for i in at]
    count = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(at, windows, strict=True):
        if count[window] > 1:
            edge[i] += 1
            edge[i + size] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def code_points(data: bytes) -> int:
    """Length in code points of UTF-8 bytes: all but continuation bytes."""
    if data.isascii():
        return len(data)
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()  # splits bytes at just the six characters
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        code_points(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def line_words(text: bytes) -> dict[bytes, int]:
    """Words of each normalised line's key, over all its places in the text."""
    found: Counter[bytes] = Counter()
    for line in text.split(b"\n"):
        if words := line.split():
            key = hashlib.md5(b" ".join(words).lower(), usedforsecurity=False).digest()
            found[key] += len(words)
    return found


FACTS = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, text_key binary, lines array<struct<key: binary, words: long>>"
)


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Base counts and line keys of each row, in one pass over the texts."""
    bounded_batches(docs.sparkSession)
    line = pa.struct([("key", pa.binary()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, lines = [], [], []
            for body in utf8(batch["text"]):
                counts.append(base_counts(body))
                keys.append(hashlib.md5(body, usedforsecurity=False).digest())
                lines.append([{"key": k, "words": n} for k, n in line_words(body).items()])
            numbers = np.array(counts, np.int64).reshape(-1, 5)
            failed = (numbers[:, 0] < MIN_WORDS) | (100 * numbers[:, 4] > MAX_REPEAT_PERCENT * numbers[:, 0])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["host"],
                    *(pa.array(numbers[:, k].copy()) for k in range(5)),
                    pa.array(failed),
                    pa.array(keys, pa.binary()),
                    pa.array(lines, pa.list_(line)),
                ],
                names=[part.split()[0] for part in FACTS.split(", ")[:9]] + ["lines"],
            )

    return pick(docs, doc_id=doc_id, text=text, host=host).mapInArrow(run, FACTS)


def boilerplate(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, scaled: bool = False) -> DataFrame:
    """``host, key, n_docs, keeper``: lines above their host's limit, and the doc_id that keeps them.

    ``scaled``: more than ``max(FEW_DOCS, FEW_SHARE x the host's distinct documents)`` are enough where that is less.
    """
    fixed = F.greatest(F.lit(float(min_docs)), F.col("host_docs") * share)
    limit = F.least(fixed, F.greatest(F.lit(float(FEW_DOCS)), F.col("host_docs") * FEW_SHARE)) if scaled else fixed
    hosts = (
        rows.groupBy("host", "text_key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("host_docs"))
    )
    keeper = F.min(F.when(~F.col("base_failed"), F.col("doc_id")))
    held = (
        rows.select("host", "text_key", "doc_id", "base_failed", F.explode("lines.key").alias("key"))
        .groupBy("host", "key", "text_key")
        .agg(keeper.alias("keeper"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("keeper").alias("keeper"))
        .where(F.col("n_docs") > (min(min_docs, FEW_DOCS) if scaled else min_docs))
    )
    limits = hosts.withColumnRenamed("host", "of_host")
    return held.join(limits, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("n_docs") > limit).select(
        "host", "key", "n_docs", "keeper"
    )


def _removals(
    docs: DataFrame, doc_id: str, text: str, host: str, min_docs: int, share: float, scaled: bool
) -> tuple[DataFrame, DataFrame]:
    """Facts of each row, and ``row, host, doc_id, key, words, keeper`` of each line of a row that is above its host's limit."""
    # Read three times below, so written once. The row number is fixed by the written table.
    rows = written(
        facts(docs, doc_id, text, host).withColumn("row", F.monotonically_increasing_id()), "quality-facts"
    )
    common = boilerplate(rows, min_docs, share, scaled).select(F.col("host").alias("b_host"), F.col("key").alias("b_key"), "keeper")
    held = (
        rows.select("row", "host", "doc_id", F.explode("lines").alias("line"))
        .join(common, F.col("host").eqNullSafe(F.col("b_host")) & (F.col("line.key") == F.col("b_key")))
        .select("row", "host", "doc_id", "line.key", "line.words", "keeper")
    )
    return rows, held


def _judged(rows: DataFrame, held: DataFrame) -> DataFrame:
    removed = held.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.sum("words").alias("n_removed"))
    left = F.col("n_words") - F.col("n_removed")
    depleted = (F.col("n_removed") > 0) & ((left < MIN_WORDS) | (100 * left < MIN_LEFT_PERCENT * F.col("n_words")))
    return (
        rows.drop("lines", "text_key")
        .join(removed, "row", "left")
        .withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .drop("row", "host")
    )


def verdicts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    share: float = SHARE,
    scaled: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: base counts, ``base_failed``, ``n_removed`` words in removed lines, ``kept``."""
    return _judged(*_removals(docs, doc_id, text, host, min_docs, share, scaled))


def without_lines(text: bytes, gone: set[bytes]) -> bytes:
    """A text without the lines whose keys are in ``gone``."""
    keep = []
    for line in text.split(b"\n"):
        words = line.split()
        if not words or hashlib.md5(b" ".join(words).lower(), usedforsecurity=False).digest() not in gone:
            keep.append(line)
    return b"\n".join(keep)


def accepted(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, scaled: bool = False) -> DataFrame:
    """The rows of ``docs`` (columns of ``documents``) that pass, their texts without the lines above the limits.

    Rows of one doc_id stay if one of them passes. A line whose keeper is rejected stays in the smallest doc_id that holds it and passes.
    """
    names = docs.columns
    rows, held = _removals(docs, "doc_id", "text", "source", min_docs, share, scaled)
    held = written(held, "quality-held")
    judged = _judged(rows, held).groupBy(F.col("doc_id").alias("of_doc")).agg(F.max("kept").alias("kept"))
    rejected = written(judged.where(~F.col("kept")).select("of_doc"), "quality-rejected")

    def passing(df: DataFrame) -> DataFrame:
        return df.join(rejected, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left_anti")

    staying = passing(held)
    keepers = written(
        staying.groupBy("host", "key").agg(
            F.coalesce(F.min(F.when(F.col("doc_id") == F.col("keeper"), F.col("doc_id"))), F.min("doc_id")).alias("now")
        ),
        "quality-keepers",
    ).select(F.col("host").alias("k_host"), F.col("key").alias("k_key"), "now")
    lost = (
        staying.join(keepers, F.col("host").eqNullSafe(F.col("k_host")) & (F.col("key") == F.col("k_key")))
        .where(~F.col("doc_id").eqNullSafe(F.col("now")))
        .groupBy(F.col("doc_id").alias("lost_doc"))
        .agg(F.collect_set(F.struct("host", "key")).alias("quality_lost"))
    )
    # The texts go by doc_id alone in both joins.
    joined = passing(docs).join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("lost_doc")), "left").select(*names, "quality_lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data = batch["text"].cast(pa.binary())
            for body, host, lost in zip(data, batch["source"], batch["quality_lost"], strict=True):
                gone = {x["key"] for x in lost.as_py() if x["host"] == host.as_py()} if lost.is_valid else ()
                out.append(without_lines(body.as_py(), gone) if gone and body.is_valid else body.as_py())
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if n == "text" else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return verdicts(docs, scaled=True)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), grams AS (
  SELECT doc_id, pos, words[pos:pos + 7] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT at_word) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS at_word FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS line_words
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM w)
), real AS (
  SELECT *, translate(array_to_string(line_words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines WHERE len(line_words) > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real GROUP BY doc_id
), base AS (
  SELECT w.doc_id, source, text, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(DISTINCT text) AS host_docs FROM w GROUP BY source
), common AS (
  SELECT r.source, r.key, min(r.doc_id) FILTER (WHERE NOT f.base_failed) AS keeper
  FROM real r JOIN failed f USING (doc_id) JOIN hosts h ON h.source IS NOT DISTINCT FROM r.source
  GROUP BY r.source, r.key, h.host_docs
  HAVING count(DISTINCT r.text) > least(greatest(100, h.host_docs * 0.01), greatest(10, h.host_docs * 0.05))
), removed AS (
  SELECT r.doc_id, sum(len(r.line_words)) AS n_removed
  FROM real r JOIN common c ON c.source IS NOT DISTINCT FROM r.source AND c.key = r.key
  WHERE r.doc_id IS DISTINCT FROM c.keeper
  GROUP BY r.doc_id
), judged AS (
  SELECT f.*, coalesce(n_removed, 0)::BIGINT AS n_removed FROM failed f LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed,
       NOT base_failed AND NOT (n_removed > 0 AND (n_words - n_removed < 20 OR 100 * (n_words - n_removed) < 30 * n_words)) AS kept
FROM judged
"""
