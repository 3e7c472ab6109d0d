"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet folder with one row per line key, ``(key, n_docs, last_doc)``, dealt out by key and
sorted by it. A batch of documents adds one run to level 0; when a level holds ``fan_in`` runs they are
merged into one run of the next level. A key is then found in at most ``fan_in`` runs per level, and each
key is rewritten once per level, whatever the number of batches.

Lines are split at ``\\n``; a key is the MD5 of the line with white space ``[\\x20\\x09-\\x0D]`` stripped at both
ends and A-Z lower-cased. Lines shorter than ``min_chars`` code points have no key and always stay.

Defined results: a null or empty text is one empty line. Every row is a document; rows that repeat a doc_id count
each, and all rows with the largest doc_id keep the line. A null doc_id is smaller than any other. An empty table
gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, bounded_batches, pick, utf8, written
from quillspark.session import work_dir

MIN_CHARS, MIN_DOCS, FAN_IN, BATCHES = 40, 5, 4, 4
_STRIP = SPACE.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of one UTF-8 line, None where it is too short to have one."""
    line = line.strip(_STRIP)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    # bytes.lower changes A-Z alone.
    return hashlib.md5(line.lower(), usedforsecurity=False).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(key, doc_id)`` once for each row of ``docs (doc_id, text)`` and key in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            ids: list[int | None] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                found = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                keys += found
                ids += [doc_id] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "key binary, doc_id long")


class LineRuns:
    """The runs below one folder of the shared store.

    ``state`` names them, ``[[path, ...] per level]``: keep it to go on with the same runs in another session.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fan_in: int = FAN_IN, state: list | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.root = root or work_dir(spark, "line-runs")
        self.state: list[list[str]] = state or []
        self._made = sum(map(len, self.state))

    def _write(self, rows: DataFrame, level: int) -> None:
        self._made += 1
        path = f"{self.root}/level{level}-run{self._made}"
        # groupBy left the rows dealt out by key; within a part file they are sorted by it.
        rows.sortWithinPartitions("key").write.mode("overwrite").parquet(path)
        while len(self.state) <= level:
            self.state.append([])
        self.state[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("key binary, n_docs long, last_doc long").parquet(*paths)

    def merged(self) -> DataFrame:
        """One row per key over all runs."""
        paths = [p for level in self.state for p in level]
        if not paths:
            return self.spark.createDataFrame([], "key binary, n_docs long, last_doc long")
        return _merge(self._read(paths))

    def add(self, keys: DataFrame) -> None:
        """One batch of ``(key, doc_id)`` becomes a run of level 0; full levels are compacted."""
        self._write(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")), 0)
        level = 0
        while len(self.state[level]) >= self.fan_in:
            merged = _merge(self._read(self.state[level]))
            self._write(merged, level + 1)
            self.state[level] = []
            level += 1

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of a new batch whose key no run has: the merge anti-join."""
        return keys.join(self.merged().hint("merge"), "key", "left_anti")

    def dropped(self, keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """``(doc_id, drop)``: the keys a document loses, as frequent and also held by a larger doc_id."""
        # Written first: the join then has exchanges of its own, and a key with very many lines can be split.
        frequent = written(self.merged().where(F.col("n_docs") >= min_docs).select("key", "last_doc"), "line-frequent")
        lost = keys.join(frequent, "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        # A list holds lines of one document alone.
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def _merge(runs: DataFrame) -> DataFrame:
    return runs.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def drop_lines(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text and others) with the lines of ``drops`` taken out, n_lines and n_dropped added."""
    names = docs.columns
    joined = docs.join(
        drops.withColumnRenamed("doc_id", "of_doc").hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("of_doc")),
        "left",
    ).select(*names, F.col("drop").alias("line_drop"))
    schema = joined.drop("line_drop").schema.add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_lines, n_dropped = [], [], []
            for text, drop in zip(utf8(batch["text"]), batch["line_drop"].to_pylist(), strict=True):
                lines = text.split(b"\n")
                keep = lines
                if drop:
                    gone = set(drop)
                    keep = [x for x in lines if line_key(x, min_chars) not in gone]
                out.append(b"\n".join(keep))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if n == "text" else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*names, "n_lines", "n_dropped"],
            )

    return joined.mapInArrow(run, schema)


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: dict[str, str] | None = None,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    on_batch: Callable[[LineRuns], None] | None = None,
) -> DataFrame:
    """Line dedup of a whole table: ``doc_id, text`` (lines dropped), the carried columns, ``n_lines, n_dropped``.

    Lines found in at least ``min_docs`` documents stay in the document with the largest doc_id alone. The
    table is taken in ``batches`` batches, each a run; a key's runs are summed before the verdict.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, doc_id=doc_id, text=text, **(carry or {}))
    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)).cast("int")
    keys = written(line_keys(rows, min_chars).withColumn("batch", batch), "line-keys", ["batch"])
    runs = LineRuns(spark)
    for number in range(batches):
        runs.add(keys.where(F.col("batch") == number))
        if on_batch:
            on_batch(runs)
    return drop_lines(rows, runs.dropped(keys.select("key", "doc_id"), min_docs), min_chars)


def query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(f.last_doc <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN frequent f ON f.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
