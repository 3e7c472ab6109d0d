"""A stored keyword index, dealt out by path, that is searched where it lies.

Notes are dealt to shards by a hash of their path, and everything about a note is in its shard: its row of
``documents`` and its postings in ``blocks``, one row for each word and range of 1024 notes, with the greatest
count and the least length of each field in it. Both tables are bucketed by shard, so a search reads the
blocks without a shuffle. Asked words go to them: by broadcast while they are few, else to the shards that have them.

A shard is searched range by range. From the blocks' greatest counts and least lengths follows how much a word
can give to any note of a range, and from these how much a query can get there; ranges that can't reach a
query's k-th best score so far are not opened for it. In an open range the part of each word is computed once for
all queries that ask it. Only k rows per query and shard leave a shard. Scores are those of ``keyword.search``.

Queries are taken in blocks of a fixed number, as their words go to every shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import clock
from ..session import written
from ..sources import snapshot
from . import keyword
from .keyword import FIELD_BOOSTS, SCORE_DIGITS, KeywordParams

RANGE = 1024  # notes per block range
SHARD_NOTES, SHARD_BYTES = 1 << 13, 1 << 25  # a shard's notes are held by one task
QUERY_BLOCK = 256  # queries that are searched in one pass over the shards
KEPT_ASKS = 8  # sets of asked words whose expansion is kept
BROADCAST_ASKS = 50_000  # (word, asked word) pairs that are broadcast: some 100 bytes each, with the word
FIELDS = tuple(FIELD_BOOSTS)


# --- building -------------------------------------------------------------------------------------------


def shard_labels(spark: SparkSession, shards: int) -> list[int]:
    """Numbers that Spark's bucketing puts into buckets of their own: the least one of each bucket."""
    tried = shards * 40
    while True:
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(shards))
        found = spark.range(tried).groupBy(bucket.alias("b")).agg(F.min("id").cast("int").alias("label")).orderBy("b").collect()
        if len(found) == shards:
            return [row["label"] for row in found]
        tried *= 4


def shard_count(notes: DataFrame) -> int:
    """So many that a shard has about 8192 notes and 32 MB of text at most, and enough for all cores."""
    row = notes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes")).first()
    return max(-(-row["n"] // SHARD_NOTES), -(-(row["bytes"] or 0) // SHARD_BYTES), notes.sparkSession.sparkContext.defaultParallelism)


def _dealt(notes: DataFrame, labels: list[int], columns: dict[str, Column]) -> DataFrame:
    """``columns`` of notes by shard, with the note's place among the paths of its shard."""
    shards = len(labels)
    label = F.element_at(F.array(*map(F.lit, labels)), F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int") + 1)
    rows = notes.select(label.alias("shard"), *[c.alias(name) for name, c in columns.items()]).repartition(shards, "shard")
    return rows.withColumn("doc", F.row_number().over(Window.partitionBy("shard").orderBy("path")) - 1)


def _tokens() -> dict[str, Column]:
    return {
        "title": text.index_tokens("title"),
        "tags": text.index_tokens(F.array_join("tags", " ")),
        "content": text.index_tokens("content"),
    }


def documents(notes: DataFrame, labels: list[int]) -> DataFrame:
    """(shard, doc, path, created_at, flags, tags, len_*): facts of each note."""
    lengths = {f"len_{f}": F.size(F.array_distinct(tokens)) for f, tokens in _tokens().items()}
    facts = {"path": F.col("path"), "created_at": F.col("created_at"), "flags": keyword._flags(), "tags": F.transform("tags", F.lower)}
    return _dealt(notes, labels, facts | lengths)


_POSTING = pa.struct([(name, pa.int32()) for name in ("doc", *[f"tf_{f}" for f in FIELDS])])
_BLOCK = pa.schema(
    [("shard", pa.int32()), ("term", pa.string()), ("range", pa.int32()), ("docs", pa.list_(_POSTING))]
    + [(f"{name}_{f}", pa.int32()) for name in ("max", "least", "n") for f in FIELDS]
)
_BLOCK_DDL = "shard int, term string, range int, docs array<struct<{}>>, {}".format(
    ", ".join(f"{x.name}:int" for x in _POSTING), ", ".join(f"{x.name} int" for x in list(_BLOCK)[4:])
)


def blocks(notes: DataFrame, labels: list[int], notes_per_range: int = RANGE) -> DataFrame:
    """(shard, term, range, docs, max_*, least_*, n_*): bodies are shuffled once, by shard, as text; a shard's words are counted as arrays."""
    dealt = _dealt(notes, labels, {c: F.col(c) for c in ("path", "title", "tags", "content")})
    words = dealt.select("shard", "doc", *[tokens.alias(f"t_{f}") for f, tokens in _tokens().items()])
    return words.groupBy("shard").applyInArrow(lambda table: _blocks_of(table, notes_per_range), _BLOCK_DDL)


def _blocks_of(table: pa.Table, size: int) -> pa.Table:
    """The blocks of one shard; ``table``: its notes with the words of each field."""
    table = table.combine_chunks()
    shard, doc, n = table["shard"][0].as_py(), table["doc"].to_numpy(), table.num_rows
    flat, at, field = [], [], []
    for i, f in enumerate(FIELDS):
        for words in table[f"t_{f}"].chunks:
            flat.append(words.flatten())
            at.append(np.repeat(doc, pc.fill_null(pc.list_value_length(words), 0).to_numpy()))
            field.append(np.full(len(flat[-1]), i))
    coded = pa.concat_arrays(flat).dictionary_encode()
    if not len(coded):
        return _BLOCK.empty_table()
    # Words and notes in one number, in the order of the result.
    met, place = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.concatenate(at), return_inverse=True)
    tf = np.bincount(place * len(FIELDS) + np.concatenate(field), minlength=len(met) * len(FIELDS)).reshape(len(met), len(FIELDS))
    term, doc = np.divmod(met, n)
    part = term * (n // size + 1) + doc // size
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    docs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (doc, *tf.T)], fields=list(_POSTING))
    columns = {
        "shard": np.full(len(starts), shard),
        "term": coded.dictionary.take(pa.array(term[starts])),
        "range": doc[starts] // size,
        "docs": pa.ListArray.from_arrays(pa.array(np.append(starts, len(met)).astype(np.int32)), docs),
    }
    for f, times in zip(FIELDS, tf.T, strict=True):
        has = times > 0
        length = np.bincount(doc[has], minlength=n)[doc]  # different words of the field
        least = np.minimum.reduceat(np.where(has, length, n + len(met)), starts)
        columns[f"max_{f}"] = np.maximum.reduceat(times, starts)
        columns[f"n_{f}"] = np.add.reduceat(has.astype(np.int64), starts)
        columns[f"least_{f}"] = np.where(columns[f"n_{f}"] > 0, least, 0)
    return pa.table([pa.array(columns[x.name]).cast(x.type) for x in _BLOCK], schema=_BLOCK)


def publish(notes: DataFrame, root: str, shards: int | None = None, notes_per_range: int = RANGE) -> StoredIndex:
    """Build, store below ``root`` and move the pointer."""
    spark = notes.sparkSession
    labels = shard_labels(spark, shards or shard_count(notes))
    base = f"{root.rstrip('/')}/parts/{uuid.uuid4().hex}"
    for name, table in (("documents", documents(notes, labels)), ("blocks", blocks(notes, labels, notes_per_range))):
        _bucketed(table, f"{base}/{name}", len(labels))
    stored = spark.read.parquet(f"{base}/blocks")
    dictionary = stored.groupBy("term").agg(*[F.sum(f"n_{f}").alias(f"df_{f}") for f in FIELDS])
    facts = spark.read.parquet(f"{base}/documents").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len_{f}").alias(f) for f in FIELDS])
    stats = facts.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col("n").alias("n_notes"), F.col(f).alias("avg_len")) for f in FIELDS])))
    parts = keyword.spelling_parts(dictionary.select("term")).repartition(len(labels), *keyword.SPELLING_KEY)
    _bucketed(parts, f"{base}/spellings", len(labels), keyword.SPELLING_KEY)
    places = spark.createDataFrame([(base, len(labels), notes_per_range)], "base string, shards int, notes_per_range int")
    snapshot.publish({"dictionary": dictionary, "field_stats": stats, "spread": places}, root)
    return load(spark, root)


def _bucketed(table: DataFrame, path: str, shards: int, by: tuple[str, ...] = ("shard",)) -> None:
    """``table`` has the rows of a bucket in one task, so a bucket is one file."""
    name = f"quillspark_{uuid.uuid4().hex}"
    table.write.bucketBy(shards, *by).sortBy(*by).option("path", path).saveAsTable(name)
    table.sparkSession.sql(f"DROP TABLE {name}")  # the files stay, as the table is external


def load(spark: SparkSession, root: str) -> StoredIndex | None:
    """The newest published index, or None."""
    found = snapshot.load(spark, root, ["dictionary", "field_stats", "spread"])
    if found is None:
        return None
    where = found["spread"].first()

    def opened(name: str, by: tuple[str, ...] = ("shard",)) -> DataFrame:
        path = f"{where['base']}/{name}"
        schema = spark.read.parquet(path).schema
        table = f"quillspark_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys = ", ".join(by)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {where['shards']} BUCKETS LOCATION '{path}'")
        return spark.table(table)

    spellings = opened("spellings", keyword.SPELLING_KEY)
    return StoredIndex(opened("blocks"), opened("documents"), found["dictionary"], found["field_stats"], spellings, where["notes_per_range"])


# --- searching ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class StoredIndex:
    """``blocks`` and ``documents`` bucketed by shard; ``dictionary`` and ``field_stats`` as in ``KeywordIndex``;
    ``spellings`` the parts of its words, for near spellings."""

    blocks: DataFrame
    documents: DataFrame
    dictionary: DataFrame
    field_stats: DataFrame
    spellings: DataFrame
    notes_per_range: int
    asked: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def docs(self) -> DataFrame:
        return self.documents.select("path", "tags")

    @property
    def postings(self) -> DataFrame:
        """(path, term, tf_*): one row per note and word, for reports."""
        rows = self.blocks.select("shard", "term", F.inline("docs"))
        return rows.join(self.documents.select("shard", "doc", "path"), ["shard", "doc"]).select("path", "term", *[f"tf_{f}" for f in FIELDS])

    def search(
        self,
        queries: DataFrame,
        as_of: str,
        limit: int = 10,
        expand: bool = True,
        params: KeywordParams = keyword.DEFAULT,
        tags: tuple[str, ...] | None = None,
        folder: str | None = None,
        query_block: int = QUERY_BLOCK,
    ) -> DataFrame:
        """(query_id, path, score, rank), as ``keyword.search``."""
        kind = queries.schema["query_id"].dataType.simpleString()
        per_row = [c for c in ("tags", "folder") if c in queries.columns]
        asked = queries.select("query_id", text.index_tokens("query").alias("words"), *per_row)
        out = None
        # The stated queries come to the driver, block by block.
        for block in _in_blocks(asked.toLocalIterator(), query_block):
            found = self._pass(block, as_of, limit, expand, params, tags, folder, kind)
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = queries.sparkSession.createDataFrame([], f"query_id {kind}, path string, score double")
        # k rows per query, which callers read more than once.
        return written(keyword.top_k(out, limit), "hits")

    def _asks(self, words: list[str], expand: bool, p: KeywordParams, stats: dict) -> tuple[DataFrame, bool]:
        """(term, asks): dictionary words and the asked words they answer, with weights; and whether they are few.

        Written, and kept for searches of the same words, such as that for a question's note and that for its route.
        """
        key = (expand, repr(p), *words)
        if key in self.asked:
            return self.asked[key]
        spark = self.blocks.sparkSession
        source = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "source_term string, sid int")
        if expand:
            pairs = keyword.expand_words(source.select("source_term"), self.dictionary.select("term"), p, self.spellings)
            pairs = pairs.join(F.broadcast(source), "source_term")
        else:
            pairs = source.select("source_term", "sid", F.col("source_term").alias("term"), F.lit(1.0).alias("w"))
        # The dictionary is never broadcast: in memory it is many times its file.
        pairs = written(pairs, "pairs")
        few = pairs.count() <= BROADCAST_ASKS
        weights = []
        for f, boost in p.boosts.items():
            df = F.col(f"df_{f}")
            idf = F.log(1 + (F.lit(float(stats[f][0])) - df + 0.5) / (df + 0.5))
            weights.append((F.col("w") * float(boost) * idf).alias(f"w_{f}"))
        asks = written(
            self.dictionary.join(pairs.hint("broadcast" if few else "merge"), "term")
            .select("term", F.struct("sid", *weights).alias("ask"))
            .groupBy("term")
            .agg(F.sort_array(F.collect_list("ask")).alias("asks")),
            "asks",
        )
        n = asks.agg(F.sum(F.size("asks"))).first()[0] or 0
        if len(self.asked) >= KEPT_ASKS:
            self.asked.pop(next(iter(self.asked)))
        self.asked[key] = asks, n <= BROADCAST_ASKS
        return self.asked[key]

    def _pass(self, block: list, as_of: str, limit: int, expand: bool, p: KeywordParams, tags, folder, kind: str) -> DataFrame:
        spark = self.blocks.sparkSession
        words = sorted({w for row in block for w in row["words"]})
        number = {w: i for i, w in enumerate(words)}
        stats = {row["field"]: (row["n_notes"], row["avg_len"]) for row in self.field_stats.collect()}
        asks, small = self._asks(words, expand, p, stats)
        found = self.blocks.select("shard", "term", "range", "docs", *[f"{b}_{f}" for b in ("max", "least") for f in FIELDS])
        if small:
            # Asks are lists: the size of their files says little of that in memory, so they are broadcast by their count alone.
            found = found.join(asks.hint("broadcast"), "term")
        allowed = F.lit(True)
        if tags:
            allowed = F.arrays_overlap("tags", F.array(*[F.lit(t.lower()) for t in tags]))
        if folder:
            base = folder.rstrip("/")
            allowed = allowed & ((F.col("path") == base) | F.startswith("path", F.lit(base + "/")))
        by_row = any("tags" in row and row["tags"] for row in block)
        boost = lambda asked: keyword.document_boost(F.col("created_at"), F.col("flags"), clock(as_of), F.lit(asked))
        facts = self.documents.select(
            "shard", "doc", "path", *[f"len_{f}" for f in FIELDS], boost(False).alias("boost"), boost(True).alias("boost_asked"),
            F.coalesce(allowed, F.lit(False)).alias("allowed"), *(["tags"] if by_row else []),
        )
        if not small:
            # Blocks stay where they lie here too: asks go to the shards that have their word, beside the notes.
            places = self.blocks.select("shard", "term").distinct()
            facts = facts.unionByName(places.join(asks.hint("merge"), "term"), allowMissingColumns=True)
        shared = spark.sparkContext.broadcast([_Query.of(row, number, bool(tags) and text.SESSION_TAG in tags) for row in block])
        average, size = {f: float(stats[f][1] or 1.0) for f in FIELDS}, self.notes_per_range

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not small:
                left, right = _asked_blocks(left, right)
            rows = _Shard(left, right, average, p, size).search(shared.value, limit, len(words)) if left.num_rows and right.num_rows else []
            ids, paths, scores = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.table({"query_id": pa.array(ids, _arrow(kind)), "path": pa.array(paths, pa.string()), "score": pa.array(scores, pa.float64())})

        return found.groupBy("shard").cogroup(facts.groupBy("shard")).applyInArrow(run, f"query_id {kind}, path string, score double")


def _asked_blocks(left: pa.Table, right: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Blocks of asked words with what asks them, and the notes; ``right`` has rows of both kinds."""
    note = pc.is_valid(right["doc"])
    asks = right.filter(pc.invert(note)).select(["term", "asks"]).combine_chunks()
    left = left.combine_chunks()
    at = pc.index_in(left["term"], value_set=asks["term"])
    met = pc.is_valid(at)
    rows = left.filter(met)
    return rows.append_column("asks", asks["asks"].take(at.filter(met))), right.filter(note)


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def _in_blocks(rows: Iterator, size: int) -> Iterator[list]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


@dataclass(frozen=True)
class _Query:
    query_id: object
    words: np.ndarray  # numbers of its words
    times: np.ndarray  # how often each occurs
    tags: tuple[str, ...] | None
    folder: str | None
    sessions: bool  # it asks for sessions

    @staticmethod
    def of(row, number: dict[str, int], sessions: bool) -> _Query:
        words, times = np.unique(np.array([number[w] for w in row["words"]], np.int64), return_counts=True)
        tags = tuple(t.lower() for t in row["tags"]) if "tags" in row and row["tags"] else None
        folder = row["folder"].rstrip("/") if "folder" in row and row["folder"] is not None else None
        return _Query(row["query_id"], words, times.astype(float), tags, folder, sessions or bool(tags and text.SESSION_TAG in tags))


class _Shard:
    """Blocks of the asked words and the notes of one shard, as arrays."""

    def __init__(self, left: pa.Table, right: pa.Table, average: dict[str, float], p: KeywordParams, size: int):
        left = left.sort_by([("range", "ascending"), ("term", "ascending")]).combine_chunks()
        right = right.sort_by("doc").combine_chunks()
        self.p, self.size, self.paths = p, size, right["path"].to_pylist()
        self.allowed = right["allowed"].to_numpy()
        self.boosts = {False: right["boost"].to_numpy(), True: right["boost_asked"].to_numpy()}
        self.tags = right["tags"].to_pylist() if "tags" in right.column_names else None
        norm = {f: p.k1 * (1 - p.b + p.b * right[f"len_{f}"].to_numpy() / average[f]) for f in FIELDS}
        docs, asks = (left[n].chunk(0) if left[n].num_chunks else left[n].combine_chunks() for n in ("docs", "asks"))
        self.docs_at, self.asks_at = docs.offsets.to_numpy(), asks.offsets.to_numpy()
        posting, ask = docs.values, asks.values
        self.doc = posting.field("doc").to_numpy()
        self.parts = []
        for f in FIELDS:
            tf = posting.field(f"tf_{f}").to_numpy().astype(float)
            self.parts.append(np.where(tf > 0, p.delta + tf * (p.k1 + 1) / (tf + norm[f][self.doc]), 0.0))
        self.sid = ask.field("sid").to_numpy()
        self.weights = [ask.field(f"w_{f}").to_numpy() for f in FIELDS]
        # What a block can give at most: its greatest count in its shortest field.
        ranges = left["range"].to_numpy()
        self.n_ranges = -(-len(self.paths) // size)
        self.rows = np.searchsorted(ranges, np.arange(self.n_ranges + 1))
        most = []
        for f in FIELDS:
            tf = left[f"max_{f}"].to_numpy().astype(float)
            least = p.k1 * (1 - p.b + p.b * left[f"least_{f}"].to_numpy() / average[f])
            most.append(np.where(tf > 0, p.delta + tf * (p.k1 + 1) / (tf + least), 0.0))
        row_of_ask = np.repeat(np.arange(left.num_rows), np.diff(self.asks_at))
        self.bound_at = ranges[row_of_ask], self.sid
        self.bound = sum(w * m[row_of_ask] for w, m in zip(self.weights, most, strict=True))

    def word_parts(self, number: int, n_words: int) -> np.ndarray:
        """What each word gives to each note of a range."""
        a, b = self.rows[number], self.rows[number + 1]
        asks = np.arange(self.asks_at[a], self.asks_at[b])
        row = np.repeat(np.arange(a, b), np.diff(self.asks_at[a : b + 1]))
        sizes = self.docs_at[row + 1] - self.docs_at[row]
        ask = np.repeat(asks, sizes)
        # Numbers of the postings of each row, row by row.
        posting = np.arange(len(ask)) + np.repeat(self.docs_at[row] - (np.cumsum(sizes) - sizes), sizes)
        value = sum(w[ask] * part[posting] for w, part in zip(self.weights, self.parts, strict=True))
        at = self.sid[ask].astype(np.int64) * self.size + (self.doc[posting] - number * self.size)
        return np.bincount(at, value, n_words * self.size).reshape(n_words, self.size)

    def may_see(self, query: _Query) -> np.ndarray:
        seen = self.allowed
        if query.tags is not None:
            seen = seen & np.array([not query_tags.isdisjoint(query.tags) for query_tags in map(set, self.tags)])
        if query.folder is not None:
            seen = seen & np.array([path == query.folder or path.startswith(query.folder + "/") for path in self.paths])
        return seen

    def search(self, queries: list[_Query], k: int, n_words: int) -> list[tuple]:
        bound = np.zeros((n_words, self.n_ranges))
        np.add.at(bound, (self.bound_at[1], self.bound_at[0]), self.bound)
        limits = np.zeros((len(queries), self.n_ranges))
        for i, q in enumerate(queries):
            boost = [self.boosts[q.sessions][r * self.size : (r + 1) * self.size].max() for r in range(self.n_ranges)]
            most = q.times @ bound[q.words]
            limits[i] = most * boost * ((bound[q.words] > 0).sum(axis=0) if self.p.coverage else 1)
        seen = [self.may_see(q) for q in queries]
        best: list[list[tuple[float, str]]] = [[] for _ in queries]
        least = np.full(len(queries), -np.inf)
        self.opened = 0
        for r in np.argsort(-limits.max(axis=0, initial=0.0)).tolist():
            # Scores are rounded; a limit that is equal but for rounding must still be opened.
            open_ = np.flatnonzero((limits[:, r] > 0) & (limits[:, r] * (1 + 1e-9) + 10.0**-SCORE_DIGITS >= least))
            if not len(open_):
                continue
            self.opened += len(open_)
            parts = self.word_parts(r, n_words)
            a = r * self.size
            size = min(self.size, len(self.paths) - a)
            for i in open_.tolist():
                q = queries[i]
                own = parts[q.words, :size]
                raw = q.times @ own
                if self.p.coverage:
                    raw = raw * (own > 0).sum(axis=0)
                score = np.round(raw * self.boosts[q.sessions][a : a + size], SCORE_DIGITS)
                at = np.flatnonzero((raw > 0) & seen[i][a : a + size] & (score >= least[i]))
                if len(at) > k:
                    at = at[score[at] >= np.partition(score[at], -k)[-k]]
                if len(at):
                    merged = best[i] + [(-s, self.paths[a + d]) for s, d in zip(score[at].tolist(), at.tolist(), strict=True)]
                    best[i] = sorted(merged)[:k]
                    if len(best[i]) == k:
                        least[i] = -best[i][-1][0]
        return [(q.query_id, path, -s) for q, found in zip(queries, best, strict=True) for s, path in found]


# --- one stored index per state of the files ------------------------------------------------------------


def state_of(table: DataFrame) -> str:
    """A digest of the files below a table: names, sizes and times. No column is read."""
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    row = table.select(file.alias("h"), F.hash("_metadata.file_path").alias("p")).distinct().agg(F.bit_xor("h"), F.sum("p")).first()
    return f"{row[0]}-{row[1]}".replace("-", "m")



#: Indexes this driver has opened, by application and folder.
_OPEN: dict[tuple[str, str], StoredIndex] = {}


def current(spark: SparkSession, notes: Callable[[], DataFrame], root: str, rebuild: bool = False) -> StoredIndex:
    """The index stored below ``root``; built from ``notes`` if there is none yet, or on demand."""
    key = (spark.sparkContext.applicationId, root)
    if rebuild or key not in _OPEN:
        _OPEN[key] = (None if rebuild else load(spark, root)) or publish(notes(), root)
    return _OPEN[key]
