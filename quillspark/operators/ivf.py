"""A stored index of vectors: an inverted file whose lists hold product-quantised residuals.

Fitting. Coarse centroids (spherical k-means) and residual codebooks come from a bounded sample, the ``SAMPLE`` rows with the
least hashes of their ids; so does the number of lists to probe, the least one within which ``TARGET`` of the sample's own
neighbours lie. Nothing else is sampled: every vector is put on the list of its nearest centroid, with one byte for each
``WIDTH`` numbers of what is left of it, divided by the usual length of that on its list: vectors that lie close together
(near copies) are told apart as well as others.

Searching. Codes are dealt to tiles of a bounded number: lists next to each other, or a piece of a list larger than that. A query
goes once to each tile that has lists it probes, with their numbers, however many these are; queries of a tile are taken in blocks
by a hash of their ids, so a vector that a third of the rows or queries share is spread over tasks. Each tile gives the best
``rerank`` by distance to the decoded vectors, the best ``rerank`` of a query get exact scores, k stay. No pair of a query
and a list it doesn't probe is decoded for it.

Defined results: rows without a vector are left out on both sides. Copies of a vector have one code, so ties go to the
smaller id as in ``vector.nearest``. A vector of zeros scores 0 with everything. Repeated query ids are one query's vectors
and should not occur; an empty table of either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import snapshot
from .vector import CHUNK_STEP, QUERY_STEP, SCORE_DIGITS, _best, _first, _unit

SAMPLE = 16_384  # rows that centroids, codebooks and the number of probes are fitted on
CODE_SAMPLE = 4_096  # of these, for the codebooks
TARGET = 0.99  # share of the sample's neighbours that the probed lists hold
TRIED = 256  # sample rows whose neighbours are looked up for that
WIDTH = 2  # numbers that share a byte
CODES = 256
LEAST_SCALE = 1e-6  # lists of copies of one vector
RERANK = 4  # exact scores for so many times k
PIECE = 50_000  # codes of a tile, which one task decodes list by list
ASKED = 2048  # queries that meet them at once
PROBED = 1024  # queries whose rows for tiles are made at once
ROUNDS = 10
FORMAT = 2  # of the stored tables; an index of another format is built anew


def _kmeans(rows: np.ndarray, k: int, seed: int, spherical: bool) -> np.ndarray:
    """k centroids; a centroid that loses all rows stays where it was."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = _nearest_centre(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centres))
        filled = counts > 0
        centres = centres.copy()
        centres[filled] = sums[filled] / counts[filled, None]
        if spherical:
            centres = _unit(list(centres))
    return centres


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


@dataclass(frozen=True)
class Model:
    """``centroids`` (lists, dim), ``scales`` (lists), ``codebooks`` (parts, codes, width), and how many lists a query probes."""

    centroids: np.ndarray
    scales: np.ndarray
    codebooks: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def lists_of(self, unit: np.ndarray) -> np.ndarray:
        return _nearest_centre(unit, self.centroids)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        parts, _, width = self.codebooks.shape
        left = _parts((unit - self.centroids[lists]) / self.scales[lists, None], parts, width)
        return np.stack([_nearest_centre(left[:, j], self.codebooks[j]) for j in range(parts)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, at: int) -> np.ndarray:
        """Vectors of one list."""
        parts, _, width = self.codebooks.shape
        left = self.codebooks[np.arange(parts), codes].reshape(len(codes), parts * width)
        return self.centroids[at] + self.scales[at] * left[:, : self.dim]

    def probed(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]

    def table(self, spark: SparkSession) -> DataFrame:
        shape = [*self.centroids.shape, *self.codebooks.shape]
        row = (shape, self.centroids.astype("<f8").tobytes(), self.scales.astype("<f8").tobytes(), self.codebooks.astype("<f8").tobytes(), self.probes)
        return spark.createDataFrame([row], "shape array<int>, centroids binary, scales binary, codebooks binary, probes int")

    @classmethod
    def of(cls, table: DataFrame) -> Model:
        row = table.first()
        lists, dim, *book = row["shape"]
        centroids = np.frombuffer(row["centroids"], "<f8").reshape(lists, dim)
        return cls(centroids, np.frombuffer(row["scales"], "<f8"), np.frombuffer(row["codebooks"], "<f8").reshape(book), row["probes"])


def _parts(rows: np.ndarray, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width), filled up with zeros."""
    return np.pad(rows, ((0, 0), (0, parts * width - rows.shape[1]))).reshape(len(rows), parts, width)


def fit(items: DataFrame, k: int = 10, target: float = TARGET, sample: int = SAMPLE, width: int = WIDTH, seed: int = 7) -> Model | None:
    """Fit on ``sample`` rows: the root of the number of items as lists, at most one for each 16 sample rows. None without items."""
    items = items.where(F.col("vector").isNotNull())
    n = items.count()
    if n == 0:
        return None
    taken = items.orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(sample).select("vector").collect()
    rows = _unit([r["vector"] for r in taken])
    lists = max(1, min(int(n**0.5), max(1, len(rows) // 16)))
    centroids = _kmeans(rows, lists, seed, spherical=True)
    parts = -(-rows.shape[1] // width)
    near = _nearest_centre(rows, centroids)
    left = rows - centroids[near]
    squares = np.bincount(near, (left**2).sum(axis=1), lists) / np.maximum(1, np.bincount(near, minlength=lists))
    scales = np.maximum(np.sqrt(squares), LEAST_SCALE)
    left = _parts((left / scales[near, None])[:CODE_SAMPLE], parts, width)
    books = np.zeros((parts, CODES, width))
    for j in range(parts):
        found = _kmeans(left[:, j], CODES, seed + j, spherical=False)
        books[j] = found[np.arange(CODES) % len(found)]
    return Model(centroids, scales, books, _probes(rows, centroids, k, target))


def _probes(rows: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """Lists that hold ``target`` of the k nearest sample rows of the first sample rows, themselves left out."""
    asked = rows[:TRIED]
    scores = asked @ rows.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    k = min(k, len(rows) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    lists = _nearest_centre(rows, centroids)
    needed = np.take_along_axis(place, lists[near], axis=1).ravel()
    return int(np.quantile(needed, target, method="higher")) + 1


@dataclass(frozen=True)
class VectorIndex:
    """``codes`` (item_id, list_id, code) of all items, as stored, and the model they were made with."""

    model: Model
    codes: DataFrame


def encoded(items: DataFrame, model: Model) -> DataFrame:
    """(item_id, list_id, code): one pass over the vectors, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                unit = _unit(list(b["vector"]))
                lists = model.lists_of(unit)
                yield pd.DataFrame({"item_id": b["item_id"], "list_id": lists.astype("int32"), "code": [c.tobytes() for c in model.encode(unit, lists)]})

    rows = items.where(F.col("vector").isNotNull()).select("item_id", "vector")
    return rows.mapInPandas(run, f"item_id {dict(items.dtypes)['item_id']}, list_id int, code binary")


def publish(items: DataFrame, root: str, **fitting) -> VectorIndex | None:
    """Fit, encode every item, store below ``root`` and move the pointer. None without items."""
    model = fit(items, **fitting)
    if model is None:
        return None
    snapshot.publish({"codes": encoded(items, model), "model": model.table(items.sparkSession)}, root, FORMAT)
    return load(items.sparkSession, root)


def load(spark: SparkSession, root: str) -> VectorIndex | None:
    found = snapshot.load(spark, root, ["codes", "model"], FORMAT)
    return found and VectorIndex(Model.of(found["model"]), found["codes"])


@dataclass(frozen=True)
class Tiles:
    """Codes are dealt to tiles: a tile has lists ``low`` to ``high`` - 1, or one of several pieces of one large list."""

    first: np.ndarray  # of each list, its first tile
    pieces: np.ndarray  # of each list, how many tiles it has; none without items
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, most: int) -> Tiles:
        """Lists in their order, as many in a tile as have ``most`` items together."""
        first, pieces, low, high, room = np.zeros(len(sizes), int), -(-sizes // most), [], [], 0
        for at, size in enumerate(sizes.tolist()):
            if size == 0:
                continue
            if size > room:
                count = int(pieces[at])
                low, high = low + [at] * count, high + [at + 1] * count
                room = most - size if count == 1 else 0
                first[at] = len(low) - count
            else:
                room, high[-1], first[at] = room - size, at + 1, len(low) - 1
        return cls(first, pieces, np.array(low, int), np.array(high, int))


def probes(queries: DataFrame, model: Model, tiles: Tiles) -> DataFrame:
    """(query_id, vector, tile, lists): a row for each tile that has lists a query asks, with these. ``PROBED`` queries at a time,
    so that what is held doesn't depend on the number of queries or probes in a batch of Spark's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), PROBED):
                b = whole.iloc[a : a + PROBED]
                asked = np.zeros((len(b), len(model.centroids)), bool)
                np.put_along_axis(asked, model.probed(_unit(list(b["vector"]))), True, axis=1)
                at, tile, lists = [], [], []
                for t, (low, high) in enumerate(zip(tiles.low, tiles.high, strict=True)):
                    rows = np.flatnonzero(asked[:, low:high].any(axis=1))
                    at.append(rows)
                    tile.append(np.full(len(rows), t))
                    lists += [(np.flatnonzero(asked[r, low:high]) + low).astype("int32") for r in rows]
                    if sum(map(len, at)) >= PROBED:
                        yield b.iloc[np.concatenate(at)].assign(tile=np.concatenate(tile), lists=lists)
                        at, tile, lists = [], [], []
                if lists:
                    yield b.iloc[np.concatenate(at)].assign(tile=np.concatenate(tile), lists=lists)

    rows = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, vector array<double>, tile long, lists array<int>")


def candidates(index: VectorIndex, queries: DataFrame, count: int) -> DataFrame:
    """(query_id, item_id): of each query, the ``count`` items nearest to it as decoded, on the lists it probes."""
    codes, model = index.codes, index.model
    spark = codes.sparkSession
    # One number for each list, of which the model has a bounded number.
    sizes = np.zeros(len(model.centroids), int)
    for row in codes.groupBy("list_id").count().collect():
        sizes[row["list_id"]] = row["count"]
    cores = spark.sparkContext.defaultParallelism
    tiles = Tiles.of(sizes, max(1, min(PIECE, -(-int(sizes.sum()) // cores))))
    asked = probes(queries, model, tiles)
    blocks = max(1, -(-queries.count() // ASKED))
    grid = spark.createDataFrame(
        [(at, int(tiles.first[at]), int(tiles.pieces[at])) for at in np.flatnonzero(sizes).tolist()], "list_id int, first long, pieces long"
    )
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    right = codes.join(F.broadcast(grid), "list_id").select(
        (F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("pieces"))).alias("tile"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        "item_id",
        "list_id",
        "code",
    )

    def meet(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            best = pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        else:
            row, place, score = _in_tile(model, q, c := c.sort_values("item_id", kind="stable", ignore_index=True), count)
            best = pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "item_id": c["item_id"].to_numpy()[place], "score": score})
        return best.astype({"query_id": object, "item_id": object})

    schema = f"query_id {dict(queries.dtypes)['query_id']}, item_id {dict(codes.dtypes)['item_id']}, score double"
    found = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count).select("query_id", "item_id")


def _in_tile(model: Model, q: pd.DataFrame, c: pd.DataFrame, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score): row numbers of the best of each query, decoded list by list; ``c`` is in the order of its items."""
    lists = c["list_id"].to_numpy()
    low = lists.min()
    asks = np.zeros((len(q), lists.max() - low + 1), bool)
    for row, named in enumerate(q["lists"]):
        named = np.asarray(named)
        asks[row, named[(named >= low) & (named <= lists.max())] - low] = True
    stored = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1)
    asked_for = np.column_stack([_unit(list(q["vector"])), np.ones(len(q))])
    order = np.argsort(lists, kind="stable")
    found, held = [], 0
    for members in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
        at = int(lists[members[0]])
        rows = np.flatnonzero(asks[:, at - low])
        if not len(rows):
            continue
        near = model.decode(stored[members], at)
        # The dot product with the last number in place is 1 less half the squared distance.
        near = np.column_stack([near, (1 - (near**2).sum(axis=1)) / 2])
        row, col, score = _best(asked_for[rows], near, count, QUERY_STEP, CHUNK_STEP)
        found.append((rows[row], members[col], score))
        held += len(row)
        if held > 8 * len(q) * count:
            found = [_first(*map(np.concatenate, zip(*found, strict=True)), count)]
            held = len(found[0][0])
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return _first(*map(np.concatenate, zip(*found, strict=True)), count)


def search(index: VectorIndex, queries: DataFrame, items: DataFrame, k: int, rerank: int = RERANK) -> DataFrame:
    """(query_id, item_id, score, rank): the best k of ``rerank * k`` candidates by exact cosine; ``items`` has the vectors."""
    pairs = (
        candidates(index, queries, rerank * k)
        .join(items.select("item_id", F.col("vector").alias("v")), "item_id")
        .join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
        .select("query_id", "item_id", F.round(F.coalesce(text.cosine("q", "v"), F.lit(0.0)), SCORE_DIGITS).alias("score"))
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
