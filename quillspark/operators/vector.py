"""Section chunks, hash-keyed embedding, exact nearest chunks. Approximate ones are in ``ivf``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.markdown import section_chunks

DIM = 64
SCORE_DIGITS = 6
QUERY_BLOCK = 2048
CHUNK_BLOCK = 50_000
KEPT_WORDS = 1 << 18  # words whose place a task remembers
QUERY_STEP, CHUNK_STEP = 256, 8192  # products that are held at once

Embedder = Callable[[pd.Series], "list[np.ndarray]"]


# --- chunks -------------------------------------------------------------------------------


def chunk_table(notes: DataFrame, curated_only: bool = False) -> DataFrame:
    """(path, chunk_ix, heading, text, hash): one row per section, without a shuffle."""
    if curated_only:
        notes = notes.where(~text.is_raw_session("path"))
    return notes.select(
        "path", F.posexplode(section_chunks("title", "content")).alias("chunk_ix", "c")
    ).select(
        "path",
        "chunk_ix",
        F.col("c.heading").alias("heading"),
        F.col("c.text").alias("text"),
        text.content_hash("c.text").alias("hash"),
    )


# --- embedding ----------------------------------------------------------------------------


def hash_embedder(dim: int = DIM) -> Embedder:
    """Offline stand-in for a model: signed feature hashing of the words, unit length."""

    seen: dict[str, int] = {}

    def slot(word: str) -> int:
        """Twice the place, and 1 more for a word that counts negative."""
        h = hashlib.md5(word.encode("utf-8")).hexdigest()
        return 2 * (int(h[:4], 16) % dim) + (int(h[4], 16) >= 8)

    def embed(texts: pd.Series) -> list[np.ndarray]:
        out = []
        for t in texts:
            if len(seen) > KEPT_WORDS:
                seen.clear()
            slots = []
            for w in filter(None, (t or "").split(" ")):
                at = seen.get(w)
                if at is None:
                    at = seen[w] = slot(w)
                slots.append(at)
            both = np.bincount(np.array(slots, np.intp), minlength=2 * dim)
            v = (both[0::2] - both[1::2]).astype(float)
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return out

    return embed


def word_text(c: Column) -> Column:
    """Words the offline embedder sees: lower-case index tokens joined by blanks."""
    return F.array_join(text.index_tokens(c), " ")


def embed_texts(df: DataFrame, embedder: Embedder, text_col: str = "text") -> DataFrame:
    """(hash, vector) for rows with ``hash`` and a text; Arrow batches, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"hash": b["hash"], "vector": embedder(b["t"])})

    return df.select("hash", F.col(text_col).alias("t")).mapInPandas(
        run, "hash string, vector array<double>"
    )


def embed_new(
    chunks: DataFrame, cache: DataFrame | None, embedder: Embedder, text_col: str = "text"
) -> DataFrame:
    """Vectors for all live hashes; only texts the cache does not hold are embedded, each once."""
    texts = chunks.groupBy("hash").agg(F.any_value(text_col).alias(text_col))
    if cache is None:
        return embed_texts(texts, embedder, text_col)
    fresh = embed_texts(texts.join(cache, "hash", "left_anti"), embedder, text_col)
    live = cache.join(chunks.select("hash").distinct(), "hash", "left_semi")
    return live.select("hash", "vector").unionByName(fresh)


def embedded_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors, "hash")


def update_chunks(
    embedded: DataFrame, changed: DataFrame, removed_paths: DataFrame, embedder: Embedder
) -> DataFrame:
    """Replace the chunks of changed notes, drop those of removed ones; reuse known vectors."""
    gone = changed.select("path").unionByName(removed_paths.select("path")).distinct()
    fresh = chunk_table(changed)
    cache = embedded.groupBy("hash").agg(F.any_value("vector").alias("vector"))
    added = embedded_chunks(fresh, embed_new(fresh, cache, embedder))
    return embedded.join(gone, "path", "left_anti").unionByName(added)


# --- exact nearest -------------------------------------------------------------------------


def _unit(rows: list) -> np.ndarray:
    m = np.asarray([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(q: np.ndarray, c: np.ndarray, k: int, query_step: int, item_step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score): row numbers of the best k by (rounded score, item), a small block of products at a time."""
    found = []
    for a in range(0, len(q), query_step):
        rows, cols, scores = [], [], []
        for b in range(0, len(c), item_step):
            s = np.round(q[a : a + query_step] @ c[b : b + item_step].T, SCORE_DIGITS) + 0.0
            # What ties with the k-th score is decided by ids; of many ties at once, so that few are held.
            edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else -np.inf
            row, col = np.nonzero(s >= edge)
            score = s[row, col]
            if len(row) > 4 * len(s) * k:
                row, col, score = _first(row, col, score, k)
            rows.append(row)
            cols.append(col + b)
            scores.append(score)
            if sum(map(len, rows)) > 16 * len(s) * k:
                rows, cols, scores = ([x] for x in _first(np.concatenate(rows), np.concatenate(cols), np.concatenate(scores), k))
        row, col, score = _first(np.concatenate(rows), np.concatenate(cols), np.concatenate(scores), k)
        found.append((row + a, col, score))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _first(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row."""
    order = np.lexsort((col, -score, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[order][keep], score[order][keep]


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_block: int = QUERY_BLOCK,
    item_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """(query_id, item_id, score, rank): exact top-k by cosine.

    Queries of one tile go to the items, wherever these are: items are read once and not shuffled, and k rows per query and task
    are. More queries and items are hashed into tiles and each pair of tiles is one group: no task holds more than one tile of either
    side, and k rows per query and tile pair are shuffled. A tile
    has as many blocks as fit into the usual size, so small blocks cost no more copies; their products are taken block by
    block, and 256 by 8192 numbers are held at most.
    """
    id_type = dict(items.dtypes)["item_id"]
    q_type = dict(queries.dtypes)["query_id"]
    schema = f"query_id {q_type}, item_id {id_type}, score double"
    held = queries.select("query_id", "vector").limit(QUERY_BLOCK + 1).collect()
    if len(held) > QUERY_BLOCK:
        local = _block_join(queries, items, k, schema, query_block, item_block)
    else:
        local = _beside_items(held, items, k, schema, query_block, item_block)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _beside_items(held: list, items: DataFrame, k: int, schema: str, query_block: int, item_block: int) -> DataFrame:
    """The best k of each task's items for the queries ``held``, batch by batch."""
    if not held:
        return items.sparkSession.createDataFrame([], schema)
    ids, asked = np.array([r["query_id"] for r in held], object), _unit([r["vector"] for r in held])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            if b.empty:
                continue
            b = b.sort_values("item_id", kind="stable", ignore_index=True)
            row, col, score = _best(asked, _unit(list(b["vector"])), k, min(query_block, QUERY_STEP), min(item_block, CHUNK_STEP))
            found = pd.DataFrame({"row": row, "item_id": b["item_id"].to_numpy()[col], "score": score})
            if best is not None:
                found = pd.concat([best, found]).sort_values(["row", "score", "item_id"], ascending=[True, False, True], kind="stable", ignore_index=True)
                found = found[found.groupby("row").cumcount() < k]
            best = found
        if best is not None:
            yield pd.DataFrame({"query_id": ids[best["row"].to_numpy()], "item_id": best["item_id"].to_numpy(), "score": best["score"].to_numpy()})

    return items.select("item_id", "vector").mapInPandas(run, schema)


def _block_join(
    queries: DataFrame, items: DataFrame, k: int, schema: str, query_block: int, item_block: int
) -> DataFrame:
    q_blocks = max(1, -(-queries.count() // max(query_block, QUERY_BLOCK)))
    # At least one tile per core, so that few items keep all cores busy.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    c_blocks = max(cores, -(-items.count() // max(item_block, CHUNK_BLOCK)))
    q = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"),
        "query_id",
        "vector",
    )
    c = items.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"),
        F.pmod(F.xxhash64("item_id"), F.lit(c_blocks)).alias("cb"),
        "item_id",
        "vector",
    )

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            best = pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        else:
            right = right.sort_values("item_id", kind="stable", ignore_index=True)
            row, col, score = _best(
                _unit(list(left["vector"])), _unit(list(right["vector"])), k, min(query_block, QUERY_STEP), min(item_block, CHUNK_STEP)
            )
            best = pd.DataFrame({"query_id": left["query_id"].to_numpy()[row], "item_id": right["item_id"].to_numpy()[col], "score": score})
        # Plain objects: a frame of Arrow-backed strings can't be put into one batch with the others.
        return best.astype({"query_id": object, "item_id": object})

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(pair, schema)


def semantic_search(
    queries: DataFrame, embedded: DataFrame, embedder: Embedder, limit: int = 8
) -> DataFrame:
    """(query_id, path, chunk_ix, score, rank) for query texts; ``text`` goes to the embedder."""
    q = queries.select(F.col("query_id").cast("string").alias("hash"), "query_id", "text")
    vecs = embed_texts(q, embedder)
    vecs = q.join(vecs, "hash").select("query_id", "vector")
    key = F.concat_ws("\u0001", "path", F.lpad(F.col("chunk_ix").cast("string"), 8, "0"))
    hits = nearest(vecs, embedded.select(key.alias("item_id"), "vector"), limit)
    part = F.split("item_id", "\u0001")
    return hits.select(
        "query_id",
        F.element_at(part, 1).alias("path"),
        F.element_at(part, 2).cast("int").alias("chunk_ix"),
        "score",
        "rank",
    )


def chunk_snippet(c: Column) -> Column:
    return F.when(F.length(c) > 320, F.concat(F.substring(c, 1, 320), F.lit("…"))).otherwise(c)


def first_hit_per_note(hits: DataFrame) -> DataFrame:
    """Chunk hits to note hits: the best rank of each note stands, ranks are renumbered."""
    best = hits.groupBy("query_id", "path").agg(
        F.min("rank").alias("chunk_rank"), F.max("score").alias("score")
    )
    w = Window.partitionBy("query_id").orderBy("chunk_rank")
    return best.select("query_id", "path", "score", F.row_number().over(w).alias("rank"))
