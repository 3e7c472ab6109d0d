"""Hybrid search, recall and evaluation put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, evals, fusion, keyword, routing, vector
from ..session import written

DEFAULT_LIMIT, MAX_LIMIT = 8, 25


def pins_of(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("path").isNotNull()).select("query_id", "path", F.lit(1).alias("pin_ord"))


def hybrid_ranks(
    keyword_hits: DataFrame,
    semantic_hits: DataFrame | None,
    routes: DataFrame | None,
    limit: int | None,
) -> DataFrame:
    """Fuse both lists, raw sessions demoted, routed note pinned where it was retrieved."""
    lists = [keyword_hits] if semantic_hits is None else [keyword_hits, semantic_hits]
    return fusion.fuse(
        lists,
        weight=fusion.path_weight(),
        pins=pins_of(routes) if routes is not None else None,
        limit=limit,
    )


def hybrid_search(
    index: keyword.KeywordIndex,
    notes: DataFrame,
    queries: DataFrame,
    brief_map: DataFrame,
    as_of: str,
    limit: int = DEFAULT_LIMIT,
    embedded: DataFrame | None = None,
    embedder: vector.Embedder | None = None,
    expand: bool = True,
    explain: bool = False,
) -> DataFrame:
    """(query_id, rank, path, title, snippet) for many questions at once.

    ``queries``: query_id, query. Both lists are fetched three times as deep as the result. With
    ``explain`` the routing decision is added. Bodies are only read for the rows that are kept.
    """
    limit = max(1, min(MAX_LIMIT, limit))
    wide = 3 * limit
    kw = keyword.search(index, queries, as_of, limit=wide, expand=expand)
    sem = None
    if embedded is not None and embedder is not None:
        texts = queries.select("query_id", vector.word_text("query").alias("text"))
        sem = vector.first_hit_per_note(
            vector.semantic_search(texts, embedded, embedder, wide)
        )
    topics = queries.select("query_id", F.col("query").alias("topic"))
    routes = routing.route_topics(index, topics, brief_map, notes, as_of, expand=expand)
    fused = hybrid_ranks(kw, sem, routes, limit)
    out = keyword.with_snippets(fused, notes, queries)
    # Notes only the vector list found are shown under their file name.
    named = out.join(
        kw.select("query_id", "path", F.lit(True).alias("by_word")), ["query_id", "path"], "left"
    ).select(
        "query_id",
        "rank",
        "path",
        F.when(F.col("by_word"), F.col("title")).otherwise(text.slug("path")).alias("title"),
        "snippet",
    )
    if explain:
        named = named.join(
            routes.select(
                "query_id",
                F.struct(F.col("path"), "method", "score", "margin").alias("route"),
            ),
            "query_id",
        )
    return named


def recall_prompts(
    index: keyword.KeywordIndex,
    notes: DataFrame,
    prompts: DataFrame,
    brief_map: DataFrame,
    as_of: str,
    semantic: DataFrame | None = None,
    expand: bool = True,
    **options,
) -> DataFrame:
    """Recall decision for every prompt. ``prompts``: query_id, prompt; ``semantic``: ranked list."""
    q = prompts.select("query_id", F.col("prompt").alias("query"))
    topics = prompts.select("query_id", F.col("prompt").alias("topic"))
    routes = routing.route_topics(index, topics, brief_map, notes, as_of, expand=expand)
    routes = written(routes, "routes")  # read for the notes and for the decisions
    kw = keyword.search(index, q, as_of, limit=3 * context.RECALL_HITS, expand=expand)
    fused = hybrid_ranks(kw, semantic, None, None)
    vocabulary = context.domain_vocabulary(notes, brief_map)
    return context.recall(prompts, notes, routes, fused, vocabulary, **options)


def five_modes(
    keyword_hits: DataFrame,
    semantic_hits: DataFrame,
    query_routes: DataFrame,
    topic_routes: DataFrame,
) -> DataFrame:
    """(mode, case_id, path, rank) of all five retrieval modes, for one scoring pass."""
    raw = hybrid_ranks(keyword_hits, semantic_hits, None, None)
    by_query = hybrid_ranks(keyword_hits, semantic_hits, query_routes, None)
    by_topic = hybrid_ranks(keyword_hits, semantic_hits, topic_routes, None)
    out = None
    for mode, df in zip(
        evals.MODES, (keyword_hits, semantic_hits, raw, by_query, by_topic), strict=True
    ):
        part = df.select(F.lit(mode).alias("mode"), F.col("query_id").alias("case_id"), "path", "rank")
        out = part if out is None else out.unionByName(part)
    return out
