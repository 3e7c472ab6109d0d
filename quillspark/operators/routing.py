"""Route a topic to the one note that owns it, or abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.base import strip
from . import keyword

FLOOR = 4.0
MARGIN = 1.3


def note_keywords(notes: DataFrame) -> DataFrame:
    """(keyword, path) declared by routable notes, keywords and aliases together."""
    return notes.where(text.is_routable("tags")).select(
        "path", F.explode(text.keyword_list("fm.keywords", "fm.aliases")).alias("keyword")
    )


def build_map(declared: DataFrame, file_map: DataFrame | None = None) -> DataFrame:
    """(keyword, path, src): the first note by path wins, the file map overrides."""
    own = declared.groupBy("keyword").agg(F.min("path").alias("fm_path"))
    if file_map is None:
        return own.select("keyword", F.col("fm_path").alias("path"), F.lit("note").alias("src"))
    explicit = (
        file_map.select(strip(F.lower("keyword")).alias("keyword"), F.col("path").alias("file_path"))
        .where(strip("file_path") != "")
        .groupBy("keyword")
        .agg(F.max("file_path").alias("file_path"))
    )
    return own.join(explicit, "keyword", "full").select(
        "keyword",
        F.coalesce("file_path", "fm_path").alias("path"),
        F.when(F.col("file_path").isNotNull(), "file").otherwise("note").alias("src"),
    )


def invert_map(brief_map: DataFrame) -> DataFrame:
    """(path, keywords[]) with keywords in order."""
    return (
        brief_map.select(text.drop_dot_slash("path").alias("path"), "keyword")
        .groupBy("path")
        .agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    )


def own_terms(title: Column, path: Column) -> Column:
    """Title and file-name tokens that speak for a note."""
    return F.filter(
        F.concat(text.routing_tokens(title), text.routing_tokens(text.slug(path))),
        lambda t: t != "brief",
    )


def route(
    topics: DataFrame,
    brief_map: DataFrame,
    top_two: DataFrame,
    titles: DataFrame,
    floor: float = FLOOR,
    margin: float = MARGIN,
) -> DataFrame:
    """(query_id, path, method, score, margin) for every topic; abstentions stay as rows.

    ``topics``: query_id, topic. ``top_two``: keyword hits of rank 1 and 2 among routable notes.
    ``titles``: path, title.
    """
    c = candidates(topics, brief_map, top_two, titles)
    return decide(c, F.lit(floor), F.lit(margin))


def candidates(
    topics: DataFrame, brief_map: DataFrame, top_two: DataFrame, titles: DataFrame
) -> DataFrame:
    """Everything the decision needs, one row per topic; thresholds come later."""
    t = topics.select("query_id", strip(F.lower("topic")).alias("topic"))
    direct = brief_map.select(
        F.col("keyword").alias("topic"), text.drop_dot_slash("path").alias("mapped")
    ).where(F.col("mapped") != "")
    hits = top_two.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("path"))).alias("top_path"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
    )
    named = hits.join(
        titles.select(F.col("path").alias("top_path"), F.col("title").alias("top_title")),
        "top_path",
        "left",
    )
    rows = t.join(direct, "topic", "left").join(named, "query_id", "left")
    # Map words of the candidate, matched word by word: a note may own any number of keywords.
    map_words = brief_map.select(
        text.drop_dot_slash("path").alias("top_path"),
        F.explode(text.routing_tokens("keyword")).alias("word"),
    )
    by_map = (
        rows.where(F.col("top_path").isNotNull())
        .select("query_id", "top_path", F.explode(text.routing_tokens("topic")).alias("word"))
        .join(map_words, ["top_path", "word"], "left_semi")
        .select("query_id", F.lit(True).alias("by_map"))
        .distinct()
    )
    rows = rows.join(by_map, "query_id", "left")
    words = text.routing_tokens("topic")
    trigger = F.arrays_overlap(
        words, own_terms(F.col("top_title"), F.col("top_path"))
    ) | F.coalesce("by_map", F.lit(False))
    ratio = F.when(F.col("second_score") > 0, F.col("top_score") / F.col("second_score"))
    return rows.select(
        "query_id",
        "topic",
        "mapped",
        "top_path",
        "top_score",
        "second_score",
        F.round(ratio, 6).alias("margin"),
        F.coalesce(strip(F.lower("top_title")) == F.col("topic"), F.lit(False)).alias("exact"),
        F.coalesce(trigger, F.lit(False)).alias("trigger"),
    )


def decide(c: DataFrame, floor: Column, margin: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    passes = (
        F.coalesce(F.col("top_score") >= floor, F.lit(False))
        & (F.col("margin").isNull() | (F.col("margin") >= margin))
        & F.col("trigger")
    )
    method = (
        F.when(F.col("mapped").isNotNull(), "direct_map")
        .when(F.col("exact"), "exact_title")
        .when(passes, "tag_search")
        .otherwise("abstain")
    )
    scored = c.withColumn("method", method)
    m = F.col("method")
    return scored.select(
        "query_id",
        *keep,
        F.when(m == "direct_map", F.col("mapped"))
        .when(m != "abstain", F.col("top_path"))
        .alias("path"),
        "method",
        F.when(m != "direct_map", F.col("top_score")).alias("score"),
        F.when(m.isin("tag_search", "abstain"), F.col("margin")).alias("margin"),
    )


def route_topics(
    index: keyword.KeywordIndex,
    topics: DataFrame,
    brief_map: DataFrame,
    notes: DataFrame,
    as_of: str,
    floor: float = FLOOR,
    margin: float = MARGIN,
    expand: bool = True,
    params: keyword.KeywordParams = keyword.DEFAULT,
) -> DataFrame:
    """Keyword search over routable notes, then the routing decision."""
    return route(
        topics,
        brief_map,
        routable_hits(index, topics, as_of, expand, params),
        notes.select("path", "title"),
        floor,
        margin,
    )


def routable_hits(
    index: keyword.KeywordIndex,
    topics: DataFrame,
    as_of: str,
    expand: bool = True,
    params: keyword.KeywordParams = keyword.DEFAULT,
) -> DataFrame:
    q = topics.select("query_id", strip(F.lower("topic")).alias("query"))
    return keyword.search(
        index, q, as_of, limit=2, expand=expand, params=params, tags=text.ROUTABLE_TAGS
    )


def brief_lookup(routes: DataFrame, notes: DataFrame, related: DataFrame) -> DataFrame:
    """Routed topics with the note; abstentions with their related hits (query_id, path, rank).

    A route to a path without a note is not found; it keeps its path and method.
    """
    found = routes.where(F.col("path").isNotNull()).join(
        notes.select("path", "title", "content", F.lit(True).alias("there")), "path", "left"
    )
    rel = (
        related.join(notes.select("path", "title"), "path")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "path", "title"))).alias("related"))
    )
    rel_type = dict(rel.dtypes)["related"]
    missed = routes.where(F.col("path").isNull()).join(rel, "query_id", "left")
    return found.select(
        "query_id",
        F.coalesce("there", F.lit(False)).alias("found"),
        "method",
        "path",
        "title",
        "content",
        F.lit(None).cast(rel_type).alias("related"),
    ).unionByName(
        missed.select(
            "query_id",
            F.lit(False).alias("found"),
            "method",
            "path",
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("string").alias("content"),
            "related",
        )
    )
