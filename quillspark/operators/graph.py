"""The wikilink graph: edges, tiered resolution, backlinks, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.markdown import link_key, wikilink_targets


def link_rows(notes: DataFrame) -> DataFrame:
    """(src, target): distinct raw targets per note."""
    return notes.select(
        F.col("path").alias("src"),
        F.explode(F.array_distinct(wikilink_targets("content"))).alias("target"),
    )


def target_keys(notes: DataFrame) -> DataFrame:
    """(key, tier, path): best note for every way a link can name one.

    Tiers: 0 path, 1 file name, 2 alias, 3 title. Within a tier the shortest, then smallest
    path wins; the min combines before the shuffle, so a title shared by a third of all notes
    arrives as one row per task.
    """
    keyed = notes.select(
        "path",
        F.explode(
            F.concat(
                F.array(
                    F.struct(link_key("path").alias("key"), F.lit(0).alias("tier")),
                    F.struct(F.lower(text.slug("path")).alias("key"), F.lit(1).alias("tier")),
                    F.struct(link_key("title").alias("key"), F.lit(3).alias("tier")),
                ),
                F.transform(
                    F.coalesce(F.col("fm.aliases"), F.array().cast("array<string>")),
                    lambda a: F.struct(link_key(a).alias("key"), F.lit(2).alias("tier")),
                ),
            )
        ).alias("k"),
    ).select("path", "k.key", "k.tier")
    return (
        keyed.where(F.col("key") != "")
        .groupBy("key", "tier")
        .agg(F.min(F.struct(F.length("path").alias("n"), "path"))["path"].alias("path"))
    )


def resolve_links(notes: DataFrame) -> DataFrame:
    """(src, target, dst): every distinct link; ``dst`` null when nothing matches."""
    distinct_targets = link_rows(notes).select("target").distinct()
    full = link_key("target")
    wanted = distinct_targets.select(
        "target",
        F.explode(
            F.array(
                F.struct(full.alias("key"), F.lit(0).alias("tier")),
                F.struct(text.basename(full).alias("key"), F.lit(1).alias("tier")),
                F.struct(full.alias("key"), F.lit(2).alias("tier")),
                F.struct(full.alias("key"), F.lit(3).alias("tier")),
            )
        ).alias("k"),
    ).select("target", "k.key", "k.tier")
    resolved = (
        wanted.join(target_keys(notes), ["key", "tier"])
        .groupBy("target")
        .agg(F.min(F.struct("tier", "path"))["path"].alias("dst"))
    )
    return link_rows(notes).join(resolved, "target", "left").select("src", "target", "dst")


def edges(links: DataFrame) -> DataFrame:
    """(src, dst) without self-links."""
    return (
        links.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))
        .select("src", "dst")
        .distinct()
    )


def forward_counts(links: DataFrame) -> DataFrame:
    return edges(links).groupBy("src").agg(F.count(F.lit(1)).alias("n_targets"))


def backlinks(links: DataFrame) -> DataFrame:
    return edges(links).groupBy("dst").agg(F.count(F.lit(1)).alias("n_sources"))


def dangling(links: DataFrame) -> DataFrame:
    return links.where(F.col("dst").isNull()).select("src", "target").distinct()


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Knowledge notes nothing links to, or that no map links to."""
    maps = notes.where(text.is_moc("path", "tags")).select(
        F.col("path").alias("src"), F.lit(1).alias("moc")
    )
    incoming = (
        edges(links)
        .join(maps, "src", "left")
        .groupBy("dst")
        .agg(F.count(F.lit(1)).alias("n"), F.max("moc").alias("moc"))
    )
    return (
        notes.where(text.is_knowledge("tags"))
        .select("path", "title")
        .join(incoming.withColumnRenamed("dst", "path"), "path", "left")
        .where(F.col("moc").isNull())
        .select(
            "path",
            "title",
            F.when(F.col("n").isNull(), "isolated").otherwise("no-moc").alias("reason"),
            F.coalesce("n", F.lit(0)).alias("backlink_count"),
        )
    )


def unlinked_maps(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Maps the home note does not link to."""
    from_home = edges(links).where(F.col("src") == text.HOME_PATH).select(F.col("dst").alias("path"))
    return (
        notes.where(
            text.is_moc("path", "tags")
            & (F.col("path") != text.HOME_PATH)
            & ~F.startswith("path", F.lit("Knowledge/"))
        )
        .select("path", "title")
        .join(from_home, "path", "left_anti")
    )
