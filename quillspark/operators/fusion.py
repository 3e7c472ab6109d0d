"""Reciprocal-rank fusion with path weights and pins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

RRF_K = 60
SESSION_WEIGHT = 0.7
SCORE_DIGITS = 9


def path_weight(path: str = "path") -> Column:
    """Raw session journals count less than curated notes."""
    return F.when(text.is_raw_session(path), SESSION_WEIGHT).otherwise(1.0)


def fuse(
    lists: list[DataFrame],
    k: int = RRF_K,
    weight: Column | None = None,
    pins: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(query_id, path, score, rank) from ranked lists (query_id, path, rank).

    Score is the sum of 1 / (k + rank); ties go to the smaller path. ``pins`` (query_id, path,
    pin_ord) come first in their order, but only where some list retrieved them.
    """
    union = reduce(DataFrame.unionByName, [d.select("query_id", "path", "rank") for d in lists])
    score = F.sum(1.0 / (k + F.col("rank")))
    fused = union.groupBy("query_id", "path").agg(score.alias("s"))
    fused = fused.select(
        "query_id",
        "path",
        F.round(F.col("s") * (weight if weight is not None else F.lit(1.0)), SCORE_DIGITS).alias(
            "score"
        ),
    )
    order = [F.col("score").desc(), F.col("path")]
    if pins is not None:
        fused = fused.join(pins.select("query_id", "path", "pin_ord"), ["query_id", "path"], "left")
        order = [F.col("pin_ord").asc_nulls_last(), *order]
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    if limit is not None:
        out = out.where(F.col("rank") <= limit)
    return out.select("query_id", "path", "score", "rank")
