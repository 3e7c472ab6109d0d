"""Versioned table folders with an atomically moved pointer, and the vector cache."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FORMAT_VERSION


def publish(tables: dict[str, DataFrame], root: str, version: int = FORMAT_VERSION) -> str:
    """Write every table into a new folder, then add one pointer row. Readers never see a half."""
    base = root.rstrip("/")
    build = uuid.uuid4().hex
    spark = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/builds/{build}/{name}")
        spark = df.sparkSession
    if spark is None:
        raise ValueError("nothing to publish")
    spark.range(1).select(
        F.lit(build).alias("build"),
        F.lit(version).alias("format_version"),
        F.current_timestamp().alias("built_at"),
    ).coalesce(1).write.mode("append").parquet(f"{base}/current")
    return build


def current_build(
    spark: SparkSession, root: str, version: int = FORMAT_VERSION
) -> tuple[str, object] | None:
    """(build, built_at) of the newest pointer row, or None when a rebuild is due."""
    from pyspark.errors import AnalysisException

    try:
        row = (
            spark.read.parquet(f"{root.rstrip('/')}/current")
            .orderBy(F.col("built_at").desc())
            .first()
        )
    except AnalysisException:
        return None
    if row is None or row["format_version"] != version:
        return None
    return row["build"], row["built_at"]


def load(
    spark: SparkSession, root: str, names: list[str], version: int = FORMAT_VERSION
) -> dict[str, DataFrame] | None:
    found = current_build(spark, root, version)
    if found is None:
        return None
    base = f"{root.rstrip('/')}/builds/{found[0]}"
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def compact_cache(cache: DataFrame, live_chunks: DataFrame) -> DataFrame:
    """Keep only vectors some live chunk still uses."""
    return cache.join(live_chunks.select("hash").distinct(), "hash", "left_semi")
