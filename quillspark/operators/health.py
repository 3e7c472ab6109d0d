"""Corpus health checks, one row per corpus or note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

# Limits of the checks.
MAX_RUN_AGE_DAYS = 10
BRIEF_WARN_KB, BRIEF_FAIL_KB = 32, 64


def digest_backlog(groups: DataFrame) -> DataFrame:
    """Digest groups that still wait for their note."""
    return groups.where(~F.col("exists"))


def newer_than_index(notes: DataFrame, built_at: str) -> DataFrame:
    """How many notes changed since the vector index was built."""
    group = ["vault_id"] if "vault_id" in notes.columns else []
    return notes.groupBy(*group).agg(
        F.count_if(F.col("modified_at") > dates.clock(built_at)).alias("n_newer")
    )


def oversized_briefs(
    notes: DataFrame, warn_kb: float = BRIEF_WARN_KB, fail_kb: float = BRIEF_FAIL_KB
) -> DataFrame:
    """(path, kb, level) of briefs, by file name, that crowd out other notes."""
    kb = F.col("size") / 1024
    return notes.where(F.startswith(text.basename("path"), F.lit("brief-")) & (kb > warn_kb)).select(
        "path", F.round(kb).cast("long").alias("kb"), F.when(kb > fail_kb, "fail").otherwise("warn").alias("level")
    )


def run_age(
    vaults: DataFrame, notes: DataFrame, as_of: str, max_days: int = MAX_RUN_AGE_DAYS
) -> DataFrame:
    """(vault_id, days, level): a corpus never curated warns, one that stopped fails.

    ``vaults``: vault_id. ``notes``: vault_id, path, modified_at.
    """
    runs = (
        notes.where(F.startswith("path", F.lit("sessions/digests/_runs/")))
        .groupBy("vault_id")
        .agg(F.max("modified_at").alias("newest"))
    )
    days = dates.age_days("newest", dates.clock(as_of))
    return vaults.join(runs, "vault_id", "left").select(
        "vault_id",
        days.alias("days"),
        F.when(F.col("newest").isNull(), "warn")
        .when(days <= max_days, "pass")
        .otherwise("fail")
        .alias("level"),
    )
