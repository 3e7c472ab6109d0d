"""A training-data pipeline over ``documents``: quality rules, line dedup, near-duplicates, personal data, packing.

Each stage takes the documents that the stage before it left, as a DataFrame with the columns of ``documents``, and its decisions take effect:
rejected documents and dropped lines are gone, personal data are masked. The last stage returns the packed pieces.

Defined results: as the operators state them for nulls, empty and long texts, ties and repeated rows; an empty table gives an empty result. Columns beyond those
of ``documents`` are left behind at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import line_runs, packing, pii, quality, simhash
from quillspark.llm.common import pick, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def _with_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    now = F.col(text)
    return rows.select("doc_id", now.alias("text"), "lang", "source", F.length(F.coalesce(now, F.lit(""))).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or of which lines common on their host leave too little, go; so do these lines in the others."""
    return _with_text(quality.accepted(_documents(docs), scaled=True))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five or more documents stay in the one with the largest doc_id. A document left without any text is kept, empty."""
    return _with_text(line_runs.dedup_lines(_documents(docs), carry={"lang": "lang", "source": "source"}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.near_representatives(_documents(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Plain and disguised identifiers become marks such as <EMAIL>."""
    return _with_text(pii.find(_documents(docs), carry={"lang": "lang", "source": "source"}), "masked")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places."""
    return packing.pack(_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and token ids can't be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
