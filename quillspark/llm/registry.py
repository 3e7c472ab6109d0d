"""The registered query of each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bestfit, bpe, chat, importance, licenses, line_runs, merkle, packing, pii, quality, repair, simhash, warc
from quillspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_merkle": _over("documents", merkle.query),
    "op2_packing": _over("documents", packing.query),
    "op3_quality": _over("documents", quality.query),
    "op4_line_runs": _over("documents", line_runs.query),
    "op5_warc": _over("pages", warc.query),
    "op6_simhash": _over("documents", simhash.query),
    "op7_pii": _over("documents", pii.query),
    "op8_bpe": _over("documents", bpe.query),
    "op9_license_scan": _over("documents", licenses.query),
    "op10_chat": _over("conversations", chat.collapse_and_render),
    "op11_importance": lambda spark, sf_dir: importance.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_bestfit": _over("documents", bestfit.query),
    "op13_repair": _over("conversations", repair.query),
}

ORACLES: dict[str, str] = {
    "op3_quality": quality.ORACLE,
    "op4_line_runs": line_runs.ORACLE,
    "op5_warc": warc.ORACLE,
    "op9_license_scan": licenses.ORACLE,
    "op10_chat": chat.ORACLE,
    "op11_importance": importance.ORACLE,
}
