"""Helpers shared by the operators: exact column choice, bounded Arrow batches, written tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import work_dir

#: The six characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact spelling, renamed: ``pick(df, doc_id="doc_id", body="text")``.

    Other columns may have any names, also ones that differ only in case from a wanted one or
    from a name an operator uses inside.
    """
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [name for name in columns.values() if name not in at]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return numbered.select(*(F.col(f"c{at[name]}").alias(new) for new, name in columns.items()))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Keep Arrow batches small, as a row may be a text of many megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, purpose: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write to the shared folder and read again: later steps start here, also after a lost executor."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> Iterator[str]:
    """Values of a string column, one at a time, null as the empty text."""
    for value in column:
        yield value.as_py() or ""


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The same as UTF-8 bytes."""
    yield from ((value or b"") for value in column.cast(pa.binary()).to_pylist())
