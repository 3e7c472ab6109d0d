"""Session settings the jobs rely on, and the shared work folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 20_000  # rows with a passage or a prompt that are broadcast

# UTC keeps every date cut-off independent of the machine; the rest lets AQE
# pick join strategies and split skewed partitions at run time.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime options above on an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    """The library's folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset
    (tests on one machine) is a temporary folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    return f"{(root or _local_root()).rstrip('/')}/quillspark"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Rows that are read more than once, stored in the shared work folder and read from there."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """``rows`` as the side of a join that is broadcast, if they are counted to be few; else Spark chooses."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="quillspark-")
