"""Session settings and durable cut points.

The library never needs a session of its own: every operator takes the caller's
DataFrames.  ``local_session`` is for tests, the bench and notebooks.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerlight")
    options = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **settings,
    }
    for name, value in options.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def small_frame(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation, which the optimizer evaluates without a job."""
    records = [dict(zip(schema.fieldNames(), row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)


class NoSharedFolder(RuntimeError):
    """The session names no folder that all executors can reach."""


def _base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where all of Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="ledgerlight-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new folder every executor can reach, under ``spark.checkpoint.dir``."""
    return f"{_base(spark).rstrip('/')}/ledgerlight-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that several jobs will read, so a lost executor costs one read.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a frame that several jobs will read as Parquet into the shared folder, and read it back.

    As ``durable``, but columns and partitions that a job does not need are not read.
    """
    place = shared_folder(df.sparkSession)
    df.write.parquet(place, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(place)
