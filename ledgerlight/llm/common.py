"""Helpers shared by the text operators: row keys, white space, Arrow mapping, stored cut points."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.session import shared_folder

#: Words are runs of anything but these six characters.
WHITE = "\x20\x09-\x0D"
WORD = re.compile(f"[^{WHITE}]+")


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true size of
    the result, so that it broadcasts a side only when that is small.
    """
    place = shared_folder(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Sequence | None], schema: str
) -> DataFrame:
    """Apply ``function`` to each Arrow batch; it returns the columns of ``schema`` or None."""
    names = [part.split()[0].strip("`") for part in schema.split(",")]
    types = [_ARROW[part.split()[1]] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = function(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names
                )

    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<float>": pa.list_(pa.float32()), "array<boolean>": pa.list_(pa.bool_()),
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
