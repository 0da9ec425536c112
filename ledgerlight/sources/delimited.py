"""Delimited files: types from all rows in one distributed aggregate, then one distributed read.

A column gets the narrowest type that every cell of it fits, and stays text if there is none, so
no cell is lost.  Cells are read as text and cast with the shape-checked casts.  Days may come first
(``31/12/2025``), if they do in every cell of a column.  Files are split, whether or not quoted
cells hold line breaks (``records``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlight import types as lt
from ledgerlight.functions import text as tx
from ledgerlight.session import small_frame
from ledgerlight.sources import records
from ledgerlight.sources.naming import header_names, separator_for

SAMPLE_VALUES = 5
LONGEST_HEADER = 300

_INTEGER = r"^[+-]?[0-9]{1,19}$"
_MOMENT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$"
_DAY = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"
_DAY_FIRST = r"^([0-9]{1,2})([-/])([0-9]{1,2})\2([0-9]{4})"
_TIME = r"[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$"
#: Ways to read a cell, each with the logical type it gives.
_READINGS = {
    lt.BOOLEAN: lt.BOOLEAN, lt.INTEGER: lt.INTEGER, lt.DECIMAL: lt.DECIMAL, lt.DATE: lt.DATE,
    "day first": lt.DATE, lt.TIMESTAMP: lt.TIMESTAMP, "day first, time": lt.TIMESTAMP, lt.STRING: lt.STRING,
}
_SQL_TYPES = {
    lt.BOOLEAN: "boolean", lt.INTEGER: "bigint", lt.DECIMAL: "double", lt.DATE: "date",
    lt.TIMESTAMP: "timestamp_ntz", lt.STRING: "string",
}


class UnreadableFile(ValueError):
    """A file without columns, or of a kind that is not delimited text."""


def _cast(text: Column, logical: str) -> Column:
    """Strict reading of a cell: nothing is stripped or repaired at this stage."""
    if logical.startswith("day first"):
        end, kind = (_TIME, "timestamp_ntz") if logical.endswith("time") else ("$", "date")
        turned = F.regexp_replace(text, _DAY_FIRST, "$4-$3-$1")
        return F.when(text.rlike(_DAY_FIRST + end), turned.try_cast(kind))
    if logical == lt.BOOLEAN:
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if logical == lt.INTEGER:
        return F.when(text.rlike(_INTEGER), text.try_cast("bigint"))
    if logical == lt.DECIMAL:
        return F.when(text.rlike(tx.NUMBER_SHAPE), text.try_cast("double"))
    if logical == lt.DATE:
        return F.when(text.rlike(_DAY), tx.to_date(text))
    if logical == lt.TIMESTAMP:
        return F.when(text.rlike(_MOMENT), text.try_cast("timestamp_ntz"))
    return text


_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": ""}


def _read_text(spark: SparkSession, path: str, one_task: bool) -> tuple[list[str], DataFrame]:
    """Original headers, and all cells as text under positional names."""
    separator = separator_for(path)
    options = {**_OPTIONS, "sep": separator}
    # reads the first record only, whose cells may hold line breaks too
    first = spark.read.options(**options, multiLine=True, header=False).csv(path).head(1)
    if not first:
        raise UnreadableFile(f"{path} contains no columns")
    headers = ["" if h is None else h for h in first[0]]
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    broken = None if one_task else records.broken_records(spark, path, separator)
    if broken is not None:
        return headers, broken.select(F.from_csv("value", F.lit(schema), options).alias("cells")).select("cells.*")
    return headers, spark.read.options(**options, multiLine=one_task, header=True).schema(schema).csv(path)


def _infer(sample: DataFrame) -> list[str]:
    """Narrowest reading that every sampled value of a column fits; text if there is none."""
    order = [reading for reading in _READINGS if reading != lt.STRING]
    row = sample.agg(*[
        F.struct(
            F.count(c).alias("present"), *[F.count(_cast(F.col(c), kind)).alias(kind) for kind in order]
        )
        for c in sample.columns
    ]).first()
    return [
        next((kind for kind in order if seen["present"] and seen[kind] == seen["present"]), lt.STRING)
        for seen in row
    ]


def _read(spark: SparkSession, path: str, one_task: bool, rows: int | None) -> DataFrame:
    headers, cells = _read_text(spark, path, one_task)
    if rows is not None:
        cells = cells.limit(rows)
    readings = _infer(cells)
    return cells.select(*[
        _cast(F.col(c), how).cast(_SQL_TYPES[_READINGS[how]]).alias(name, metadata={"header": header[:LONGEST_HEADER]})
        for c, how, name, header in zip(cells.columns, readings, header_names(headers), headers)
    ])


def read_delimited(spark: SparkSession, path: str, one_task: bool = False) -> DataFrame:
    """The whole file with normalised names and inferred types.

    ``one_task`` leaves the splitting into records to one task per file.
    """
    return _read(spark, path, one_task, None)


def read_sample(spark: SparkSession, path: str, rows: int, one_task: bool = False) -> DataFrame:
    """The first ``rows`` rows, typed from themselves."""
    return _read(spark, path, one_task, rows)


def detect_schema(df: DataFrame) -> DataFrame:
    """One row per column (schema ``types.COLUMNS``): names, types, nullability, samples."""
    if not df.columns:
        raise UnreadableFile("no columns")
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    originals = [field.metadata.get("header", field.name) for field in df.schema]
    rows = [
        (
            position, original[:LONGEST_HEADER], name, lt.logical_type(field.dataType),
            field.dataType.simpleString(), nulls[position] > 0, samples,
        )
        for position, (field, original, name, samples) in enumerate(
            zip(df.schema, originals, header_names(originals), _samples(df))
        )
    ]
    return small_frame(df.sparkSession, rows, lt.COLUMNS)


def _samples(df: DataFrame) -> list[list[str]]:
    """First non-null values per column; sparse columns share one look beyond the head."""
    texts = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
    head = texts.head(100)
    found: Sequence[list[str]] = [
        [row[i] for row in head if row[i] is not None][:SAMPLE_VALUES] for i in range(len(df.columns))
    ]
    sparse = [i for i, values in enumerate(found) if len(values) < SAMPLE_VALUES] if len(head) == 100 else []
    if sparse:
        # Spark limits each task to its first rows of a slot before they are shuffled
        order = Window.partitionBy("slot").orderBy("place")
        firsts = (
            texts.withColumn("place", F.monotonically_increasing_id())
            .select("place", F.posexplode(F.array(*[f"c{i}" for i in sparse])).alias("slot", "value"))
            .where(F.col("value").isNotNull())
            .withColumn("number", F.row_number().over(order)).where(F.col("number") <= SAMPLE_VALUES)
        )
        for row in firsts.orderBy("slot", "number").collect():
            i = sparse[row["slot"]]
            found[i] = [*(found[i] if row["number"] > 1 else []), row["value"]]
    return list(found)
