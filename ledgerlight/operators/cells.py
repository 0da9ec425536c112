"""Typed cells: many columns turned into rows that can be grouped in one shuffle.

``count(DISTINCT a), count(DISTINCT b), ...`` over a wide table multiplies every row by
the number of columns and drags all columns along.  Here each non-null value becomes one
narrow row ``(slot, whole, real, moment, text)``, so values keep their type (no
number-to-text conversion), equal numbers of different types meet on the same key, and one
grouping serves all columns.  Long text travels as its SHA-256, with what the profile needs
to know about it in ``whole``.  The code Spark generates does not grow with the table: what
is costly happens after the values are stacked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlight.functions.text import with_shape

LONG_TEXT_BYTES = 128
END_OF_BIGINT = 2.0**63
TYPES = {"whole": "bigint", "real": "double", "moment": "timestamp_ntz", "text": "string"}
KEY = list(TYPES)
ROWS = -1


def _key_fields(value: Column, dtype: T.DataType) -> dict[str, Column]:
    if isinstance(dtype, T.IntegralType):
        return {"whole": value.cast("bigint")}
    if isinstance(dtype, T.BooleanType):
        return {"whole": value.cast("int").cast("bigint")}
    if isinstance(dtype, T.TimestampType):
        return {"whole": F.unix_micros(value)}
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return {"moment": value.cast("timestamp_ntz")}
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        # One key per value: a bigint where it is one, else a double that gives the value back,
        # else (long decimals) its digits without closing zeros.
        number = value.cast("double")
        if not isinstance(dtype, T.DecimalType):
            is_whole = (value == F.floor(value)) & (F.abs(number) < END_OF_BIGINT)
            return {
                "whole": F.when(is_whole, number.try_cast("bigint")),
                "real": F.when(is_whole, F.lit(None)).otherwise(number),
            }
        whole = F.when(value == F.floor(value), value.try_cast("bigint"))
        gives_back = number.try_cast(dtype) == value
        fields = {"whole": whole, "real": F.when(whole.isNull() & gives_back, number)}
        if dtype.precision > 15:
            digits = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
            fields["text"] = F.when(whole.isNull() & ~F.coalesce(gives_back, F.lit(False)), digits)
        return fields
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return {"text": value}
    if isinstance(dtype, T.BinaryType):
        return {"text": F.hex(value)}
    return {"text": F.to_json(F.struct(value.alias("value")))}


def cells(
    df: DataFrame, columns: Sequence[tuple[int, str]], measures: Mapping[str, Column] | None = None,
    row_key: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Non-null values of ``columns`` as rows ``slot, whole, real, moment, text``.

    ``columns`` pairs a slot number with a column name.  ``measures`` ride, under their
    names, on one extra row per input row in slot ``ROWS``, so that totals and distinct
    counts can share one scan.  ``row_key`` is what that row is grouped by (a field of KEY and its value),
    such as a digest of the input row, or its period.
    """
    measures = measures or {}
    empty = {name: F.lit(None).cast(kind) for name, kind in TYPES.items()}
    types = df.select(*[c.alias(n) for n, c in measures.items()]).schema
    no_measures = [F.lit(None).cast(field.dataType) for field in types]
    flat: list[Column] = []
    has_text = False
    for slot, name in columns:
        value = F.col(f"`{name}`")
        fields = _key_fields(value, df.schema[name].dataType)
        has_text = has_text or "text" in fields
        present = F.when(value.isNotNull(), F.lit(slot))
        flat += [present, *{**empty, **fields}.values(), *no_measures]
    count = len(columns)
    if measures:
        own = {**empty, **(row_key or {})}
        flat += [F.lit(ROWS), *own.values(), *measures.values()]
        count += 1
    stacked = df.select(F.stack(F.lit(count), *flat).alias("slot", *KEY, *measures)).where(
        F.col("slot").isNotNull()
    )
    return _shorten(stacked) if has_text else stacked


def _shorten(stacked: DataFrame) -> DataFrame:
    """Replace long text by its digest, and keep its shape in ``whole``."""
    text = F.col("text")
    is_long = F.octet_length(text) > LONG_TEXT_BYTES
    return (
        with_shape(stacked.withColumn("long_text", F.when(is_long, text)), "long_text", "shape")
        .withColumns({
            "whole": F.when(is_long, F.col("shape").cast("bigint")).otherwise(F.col("whole")),
            "text": F.when(is_long, F.sha2(text, 256)).otherwise(text),
        })
        .drop("long_text", "shape")
    )
