"""Whole rows as digests: repeats are counted and dropped without moving rows.

A digest is the first 120 bits of the row's SHA-256, written in 20 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlight.operators.bitmaps import flagged, free_name
from ledgerlight.session import stored

DIGEST_BYTES = 15


def _canonical(value: Column, dtype: T.DataType) -> Column:
    """Equal values alike: maps as sorted entries, whatever their order."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            _canonical(e["key"], dtype.keyType).alias("k"), _canonical(e["value"], dtype.valueType).alias("v")
        ))
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda e: _canonical(e, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[
            _canonical(value[field.name], field.dataType).alias(f"f{i}") for i, field in enumerate(dtype)
        ]))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value + F.lit(0.0).cast(dtype)  # one zero
    return value


def _text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.MapType, T.ArrayType, T.StructType)):
        return F.to_json(F.struct(_canonical(value, dtype).alias("v")), {"ignoreNullFields": "false"})
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    return _canonical(value, dtype).cast("string")


def _row_text(df: DataFrame) -> Column:
    """All columns as one text; NULL differs from every value, and no value runs into the next."""
    parts: list[Column] = []
    for field in df.schema:
        text = _text(F.col(f"`{field.name}`"), field.dataType)
        if isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType)):
            text = F.when(F.col(f"`{field.name}`").isNotNull(), text)
        parts += [F.coalesce(F.length(text).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.concat(*parts) if parts else F.lit("")


def row_digest(df: DataFrame) -> Column:
    """Equal for equal rows only."""
    return F.base64(F.substring(F.unhex(F.sha2(_row_text(df), 256)), 1, DIGEST_BYTES))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row ``rows, duplicate_rows``: all rows, and those that repeat an earlier one exactly.

    Only digests are shuffled, folded per task first.
    """
    copies = df.select(row_digest(df).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def distinct_count(df: DataFrame) -> int:
    """How many different rows there are."""
    return df.select(row_digest(df).alias("digest")).distinct().count()


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each row.

    Rows are stored with a 64-bit hash, so that what makes them is worked out once.  Hashes are counted in
    one narrow shuffle, and those that come twice are put into a bitmap.  Rows that it does not hold have
    no copy and pass as they are; of the others, which alone are shuffled, one of each digest stays, so
    rows that share a hash or a bit only are all kept.  Copies are equal, so any of them may stay.
    """
    key, seen, digest = (free_name(df, name) for name in ("_hash", "_seen", "_digest"))
    keyed = stored(df.withColumn(key, F.xxhash64(_row_text(df))))
    repeated = stored(keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    held = flagged(keyed, key, repeated, key, seen)
    once = held.where(~F.col(seen)).drop(key, seen)
    copies = held.where(F.col(seen)).drop(key, seen)
    one_each = copies.withColumn(digest, row_digest(copies)).dropDuplicates([digest]).drop(digest)
    return once.unionByName(one_each)
