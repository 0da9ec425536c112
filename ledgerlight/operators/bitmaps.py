"""Bitmaps of key hashes, of bounded size: what a scan asks before it sends a row anywhere.

Every key that was put in passes; others pass by chance, and are dropped by what follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A bitmap has 64 bits or more per key, so it lets few others through; at most 32 MB.
LEAST_BITS, MOST_BITS = 16, 28


def bits_for(hashes: DataFrame, column: str) -> int:
    count = hashes.agg(F.approx_count_distinct(column)).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, (64 * count).bit_length()))


def _slot(hashed: str, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits) + 1


def pieces_of(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """(piece, held): 4 KB of the bitmap each, at most 8,192 rows, made in tasks."""
    slot = _slot(column, bits)
    return hashes.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("held")
    )


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def flagged(df: DataFrame, hashed: str, hashes: DataFrame, column: str, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: whether the bitmap of ``hashes`` holds its hash.

    DataFrame functions only; the bitmap is joined as pieces, broadcast as they are 32 MB at most.
    """
    bits = bits_for(hashes, column)
    piece, held = free_name(df, "_piece"), free_name(df, "_held")
    pieces = pieces_of(hashes, column, bits).select(F.col("piece").alias(piece), F.col("held").alias(held))
    place = F.bitmap_bit_position(_slot(hashed, bits))
    octet = F.conv(F.hex(F.substring(F.col(held), (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    bit = F.call_function("shiftright", octet, (place % 8).cast("int")).bitwiseAND(F.lit(1))
    return (
        df.withColumn(piece, F.bitmap_bucket_number(_slot(hashed, bits))).join(F.broadcast(pieces), piece, "left")
        .withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(piece, held)
    )
