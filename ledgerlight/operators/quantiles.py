"""Exact quantiles of many numeric columns by rank selection over range-partitioned value counts.

Spark's exact ``percentile`` keeps a column's distinct values in one task.  Here every column's values
are counted first, so repeats are folded, and one shuffle deals ``(slot, value, n)`` into ranges.  The
totals of ranges, a few rows per range, are added up in order; that tells which range holds a wanted
rank, and only those ranges are read again.  No task holds more than its range, whatever the column.
NaN has no place in the order and is left out, like NULL.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ledgerlight.session import small_frame, stored

_WANTED = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("slot", T.IntegerType()),
    T.StructField("rank", T.LongType()),
])


def quantiles_of_counts(
    counts: DataFrame, fractions: Sequence[float], ranges: int | None = None
) -> dict[int, list[float]]:
    """Continuous (interpolated) quantiles per slot of ``slot, value, n``; slots without values are missing."""
    order = ["slot", "value"]
    numbers = counts.select(F.col("slot").cast("int").alias("slot"), "value", "n").where("value IS NOT NULL AND NOT isnan(value)")
    dealt = numbers.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    held = stored(dealt.withColumn("part", F.spark_partition_id()))
    totals = defaultdict(list)
    for row in held.groupBy("part", "slot").agg(
        F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    ).collect():  # one row per range and slot in it
        totals[row["slot"]].append(row)

    wanted: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    values: dict[tuple[int, int], float] = {}
    sizes = {slot: sum(row["n"] for row in rows) for slot, rows in totals.items()}
    for slot, rows in totals.items():
        rows.sort(key=lambda row: row["part"])
        for rank in {end(f * (sizes[slot] - 1)) for f in fractions for end in (math.floor, math.ceil)}:
            before = 0
            for row in rows:
                if rank < before + row["n"]:
                    if row["low"] == row["high"]:
                        values[slot, rank] = row["low"]
                    else:
                        wanted[row["part"], slot, rank - before].append((slot, rank))
                    break
                before += row["n"]
    if wanted:
        asked = small_frame(counts.sparkSession, wanted, _WANTED)
        up_to = Window.partitionBy("part", "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        read = held.where(F.col("part").isin(sorted({part for part, _, _ in wanted}))).withColumn(
            "reach", F.sum("n").over(up_to)
        )
        found = read.join(asked, ["part", "slot"]).where("rank < reach AND rank >= reach - n")
        for row in found.select("part", "slot", "rank", "value").collect():
            for key in wanted[row["part"], row["slot"], row["rank"]]:
                values[key] = row["value"]

    out = {}
    for slot, size in sizes.items():
        out[slot] = []
        for fraction in fractions:
            place = fraction * (size - 1)
            low, high = values[slot, math.floor(place)], values[slot, math.ceil(place)]
            out[slot].append(low + (high - low) * (place % 1) if place % 1 else low)
    return out


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], fractions: Sequence[float], ranges: int | None = None
) -> dict[str, list[float | None]]:
    """Quantiles per column; NULLs for columns without values."""
    if not columns:
        return {}
    pairs = [part for i, c in enumerate(columns) for part in (F.lit(i), F.col(f"`{c}`").cast("double"))]
    counts = stored(
        df.select(F.stack(F.lit(len(columns)), *pairs).alias("slot", "value")).where("value IS NOT NULL")
        .groupBy("slot", "value").agg(F.count("*").alias("n"))
    )
    found = quantiles_of_counts(counts, fractions, ranges)
    return {c: found.get(i, [None] * len(fractions)) for i, c in enumerate(columns)}
