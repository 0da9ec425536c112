"""Column profiles: about twenty statistics per column, for all columns together.

Columns are read together, up to COLUMNS_PER_SCAN of them: every value becomes a typed cell, and one
shuffle counts equal cells.  Counts, exact distinct counts, shapes of text values and extremes follow
from these counts at once.  Only those of numbers are asked again and therefore stored, apart from all
others: for moments, exact quartiles (``quantiles``) and values outside the quartile fences.  The most
frequent values are counted for few-valued text columns alone.  The digest of a whole row is a cell
too, so repeated rows come from the scan of the other columns.  What reaches the driver is one row per
column.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import batched

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight import types as lt
from ledgerlight.functions import text as tx
from ledgerlight.functions.numbers import finite
from ledgerlight.operators.cells import KEY, ROWS, cells
from ledgerlight.operators.quantiles import quantiles_of_counts
from ledgerlight.operators.rows import duplicate_summary, row_digest
from ledgerlight.session import small_frame, stored

TOP_VALUES = 10
FEW_VALUES = 50
FENCE = 1.5
# Generated code for more columns at once grows beyond what the JVM compiles (measured); a
# columnar table is still read once in all, as each scan reads its own columns only.
COLUMNS_PER_SCAN = 20

_SHAPES = {
    "blank": tx.BLANK, "token": tx.TOKEN, "padded": tx.PADDED, "number": tx.NUMBER,
    "date": tx.DATE, "boolean": tx.BOOLEAN, "real": tx.REAL,
}


def column_types(df: DataFrame) -> dict[str, str]:
    return {field.name: lt.logical_type(field.dataType) for field in df.schema}


def _counted(df: DataFrame, columns: Sequence[str], digest: bool) -> DataFrame:
    """``slot, whole, real, moment, text, n``: how often each value occurs, and each row in slot ROWS."""
    listed = cells(
        df, list(enumerate(columns)), {"row": F.lit(1)}, {"text": row_digest(df)} if digest else None
    )
    return listed.groupBy("slot", *KEY).agg(F.count("*").alias("n"))


def _slots(names: Sequence[str], columns: Sequence[str]) -> Column:
    return F.col("slot").isin([columns.index(n) for n in names])


def _statistics(counted: DataFrame, columns: Sequence[str], kinds: dict[str, str], base_only: bool) -> dict[int, dict]:
    """Per slot: non-null values, distinct values; text values of each shape, extremes, sums."""
    found = [F.sum("n").alias("present"), F.count("*").alias("distinct")]
    if not base_only:
        texts = [c for c in columns if kinds[c] == lt.STRING]
        counted = tx.with_shape(counted.withColumn("word", F.when(_slots(texts, columns), F.col("text"))), "word", "shape")
        # A long text left as a digest carries its shape along.
        bits = F.coalesce(F.col("whole"), F.col("shape").cast("bigint"))
        for name, bit in _SHAPES.items():
            has = F.col("word").isNotNull() & (bits.bitwiseAND(F.lit(bit)) != 0)
            found.append(F.sum(F.when(has, F.col("n")).otherwise(0)).alias(name))
        value = _number(columns, kinds)
        found += [F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value * F.col("n")).alias("total")]
        for kind, pattern in ((lt.DATE, "yyyy-MM-dd"), (lt.TIMESTAMP, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")):
            own = _slots([c for c in columns if kinds[c] == kind], columns)
            moment = F.when(own, F.coalesce("moment", F.timestamp_micros("whole").cast("timestamp_ntz")))
            found += [
                F.regexp_replace(F.date_format(end(moment), pattern), r"\.000000$", "").alias(f"{label}_{kind}")
                for end, label in ((F.min, "first"), (F.max, "last"))
            ]
    return {row["slot"]: row.asDict() for row in counted.groupBy("slot").agg(*found).collect()}


def _number(columns: Sequence[str], kinds: dict[str, str]) -> Column:
    own = _slots([c for c in columns if kinds[c] in lt.NUMERIC_TYPES], columns)
    return F.when(own, F.coalesce("real", F.col("whole").cast("double"), F.col("text").try_cast("double")))


def _spread(
    counted: DataFrame, columns: Sequence[str], kinds: dict[str, str], means: dict[int, float],
    quartiles: dict[int, list[float]],
) -> dict[int, tuple[float | None, int]]:
    """Per numeric slot: the standard deviation, and values outside the quartile fences."""
    rows = []
    for slot, mean in means.items():
        q1, _, q3 = quartiles.get(slot, (None, None, None))
        fenced = q1 is not None and q3 > q1
        rows.append((slot, mean, *((q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)) if fenced else (None, None))))
    around = small_frame(counted.sparkSession, rows, lt.struct("slot int, mean double, low double, high double"))
    value, n = F.col("value"), F.col("n")
    found = (
        counted.withColumn("value", _number(columns, kinds)).where("value IS NOT NULL")
        .join(F.broadcast(around), "slot").groupBy("slot").agg(  # a row per column
            F.sum(n * (value - F.col("mean")) * (value - F.col("mean"))).alias("squares"), F.sum("n").alias("size"),
            F.sum(F.when((value < F.col("low")) | (value > F.col("high")), n).otherwise(0)).alias("outside"),
        )
    )
    return {
        row["slot"]: ((row["squares"] / (row["size"] - 1)) ** 0.5 if row["size"] > 1 else None, row["outside"])
        for row in found.collect()
    }


def _top_values(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """Most frequent values of text columns already known to have at most FEW_VALUES."""
    if not columns:
        return {}
    slots = [part for i, name in enumerate(columns) for part in (F.lit(i), F.col(f"`{name}`"))]
    counted = (
        df.select(F.stack(F.lit(len(columns)), *slots).alias("slot", "value"))
        .where(F.col("value").isNotNull())
        .groupBy("slot", "value")
        .agg(F.count("*").alias("count"))
    )
    found: dict[str, list[tuple[str, int]]] = {name: [] for name in columns}
    for row in counted.orderBy("slot", F.desc("count"), "value").collect():
        if len(found[columns[row["slot"]]]) < TOP_VALUES:
            found[columns[row["slot"]]].append((row["value"], row["count"]))
    return found


def profile(
    df: DataFrame,
    table: str = "data",
    layer: str = "raw",
    columns: Sequence[str] | None = None,
    base_only: bool = False,
) -> DataFrame:
    """One profile row per column of ``df`` (schema ``types.PROFILE``).

    ``base_only`` stops after null, distinct, constant and empty, which is all that
    classification and relationship detection read.
    """
    return survey(df, table, layer, columns, base_only, False)[0]


def survey(
    df: DataFrame,
    table: str = "data",
    layer: str = "raw",
    columns: Sequence[str] | None = None,
    base_only: bool = False,
    duplicates: bool = True,
) -> tuple[DataFrame, int]:
    """The profile, and how many rows repeat an earlier one (0 unless ``duplicates``)."""
    kinds = column_types(df)
    names = list(columns if columns is not None else df.columns)
    rows = repeated = 0
    nothing = {"present": 0, "distinct": 0}
    stats: dict[str, dict] = {}
    quartiles, outliers, top = {}, {}, {}
    numbers = [] if base_only else [n for n in names if kinds[n] in lt.NUMERIC_TYPES]
    scans = list(batched([n for n in names if n not in numbers], COLUMNS_PER_SCAN))
    if duplicates and not scans or not names:
        scans = [()]
    for number, batch in enumerate([*scans, *batched(numbers, COLUMNS_PER_SCAN)]):
        digest = duplicates and number == 0
        counted = _counted(df, batch, digest)
        if number >= len(scans):
            counted = stored(counted)
        found = _statistics(counted, batch, kinds, base_only)
        all_rows = found.pop(ROWS, nothing)
        rows = all_rows["present"]
        if digest:
            repeated = rows - all_rows["distinct"]
        stats.update({name: found.get(slot, nothing) for slot, name in enumerate(batch)})
        if base_only:
            continue
        for slot, name in enumerate(batch):
            for kind in lt.TEMPORAL_TYPES:
                if kinds[name] == kind:
                    ends = stats[name].get(f"first_{kind}"), stats[name].get(f"last_{kind}")
                    stats[name] = {**stats[name], "min": ends[0], "max": ends[1]}
        means = {
            slot: found[slot]["total"] / found[slot]["present"]
            for slot, name in enumerate(batch) if slot in found and kinds[name] in lt.NUMERIC_TYPES
        }
        if means:
            ranked = quantiles_of_counts(counted.select("slot", _number(batch, kinds).alias("value"), "n"), (0.25, 0.5, 0.75))
            spread = _spread(counted, batch, kinds, means, ranked)
            for slot, mean in means.items():
                stats[batch[slot]] |= {"mean": mean, "stddev": spread[slot][0]}
                if slot in ranked:
                    quartiles[batch[slot]] = ranked[slot]
                    outliers[batch[slot]] = spread[slot][1]
        few = [n for n in batch if kinds[n] == lt.STRING and 0 < stats[n]["distinct"] <= FEW_VALUES]
        top.update(_top_values(df, few))

    records = []
    for position, name in enumerate(names):
        found, kind = stats[name], kinds[name]
        used = found["present"] > 0
        is_number, is_time, is_text = (
            used and kind in lt.NUMERIC_TYPES,
            used and kind in lt.TEMPORAL_TYPES,
            used and kind == lt.STRING,
        )
        q1, median, q3 = quartiles.get(name, (None, None, None))
        real = is_text and found.get("real") or None
        records.append({
            "table": table, "layer": layer, "position": position, "column": name,
            "data_type": kind, "row_count": rows, "null_count": rows - found["present"],
            "distinct_count": found.get("distinct", 0),
            "min_value": found.get("min") if is_number else None,
            "max_value": found.get("max") if is_number else None,
            "mean_value": found.get("mean"), "median_value": median,
            "stddev_value": found.get("stddev"), "q1": q1, "q3": q3,
            "outlier_count": outliers.get(name),
            "min_date": found.get("min") if is_time else None,
            "max_date": found.get("max") if is_time else None,
            "blank_count": found.get("blank") if is_text else None,
            "null_token_count": found.get("token") if is_text else None,
            "whitespace_count": found.get("padded") if is_text else None,
            "numeric_like_fraction": found["number"] / real if real else None,
            "date_like_fraction": found["date"] / real if real else None,
            "boolean_like_fraction": found["boolean"] / real if real else None,
            "top_values": [{"value": v, "count": n, "fraction": n / rows} for v, n in top.get(name, [])],
        })
    return _derived(small_frame(
        df.sparkSession, [[record.get(f.name) for f in lt.PROFILE] for record in records], lt.PROFILE
    )), repeated


def base_profile(rows: DataFrame) -> DataFrame:
    """Profile rows from base counts alone: all else NULL."""
    return _derived(rows.select(*[
        F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in lt.PROFILE
    ]))


def _derived(rows: DataFrame) -> DataFrame:
    """Fractions and flags that follow from the counts, and NULL for NaN and infinities."""
    share = lambda part: F.coalesce(F.try_divide(F.col(part), F.col("row_count")), F.lit(0.0))
    numbers = ("min_value", "max_value", "mean_value", "median_value", "stddev_value", "q1", "q3")
    return rows.withColumns({
        "null_fraction": share("null_count"),
        "distinct_fraction": share("distinct_count"),
        "is_constant": (F.col("distinct_count") == 1) & (F.col("row_count") > 1),
        "is_empty": (F.col("null_count") == F.col("row_count")) & (F.col("row_count") > 0),
        **{name: finite(F.col(name)) for name in numbers},
    }).select(*lt.PROFILE.fieldNames())


def duplicate_rows(df: DataFrame) -> int:
    return duplicate_summary(df).first()["duplicate_rows"]
