"""Cleaning: plan per column from the profile, then apply everything in one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight import types as lt
from ledgerlight.functions import text as tx
from ledgerlight.functions.numbers import count_text
from ledgerlight.operators.rows import distinct_count, distinct_rows
from ledgerlight.session import small_frame

# Share of values that must support a conversion, and the action names.
CONVERT_FROM = 0.95
TRIM, NULLIFY, NUMBER, DATE, BOOLEAN, DEDUPLICATE = (
    "trim_whitespace", "normalize_null_tokens", "cast_to_number", "cast_to_date",
    "cast_to_boolean", "deduplicate_rows",
)


def plan_cleaning(profile: DataFrame, duplicate_rows: int, deduplicate: bool = True) -> DataFrame:
    """Planned actions: one row per column, and one without column if rows are deduplicated.

    Columns: ``column, actions, resulting_type, reason``.
    """
    is_text = F.col("data_type") == lt.STRING
    padded = F.col("whitespace_count") > 0
    tokens = F.col("null_token_count") > 0
    converts = [
        (F.col("boolean_like_fraction") >= CONVERT_FROM, BOOLEAN, lt.BOOLEAN, "true/false words became booleans"),
        (F.col("date_like_fraction") >= CONVERT_FROM, DATE, lt.DATE, "text dates became dates"),
        (F.col("numeric_like_fraction") >= CONVERT_FROM, NUMBER, lt.DECIMAL,
         "numbers were read after dropping currency signs and separators"),
    ]
    action = kind = reason = None
    for holds, name, result, why in converts:
        action = F.when(holds, F.lit(name)) if action is None else action.when(holds, F.lit(name))
        kind = F.when(holds, F.lit(result)) if kind is None else kind.when(holds, F.lit(result))
        reason = F.when(holds, F.lit(why)) if reason is None else reason.when(holds, F.lit(why))

    sentence = F.concat_ws(
        "; ",
        F.when(padded, F.concat_ws(" ", count_text(F.col("whitespace_count"), "value"), F.lit("lost padding"))),
        F.when(tokens, F.concat_ws(" ", count_text(F.col("null_token_count"), "placeholder"), F.lit("became NULL"))),
        reason,
    )
    plan = profile.select(
        "column",
        F.when(
            is_text,
            F.array_compact(F.array(F.when(padded | tokens, TRIM), F.when(tokens, NULLIFY), action)),
        ).otherwise(F.array().cast("array<string>")).alias("actions"),
        F.when(is_text, F.coalesce(kind, F.col("data_type"))).otherwise(F.col("data_type")).alias("resulting_type"),
        F.when(
            is_text & (sentence != ""),
            F.concat(F.upper(F.substring(sentence, 1, 1)), F.substr(sentence, F.lit(2)), F.lit(".")),
        ).otherwise("").alias("reason"),
    )
    if not (deduplicate and duplicate_rows > 0):
        return plan
    extra = small_frame(
        plan.sparkSession, [(None, [DEDUPLICATE], None, "Rows that repeat another row exactly were dropped.")], plan.schema
    )
    return plan.unionByName(extra)


def audit(plan: DataFrame) -> DataFrame:
    """The entries of a plan that change something."""
    return plan.where(F.size("actions") > 0)


def is_noop(plan: DataFrame) -> bool:
    return audit(plan).isEmpty()


def cleaned(value: Column, actions: Sequence[str]) -> Column:
    """A trimmed column's other actions in their fixed order: placeholders, one conversion."""
    if NULLIFY in actions:
        value = F.when(~tx.is_null_token(value), value)
    for action, convert in ((BOOLEAN, tx.to_boolean), (DATE, tx.to_date), (NUMBER, tx.to_number)):
        if action in actions:
            return convert(value)
    return value


def _projected(df: DataFrame, planned: dict) -> DataFrame:
    # Trimmed values are named first, as each is asked for several times afterwards.
    trimmed = df.select(*[
        (tx.trim_spaces(F.col(c)) if TRIM in planned.get(c, ()) else F.col(c)).alias(c) for c in df.columns
    ])
    return trimmed.select(*[cleaned(F.col(c), planned.get(c, ())).alias(c) for c in df.columns])


def clean(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Cleaned frame: one projection, then one of each row if the plan asks for it."""
    planned = {row["column"]: row["actions"] for row in plan.collect()}
    projected = _projected(df, planned)
    return distinct_rows(projected) if DEDUPLICATE in planned.get(None, ()) else projected


def clean_row_count(df: DataFrame, plan: DataFrame) -> int:
    """How many rows ``clean`` leaves, from the digests of cleaned rows."""
    planned = {row["column"]: row["actions"] for row in plan.collect()}
    projected = _projected(df, planned)
    return distinct_count(projected) if DEDUPLICATE in planned.get(None, ()) else projected.count()
