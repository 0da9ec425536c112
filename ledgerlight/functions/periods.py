"""Calendar expressions: truncating to a grain and stepping a series forward."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Supported grains and the matching format of ``trunc``.
GRAINS = {"day": None, "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def truncate(when: Column, grain: str) -> Column:
    """Start of the period holding ``when``.

    Works on dates, which every grain is at least as coarse as, so the result does
    not depend on the session time zone.
    """
    if grain not in GRAINS:
        raise ValueError(f"Unsupported time grain: {grain}")
    day = when.cast("date")
    start = day if GRAINS[grain] is None else F.trunc(day, GRAINS[grain])
    return start.cast("timestamp_ntz")


def months_per_step(step_seconds: Column) -> Column:
    """Whole calendar months a typical gap stands for, or NULL for a fixed-length step."""
    days = step_seconds / 86400
    return (
        F.when(days.between(27, 32), F.lit(1))
        .when(days.between(88, 95), F.lit(3))
        .when(days.between(360, 370), F.lit(12))
    )


def step_ahead(last: Column, step_seconds: Column, steps: Column) -> Column:
    """Date ``steps`` periods after ``last``; calendar-aware for month-like spacing."""
    calendar = F.add_months(last.cast("date"), (months_per_step(step_seconds) * steps).cast("int"))
    seconds = step_seconds * steps
    fixed = last.cast("timestamp_ntz") + F.make_dt_interval(
        secs=seconds.cast("decimal(18,6)")
    )
    return F.coalesce(calendar, fixed.cast("date"))
