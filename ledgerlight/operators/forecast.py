"""Forecasts with intervals, for one series or one per key, refusing thin ones.

Series come aggregated to one row per period, so their length is the calendar's and not
the data's.  Short series get a linear trend, computed wholly with built-in aggregates;
long ones get seasonal smoothing, the one place where a Python function runs in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.functions.numbers import normal_quantile, student_quantile
from ledgerlight.functions.periods import step_ahead
from ledgerlight.operators import smoothing
from ledgerlight.operators.anomalies import trend

# Tasks get the smoothing code with the function, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(smoothing)

# Fixed values.
LEAST_POINTS = 4
LEAST_SEASONAL_POINTS = 24
LONGEST_HORIZON = 24
CONFIDENCE = 0.80
SEASON = 12
VOLATILE = 0.5
DEFAULT_STEP_SECONDS = 30 * 86400.0

_FITTED = "step int, predicted double, margin double, residual_sd double"
_FACTS = "history_points bigint, mean double, last_period timestamp_ntz, step_seconds double"


def _facts() -> list[Column]:
    """Aggregates every method needs about a series."""
    return [
        F.count("*").alias("history_points"),
        F.avg("value").alias("mean"),
        F.max("period").cast("timestamp_ntz").alias("last_period"),
        F.coalesce(F.median("gap"), F.lit(DEFAULT_STEP_SECONDS)).alias("step_seconds"),
        F.stddev_samp("residual").alias("residual_sd"),
    ]


def _linear(
    points: DataFrame, keys: Sequence[str], lengths: range, horizon: int, confidence: float
) -> DataFrame:
    """Least squares on the index; the interval is one for a new observation."""
    n, index = F.col("history_points"), F.col("index").cast("double")
    critical = F.element_at(
        F.create_map(*[
            F.lit(x)
            for length in lengths
            for x in (length, student_quantile(0.5 + confidence / 2, length - 2))
        ]),
        n.cast("int"),
    )
    ahead = n - 1 + F.col("step") - F.col("centre")
    error = F.sqrt(F.col("squares") / (n - 2))
    return (
        points.groupBy(*keys)
        .agg(
            *_facts(), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
            F.sum(F.col("residual") * F.col("residual")).alias("squares"),
            F.avg(index).alias("centre"), F.regr_sxx("value", index).alias("sxx"),
        )
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("predicted", F.col("intercept") + F.col("slope") * (n - 1 + F.col("step")))
        .withColumn("margin", critical * error * F.sqrt(1 + 1 / n + ahead * ahead / F.col("sxx")))
        .select(*keys, *_names(_FACTS), *_names(_FITTED), F.lit("linear_trend").alias("method"))
    )


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def _seasonal(
    points: DataFrame, keys: Sequence[str], horizon: int, confidence: float, season: int
) -> DataFrame:
    """Seasonal smoothing; the interval grows with the square root of the distance.

    Only the values reach Python, so keys may have any name and type.
    """
    spread = normal_quantile(0.5 + confidence / 2)
    facts = _names(_FACTS)
    series = points.groupBy(*keys).agg(
        *_facts()[:-1],
        F.transform(F.array_sort(F.collect_list(F.struct("index", "value"))), lambda p: p["value"]).alias("values"),
    )

    smooth = smoothing.holt_winters

    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for values in batch:
                ahead, errors = smooth(np.asarray(values, dtype=float), season, horizon)
                deviation = float(errors.std(ddof=1))
                rows.append([
                    (step, float(ahead[step - 1]), spread * deviation * step**0.5, deviation)
                    for step in range(1, horizon + 1)
                ])
            yield pd.Series(rows)

    fitting = F.pandas_udf(fit, f"array<struct<{_FITTED.replace(' ', ':').replace(',:', ', ')}>>")
    return (
        series.withColumn("fitted", fitting("values"))
        .select(*[F.col(f"`{k}`") for k in keys], *facts, F.inline("fitted"))
        .withColumn("method", F.lit("holt_winters"))
    )


def forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = 3,
    confidence: float = CONFIDENCE,
    allow_negative: bool = False,
    season_length: int = SEASON,
) -> DataFrame:
    """Future periods with value and interval; a series too short gives one refusal row."""
    horizon = max(1, horizon)
    if horizon > LONGEST_HORIZON:
        raise ValueError(f"a forecast reaches {LONGEST_HORIZON} periods at most, not {horizon}")
    if not keys:
        # A constant key, so that a method without any series to fit gives no row.
        one = series.withColumn("__series", F.lit(0))
        return forecast(
            one, ["__series"], horizon, confidence, allow_negative, season_length
        ).drop("__series")
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    moment = F.col("period").cast("timestamp_ntz")
    gap = (moment - F.lag(moment).over(whole.orderBy("period"))).cast("interval second").cast("decimal(20,6)")
    points = trend(series, keys).withColumn("gap", gap.cast("double"))
    # Two full seasons are needed to tell season from trend.
    lengths = range(LEAST_POINTS, max(LEAST_SEASONAL_POINTS, 2 * season_length))
    linear = _linear(
        points.where(F.col("points").between(lengths.start, lengths.stop - 1)), keys, lengths, horizon, confidence
    )
    seasonal = _seasonal(points.where(F.col("points") >= lengths.stop), keys, horizon, confidence, season_length)
    return _finish(linear.unionByName(seasonal), keys, confidence, allow_negative).unionByName(
        _refusals(series, keys, confidence), allowMissingColumns=True
    ).orderBy(*keys, "period")


def _finish(fitted: DataFrame, keys: list[str], confidence: float, allow_negative: bool) -> DataFrame:
    clip = (lambda c: c) if allow_negative else (lambda c: F.greatest(c, F.lit(0.0)))
    predicted, margin = F.col("predicted"), F.col("margin")
    noise = F.when(F.col("mean") != 0, F.col("residual_sd") / F.abs("mean"))
    why = F.concat(
        F.when(F.col("method") == "holt_winters", F.lit("Trend and season smoothed over "))
        .otherwise(F.lit("Straight trend through ")),
        F.col("history_points").cast("string"), F.lit(" periods"),
        F.when(F.col("method") == "holt_winters", F.lit("."))
        .otherwise(F.lit("; too few to tell seasons apart.")),
        F.when(noise > VOLATILE, F.lit(" Volatile history: read the range, not the middle.")).otherwise(F.lit("")),
    )
    return fitted.select(
        *keys, step_ahead(F.col("last_period"), F.col("step_seconds"), F.col("step")).alias("period"),
        clip(predicted).alias("value"), clip(predicted - margin).alias("lower"),
        clip(predicted + margin).alias("upper"), "method", F.lit(confidence).alias("confidence"),
        "history_points", noise.alias("noise_ratio"), why.alias("rationale"),
    )


def _refusals(series: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    known = series.groupBy(*keys).agg(F.count("value").alias("history_points"))
    return known.where(F.col("history_points") < LEAST_POINTS).select(
        *keys, F.lit(None).cast("date").alias("period"), F.lit("refused").alias("method"),
        F.lit(confidence).alias("confidence"), "history_points",
        F.concat(F.lit(f"A forecast takes at least {LEAST_POINTS} periods; there are "),
                 F.col("history_points").cast("string"), F.lit(".")).alias("rationale"),
    )
