"""Points of a series that depart from its own trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlight.functions.numbers import percent_text

LEAST_POINTS = 5
SENSITIVITY = 3.0
SERIOUS = 1.5
MAD_TO_DEVIATION = 1.4826
# Residuals this small next to the values are rounding, not spread.
ROUNDING = 1e-9


def trend(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each point with its index, and the fitted line and size of its series.

    ``series`` has ``period, value`` and one row per period, so a series is as long as the
    calendar, however large the data behind it was.  Without keys there is one series.
    """
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    value, index = F.col("value"), F.col("index").cast("double")
    return (
        series.where(value.isNotNull())
        .withColumn("value", value.cast("double"))
        .withColumn("index", F.row_number().over(whole.orderBy("period")) - 1)
        .withColumns({
            "points": F.count("*").over(whole),
            "slope": F.regr_slope(value, index).over(whole),
            "intercept": F.regr_intercept(value, index).over(whole),
        })
        .withColumn("expected", F.col("intercept") + F.col("slope") * F.col("index"))
        .withColumn("residual", value - F.col("expected"))
    )


def anomalies(
    series: DataFrame, keys: Sequence[str] = (), sensitivity: float = SENSITIVITY
) -> DataFrame:
    """Flagged points, with how far and in which direction they leave the trend."""
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    residual, middle = F.col("residual"), F.col("middle")
    score, deviation = F.col("z_score"), F.col("deviation")
    flagged = (
        trend(series, keys)
        .where(F.col("points") >= LEAST_POINTS)
        .withColumn("middle", F.median(residual).over(whole))
        .withColumns({
            "mad": F.median(F.abs(residual - middle)).over(whole) * MAD_TO_DEVIATION,
            "sd": F.stddev_samp(residual).over(whole),
            "floor": F.max(F.abs("value")).over(whole) * ROUNDING,
        })
        .withColumn("spread", F.when(F.col("mad") > F.col("floor"), F.col("mad")).otherwise(F.col("sd")))
        .where(F.col("spread") > F.col("floor"))
        .withColumn("z_score", (residual - middle) / F.col("spread"))
        .where(F.abs(score) >= sensitivity)
    )
    day = F.date_format("period", "yyyy-MM-dd")
    return (
        flagged.withColumn("deviation", residual)
        .withColumn("deviation_ratio", F.coalesce(F.try_divide(deviation, F.abs("expected")), F.lit(0.0)))
        .withColumn("direction", F.when(deviation > 0, "above").otherwise("below"))
        .withColumn("severity", F.when(F.abs(score) >= sensitivity * SERIOUS, "serious").otherwise("warning"))
        .withColumn("message", F.concat(
            day, F.lit(": "), percent_text(F.abs("deviation_ratio")), F.lit(" "), F.col("direction"),
            F.lit(" trend, "), F.format_number("value", 0), F.lit(" where "),
            F.format_number("expected", 0), F.lit(" was expected."),
        ))
        .select(
            *keys, F.col("period").cast("date").alias("period"), "value", "expected", "deviation",
            "deviation_ratio", "z_score", "direction", "severity", "message",
        )
        .orderBy(*keys, "period")
    )
