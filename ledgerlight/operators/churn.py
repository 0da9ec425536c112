"""Lapse risk per customer from recency, frequency, money and tenure."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.operators.semantics import Shape
from ledgerlight.session import durable, small_frame
from ledgerlight.types import struct

# Fixed values.
LEAST_CUSTOMERS = 20
LEAST_PER_CLASS = 3
LAPSE_PERCENTILE = 0.7
SHORTEST_LAPSE = 30.0
HIGH_RISK, MEDIUM_RISK = 0.7, 0.4
PENALTY = 1.0
#: Newton steps of the fit; it settles in about half as many.
STEPS = 12
PREDICTORS = {
    "frequency": "number of purchases", "monetary": "total spend", "tenure_days": "days as a customer",
}


class NotEnoughHistory(ValueError):
    """The table cannot support a churn model."""


@dataclass(frozen=True)
class Churn:
    """A fitted model: its definition, quality and drivers, and a score per customer."""

    definition: str
    cutoff_days: float
    customers: int
    lapsed: int
    accuracy: float
    drivers: DataFrame  # feature, label, coefficient, direction
    scores: DataFrame  # one row per customer

    @property
    def lapsed_rate(self) -> float:
        return self.lapsed / self.customers

    def at_risk(self, limit: int = 10) -> DataFrame:
        return self.scores.orderBy(F.desc("risk"), "customer").limit(limit)


def rfm(df: DataFrame, shape: Shape) -> DataFrame:
    """``customer, recency_days, frequency, monetary, tenure_days, as_of``, a row per customer.

    One grouping on the customer, folded per task first and checkpointed.  "Now" is the
    newest date among the customers' last ones, so the input is read once.
    """
    if shape.customer is None or shape.time is None:
        raise ValueError("churn needs a customer column and a date column")
    amount = F.col(shape.revenue).try_cast("double") if shape.revenue else F.lit(0.0)
    rows = df.select(
        F.col(shape.customer).cast("string").alias("customer"),
        F.col(shape.time).try_cast("timestamp_ntz").alias("at"),
        F.coalesce(amount, F.lit(0.0)).alias("amount"),
    ).where(F.col("customer").isNotNull() & F.col("at").isNotNull())
    days = lambda late, early: F.extract(F.lit("DAY"), late - early).cast("bigint")
    grouped = durable(rows.groupBy("customer").agg(
        F.max("at").alias("last"), F.min("at").alias("first"),
        F.count("*").alias("frequency"), F.sum("amount").alias("monetary"),
    ))
    return (
        grouped.withColumn("as_of", grouped.agg(F.max("last")).scalar())
        .select(
            "customer", days(F.col("as_of"), F.col("last")).alias("recency_days"), "frequency",
            "monetary", days(F.col("last"), F.col("first")).alias("tenure_days"), "as_of",
        )
    )


def lapse_cutoff(features: DataFrame) -> DataFrame:
    """One row ``cutoff_days``: 70th percentile of recency, at least 30, in whole days.

    Recency is first counted per whole day, so the exact percentile keeps one entry per
    calendar day however many customers there are.
    """
    days = features.groupBy("recency_days").agg(F.count("*").alias("customers"))
    middle = F.percentile("recency_days", LAPSE_PERCENTILE, F.col("customers"))
    return days.agg(
        F.when(F.count("*") > 0, F.bround(F.greatest(F.lit(SHORTEST_LAPSE), middle), 0)).alias("cutoff_days")
    )


def _likely(inputs: list[Column], found: list[float]) -> Column:
    return 1 / (1 + F.exp(-_linear(inputs, found)))


def _linear(inputs: list[Column], found: list[float]) -> Column:
    return sum((F.lit(float(b)) * x for b, x in zip(found[1:], inputs[1:])), F.lit(float(found[0])) * inputs[0])


def newton(df: DataFrame, inputs: list[Column], label: Column, weight: Column, steps: int = STEPS) -> list[float]:
    """Coefficients of a weighted logistic regression; all but the first input's are drawn to 0.

    One aggregate per step gives loss, gradient and curvature, whatever the number of rows.  A step that
    does not lower the loss is halved.
    """
    size = len(inputs)
    ridge = np.diag([0.0, *[PENALTY] * (size - 1)])
    corners = [(i, j) for i in range(size) for j in range(i, size)]
    found, step, least = np.zeros(size), np.zeros(size), np.inf
    for _ in range(steps + 1):
        line, risk = _linear(inputs, found), _likely(inputs, found)
        row = df.agg(
            F.sum(weight * (F.log1p(F.exp(-F.abs(line))) + F.greatest(line, F.lit(0.0)) - label * line)),
            *[F.sum(weight * (risk - label) * x) for x in inputs],
            *[F.sum(weight * risk * (1 - risk) * inputs[i] * inputs[j]) for i, j in corners],
        ).first()
        loss = row[0] + found @ ridge @ found / 2
        if loss > least * (1 + 1e-12):
            step = step / 2
            found = found - step
            continue
        least = loss
        curve = np.zeros((size, size))
        for (i, j), value in zip(corners, row[1 + size:]):
            curve[i, j] = curve[j, i] = value
        step = -np.linalg.solve(curve + ridge, np.array(row[1:1 + size]) + ridge @ found)
        found = found + step
        if np.abs(step).max() < 1e-12:
            break
    return found.tolist()


def churn(df: DataFrame, shape: Shape) -> Churn:
    """Fit a class-balanced ridge logistic regression on what the label is not made of.

    The label is recency beyond the cutoff, so recency itself is no predictor.  Only one row per
    customer reaches the fit, a fixed number of Newton steps of one aggregate each; the driver sees
    totals, gradients and coefficients.
    """
    features = rfm(df, shape)
    cutoff = lapse_cutoff(features).first()["cutoff_days"]
    lapsed = (F.col("recency_days") > F.lit(cutoff)).cast("double")
    facts = features.agg(
        F.count("*").alias("customers"), F.sum(lapsed).cast("bigint").alias("lapsed"),
        F.date_format(F.max("as_of"), "yyyy-MM-dd").alias("as_of"),
        *[F.avg(p).alias(f"{p}_mean") for p in PREDICTORS],
        *[F.stddev_pop(p).alias(f"{p}_sd") for p in PREDICTORS],
    ).first()
    customers, gone = facts["customers"], facts["lapsed"] or 0
    if customers < LEAST_CUSTOMERS:
        raise NotEnoughHistory(
            f"a churn model takes at least {LEAST_CUSTOMERS} customers; there are {customers}"
        )
    if min(gone, customers - gone) < LEAST_PER_CLASS:
        raise NotEnoughHistory("customers were last active at too similar times to tell who lapsed")

    label = F.col("label")
    scaled = features.withColumn("label", lapsed).withColumns({
        f"{p}_scaled": (F.col(p) - facts[f"{p}_mean"]) / (facts[f"{p}_sd"] or 1.0) for p in PREDICTORS
    }).withColumn(
        "weight",
        F.when(label == 1, customers / (2 * gone)).otherwise(customers / (2 * (customers - gone))),
    )
    inputs = [F.lit(1.0), *(F.col(f"{p}_scaled") for p in PREDICTORS)]
    found = newton(scaled, inputs, label, F.col("weight"))

    risk = F.col("risk")
    scored = scaled.withColumn("risk", _likely(inputs, found))
    accuracy = scored.agg(F.avg(((risk > 0.5).cast("double") == label).cast("double"))).first()[0]
    scores = scored.select(
        "customer", "risk",
        F.when(risk >= HIGH_RISK, "high").when(risk >= MEDIUM_RISK, "medium").otherwise("low").alias("band"),
        "recency_days", "frequency", "monetary", "tenure_days", (label == 1).alias("lapsed"),
        F.format_string(
            "Bought %d time(s) for %s in all, the last %d day(s) ago.",
            F.col("frequency"), F.format_number("monetary", 0), F.col("recency_days"),
        ).alias("reason"),
    )
    weights = list(zip(PREDICTORS, PREDICTORS.values(), found[1:]))
    drivers = small_frame(
        df.sparkSession,
        [(f, text, c, "increases risk" if c > 0 else "reduces risk")
         for f, text, c in sorted(weights, key=lambda w: -abs(w[2]))],
        struct("feature string, label string, coefficient double, direction string"),
    )
    definition = (
        f"Lapsed: no purchase in the {cutoff:.0f} days up to {facts['as_of']}, the newest date in the "
        f"data. The limit is the 70th percentile of days since the last purchase."
    )
    return Churn(definition, cutoff, customers, gone, accuracy, drivers, scores)
