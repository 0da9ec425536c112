"""Business metrics, time series, breakdowns and growth for a classified table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerlight.functions.numbers import finite, ratio
from ledgerlight.functions.periods import truncate
from ledgerlight.operators.cells import KEY, ROWS, cells
from ledgerlight.operators.semantics import Shape


# Order in which metrics are shown.
DISPLAY_ORDER = (
    "total_revenue", "gross_margin", "order_count", "average_order_value", "unique_customers",
    "repeat_customer_rate", "revenue_per_customer", "total_units", "average_transaction", "row_count",
)


@dataclass(frozen=True)
class Metric:
    """A metric, the columns it needs, its value over ``_totals`` and SQL a user can check."""

    key: str
    label: str
    format: str
    needs: tuple[str, ...]
    reads: tuple[str, ...]
    value: Column
    sql: str
    description: str


def _metrics() -> list[Metric]:
    revenue, cost = F.col("revenue_sum"), F.col("cost_sum")
    customers, orders = F.col("customers"), F.col("orders")
    metric = lambda key, label, format, needs, value, sql, description, reads=None: Metric(
        key, label, format, tuple(needs.split()), tuple((reads or needs).split()), value, sql, description
    )
    return [
        metric("row_count", "Records", "number", "", F.col("rows"), "count(*)", "All rows."),
        metric("total_revenue", "Total revenue", "currency", "revenue", revenue,
               "sum({revenue})", "{revenue} added up."),
        metric("average_transaction", "Average transaction", "currency", "revenue",
               ratio(revenue, F.col("revenue_count")), "avg({revenue})", "Mean {revenue} per row."),
        metric("total_units", "Total units", "number", "quantity", F.col("quantity_sum"),
               "sum({quantity})", "{quantity} added up."),
        metric("unique_customers", "Unique customers", "number", "customer", customers,
               "count(DISTINCT {customer})", "Different values of {customer}."),
        metric("order_count", "Orders", "number", "order", orders,
               "count(DISTINCT {order})", "Different values of {order}."),
        metric("average_order_value", "Average order value", "currency", "revenue order",
               ratio(revenue, orders), "try_divide(sum({revenue}), count(DISTINCT {order}))",
               "{revenue} per different {order}."),
        metric("revenue_per_customer", "Revenue per customer", "currency", "revenue customer",
               ratio(revenue, customers), "try_divide(sum({revenue}), count(DISTINCT {customer}))",
               "{revenue} per different {customer}."),
        metric("repeat_customer_rate", "Repeat customer rate", "percent", "revenue customer",
               ratio(F.col("repeat_customers"), customers), "",
               "Share of {customer} values on more than one row.", reads="customer"),
        metric("gross_margin", "Gross margin", "percent", "revenue cost",
               ratio(revenue.cast("double") - cost.cast("double"), revenue),
               "try_divide(sum({revenue}) - sum({cost}), sum({revenue}))",
               "({revenue} - {cost}) as a share of {revenue}."),
    ]


_REPEAT_SQL = (
    "SELECT avg(CAST(n > 1 AS DOUBLE)) FROM (SELECT count(*) AS n FROM {table} "
    "WHERE {customer} IS NOT NULL GROUP BY {customer})"
)


def _addable(df: DataFrame, name: str) -> Column:
    """The column in a type whose sum neither overflows nor, for whole numbers, rounds."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return F.col(name).cast("decimal(20,0)")
    return F.col(name) if isinstance(dtype, T.DecimalType) else F.col(name).cast("double")


def _totals(df: DataFrame, shape: Shape, grain: str) -> DataFrame:
    """One row with everything the metrics need, from one scan and one shuffle.

    Customer and order keys travel as typed cells next to one row of measures, which is grouped by its
    period; all are folded per task first, so a hot customer or order costs one row per task.  Totals
    are sums over periods.  ``newest`` has the last two periods that have rows, the later one first.
    """
    measures = {
        name: _addable(df, column)
        for name, column in (("revenue", shape.revenue), ("quantity", shape.quantity), ("cost", shape.cost))
        if column
    }
    keys = [(slot, c) for slot, c in enumerate((shape.customer, shape.order)) if c]
    folded = (
        cells(
            df, keys, {"one": F.lit(1), **measures},
            {"moment": truncate(F.col(shape.time), grain)} if shape.time else None,
        )
        .groupBy("slot", *KEY)
        .agg(
            F.count("*").alias("n"),
            *[F.sum(m).alias(f"{m}_sum") for m in measures],
            *[F.count(m).alias(f"{m}_count") for m in measures],
        )
    )
    slot = F.col("slot")
    value = finite(F.col("revenue_sum")).cast("double") if shape.revenue else F.col("n").cast("double")
    period = F.when(
        (slot == ROWS) & F.col("moment").isNotNull(), F.struct(F.col("moment").alias("period"), value.alias("value"))
    )
    return folded.agg(
        F.slice(F.sort_array(F.collect_list(period), asc=False), 1, 2).alias("newest"),  # as long as the calendar
        F.coalesce(F.sum(F.when(slot == ROWS, F.col("n"))), F.lit(0)).alias("rows"),
        F.count_if(slot == 0).alias("customers"),
        F.count_if((slot == 0) & (F.col("n") > 1)).alias("repeat_customers"),
        F.count_if(slot == 1).alias("orders"),
        *[F.sum(f"{m}_{part}").alias(f"{m}_{part}") for m in measures for part in ("sum", "count")],
    )


def kpis(df: DataFrame, shape: Shape, table: str = "data", grain: str = "month") -> DataFrame:
    """Every metric the shape supports, in display order (one row each, ``rank`` from 0).

    ``growth`` is filled for total revenue only, when there is a time column and a previous period; it
    comes from the fold that the totals come from.
    """
    names = {f: getattr(shape, f) for f in ("revenue", "quantity", "cost", "customer", "order")}
    usable = [m for m in _metrics() if all(names[need] for need in m.needs)]
    usable.sort(key=lambda m: DISPLAY_ORDER.index(m.key))

    rows = []
    for rank, m in enumerate(usable):
        sql = (
            _REPEAT_SQL if m.key == "repeat_customer_rate" else f"SELECT {m.sql} FROM {{table}}"
        ).format(table=table, **names)
        value = finite(m.value) if m.key not in ("total_revenue", "total_units", "row_count") else m.value
        rows.append(F.struct(
            F.lit(rank).alias("rank"), F.lit(m.key).alias("key"), F.lit(m.label).alias("label"),
            F.lit(m.description.format(**names)).alias("description"), F.lit(m.format).alias("format"),
            _exact(value).alias("value"), F.lit(True).alias("higher_is_better"), F.lit(sql).alias("sql"),
            F.array(*[F.lit(names[r]) for r in m.reads]).cast("array<string>").alias("depends_on"),
        ))
    now, before = F.get("newest", F.lit(0)), F.get("newest", F.lit(1))
    change = F.when((F.col("key") == "total_revenue") & before["value"].isNotNull(), F.struct(
        now["period"].alias("period"), now["value"].alias("value"), before["value"].alias("previous"),
        ratio(now["value"] - before["value"], before["value"]).cast("double").alias("change"),
    ))
    found = _totals(df, shape, grain).select("newest", F.inline(F.array(*rows)))
    return found.withColumn("growth", change).drop("newest").orderBy("rank")


def _exact(value: Column) -> Column:
    """decimal(38,6); NaN, infinities and values that do not fit become NULL."""
    return value.try_cast("decimal(38,6)")


def _measure(df: DataFrame, shape: Shape) -> Column:
    total = F.sum(_addable(df, shape.revenue)) if shape.revenue else F.count("*")
    return finite(total)


def period_totals(
    df: DataFrame, shape: Shape, grain: str = "month", keys: Sequence[str] = ()
) -> DataFrame:
    """Revenue (or row count) per period, and per value of ``keys`` if given; unordered.

    Periods without rows are absent.  Rows are summed per task before the shuffle, so its
    size is that of the calendar.
    """
    if shape.time is None:
        raise ValueError("no date column, so no time series")
    when = F.col(shape.time)
    return (
        df.where(when.isNotNull())
        .groupBy(*keys, truncate(when, grain).alias("period"))
        .agg(_measure(df, shape).alias("value"))
    )


def timeseries(
    df: DataFrame, shape: Shape, grain: str = "month", keys: Sequence[str] = ()
) -> DataFrame:
    """``period_totals`` in order."""
    return period_totals(df, shape, grain, keys).orderBy(*keys, "period")


def growth(df: DataFrame, shape: Shape, grain: str = "month") -> DataFrame:
    """Newest period against the last one before it that has rows; empty if there is none."""
    newest = period_totals(df, shape, grain).orderBy(F.desc("period")).limit(2)
    previous = F.lag("value").over(Window.orderBy("period"))  # two rows
    return (
        newest.withColumn("previous", previous)
        .where(F.col("previous").isNotNull())
        .withColumn("change", ratio(F.col("value") - F.col("previous"), F.col("previous")))
    )


def breakdown(df: DataFrame, shape: Shape, dimension: str | None = None, limit: int = 10) -> DataFrame:
    """Largest values of a dimension by revenue (or row count): ``label, value``."""
    if dimension is None and shape.dimensions:
        dimension = shape.dimensions[0]
    if dimension not in shape.dimensions:
        raise ValueError(f"{dimension!r} is not a dimension; use one of {list(shape.dimensions)}")
    return (
        df.where(F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).alias("label"))
        .agg(_measure(df, shape).alias("value"))
        .orderBy(F.desc_nulls_last("value"), "label")
        .limit(max(1, limit))
        .select(F.col("label").cast("string"), "value")
    )
