import datetime as dt

import pytest

from ledgerlight.operators import metrics, semantics
from ledgerlight.operators.profile import profile
from tests.test_cleaning import profile_rows


def classified(spark, column, **row):
    rows = profile_rows(spark, {"column": column, **row})
    found = semantics.classify(rows).first()
    return found["role"], found["tags"]


@pytest.mark.parametrize("column, row, role, tags", [
    ("revenue", {"data_type": "decimal"}, "measure", ["monetary"]),
    ("discount_amount", {"data_type": "decimal"}, "measure", ["discount"]),
    ("unit_cost", {"data_type": "decimal"}, "measure", ["cost"]),
    ("height", {"data_type": "integer"}, "measure", ["quantity"]),
    ("order_id", {"data_type": "integer"}, "identifier", ["order_key"]),
    ("customer", {"data_type": "integer"}, "identifier", ["customer_key"]),
    ("serial", {"data_type": "integer", "distinct_fraction": 0.99}, "identifier", []),
    ("serial", {"data_type": "integer", "distinct_fraction": 0.99, "row_count": 49}, "measure", ["quantity"]),
    ("serial", {"data_type": "decimal", "distinct_fraction": 1.0}, "measure", ["quantity"]),
    ("updated_at", {"data_type": "timestamp"}, "time", ["event_date"]),
    ("is_new", {"data_type": "boolean"}, "dimension", ["status"]),
    ("segment", {}, "dimension", ["category"]),
    ("country", {}, "dimension", ["geography"]),
    ("state", {}, "dimension", ["geography"]),
    ("remark", {"distinct_count": 1001}, "identifier", []),
    ("remark", {"distinct_fraction": 0.5}, "identifier", []),
    ("remark", {"distinct_fraction": 0.5, "row_count": 49}, "dimension", ["category"]),
    ("zip_code", {}, "identifier", []),
    ("revenue", {"data_type": "decimal", "is_constant": True}, "ignored", ["monetary"]),
    ("revenue", {"data_type": "decimal", "null_fraction": 0.95}, "ignored", ["monetary"]),
])
def test_roles_and_tags(spark, column, row, role, tags):
    assert classified(spark, column, **row) == (role, tags)


ROWS = [
    (1, "a", dt.date(2025, 1, 4), 100.0, 2, 40.0, "east"), (2, "b", dt.date(2025, 1, 9), 300.0, 1, 200.0, "west"),
    (3, "a", dt.date(2025, 2, 1), 500.0, 4, 100.0, "east"), (4, "c", dt.date(2025, 4, 2), 50.0, 1, 10.0, "north"),
    (5, None, dt.date(2025, 4, 3), 150.0, 2, 50.0, None), (6, "d", None, 900.0, 3, 100.0, "west"),
]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        ROWS, "order_id bigint, customer_id string, order_date date, revenue double, units int, unit_cost double, region string"
    )


@pytest.fixture(scope="module")
def shape(orders):
    return semantics.shape_of(semantics.classify(profile(orders, base_only=True)))


def test_shape(shape):
    assert (shape.time, shape.revenue, shape.quantity, shape.cost) == ("order_date", "revenue", "units", "unit_cost")
    assert (shape.customer, shape.order, shape.dimensions) == ("customer_id", "order_id", ("region",))
    assert shape.capabilities == {"forecast": True, "anomalies": True, "churn": True, "dimensions": True}


def test_kpis(spark, orders, shape):
    orders.createOrReplaceTempView("kpi_orders")
    rows = metrics.kpis(orders, shape, "kpi_orders").collect()
    found = {r["key"]: float(r["value"]) for r in rows}
    assert found == pytest.approx({
        "total_revenue": 2000.0, "gross_margin": 0.75, "order_count": 6, "average_order_value": 2000 / 6,
        "unique_customers": 4, "repeat_customer_rate": 0.25, "revenue_per_customer": 500.0, "total_units": 13,
        "average_transaction": 2000 / 6, "row_count": 6,
    }, abs=1e-6)
    assert [r["key"] for r in rows] == list(metrics.DISPLAY_ORDER)
    growth = rows[0]["growth"]
    assert (growth["value"], growth["previous"], growth["change"]) == (200.0, 500.0, -0.6)
    assert all(r["growth"] is None for r in rows[1:])
    for row in rows:  # the SQL shown to the user gives the number shown to the user
        assert float(spark.sql(row["sql"]).first()[0]) == pytest.approx(float(row["value"]), abs=1e-6)


def test_only_supported_metrics_appear(spark, orders):
    bare = orders.select("region", "order_date")
    found = semantics.shape_of(semantics.classify(profile(bare, base_only=True)))
    assert [r["key"] for r in metrics.kpis(bare, found).collect()] == ["row_count"]
    assert [r["value"] for r in metrics.timeseries(bare, found).collect()] == [2.0, 1.0, 2.0]


def test_metrics_of_an_empty_table(spark, orders, shape):
    found = {r["key"]: r["value"] for r in metrics.kpis(orders.limit(0), shape).collect()}
    assert found["row_count"] == 0 and found["total_revenue"] is None and found["average_order_value"] is None


def test_infinite_totals_become_null(spark, shape, orders):
    odd = orders.selectExpr("* EXCEPT (revenue)", "cast('inf' as double) AS revenue")
    assert {r["key"]: r["value"] for r in metrics.kpis(odd, shape).collect()}["total_revenue"] is None


def test_series_skip_missing_dates_and_periods(orders, shape):
    rows = [(str(r["period"])[:10], r["value"]) for r in metrics.timeseries(orders, shape).collect()]
    assert rows == [("2025-01-01", 400.0), ("2025-02-01", 500.0), ("2025-04-01", 200.0)]


def test_growth_needs_two_periods(orders, shape):
    assert metrics.growth(orders.where("order_id < 3"), shape).count() == 0


def test_breakdown(orders, shape):
    rows = [tuple(r) for r in metrics.breakdown(orders, shape).collect()]
    assert rows == [("west", 1200.0), ("east", 600.0), ("north", 50.0)]
    assert metrics.breakdown(orders, shape, "region", limit=0).count() == 1
    with pytest.raises(ValueError):
        metrics.breakdown(orders, shape, "revenue")


def test_stored_roles_win_where_they_fit(spark, orders, shape):
    rows = profile(orders, base_only=True)
    mine = semantics.classify(rows).withColumn("rationale", semantics.F.lit("mine"))
    told = {r["column"]: r["rationale"] for r in semantics.resolve(rows, mine.where("column <> 'units'")).collect()}
    assert told.pop("units") != "mine" and set(told.values()) == {"mine"}
    # a column has gone, one has become another type, one is new: those are classified
    again = orders.drop("revenue").withColumn("units", semantics.F.col("units").cast("string")).withColumn("fresh", semantics.F.lit(1.5))
    found = semantics.resolve(profile(again, base_only=True), mine)
    told = {r["column"]: r["rationale"] for r in found.collect()}
    assert list(told) == again.columns
    assert {c for c, why in told.items() if why != "mine"} == {"units", "fresh"}
    assert semantics.shape_of(found).revenue is None
    assert metrics.kpis(again, semantics.shape_of(found)).count() > 0


def test_a_hot_customer_changes_nothing(spark, shape):
    df = spark.range(20000).selectExpr(
        "id AS order_id", "cast(if(id % 3 = 0, 0, id) as string) AS customer_id", "date'2025-01-01' AS order_date",
        "1.0D AS revenue", "1 AS units", "0.5D AS unit_cost", "'x' AS region",
    )
    found = {r["key"]: float(r["value"]) for r in metrics.kpis(df, shape).collect()}
    repeats = 1
    assert found["unique_customers"] == 20000 - 6667 + 1
    assert found["repeat_customer_rate"] == pytest.approx(repeats / found["unique_customers"], abs=1e-6)
