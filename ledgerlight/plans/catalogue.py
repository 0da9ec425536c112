"""Registered queries: one per operator, over the whole of the given tables.

Every query takes a session and a folder of parquet tables.  Dates and times leave as text
and computed numbers are rounded, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.functions.numbers import finite, ratio
from ledgerlight.operators import (
    anomalies as anomaly, churn as lapse, cleaning, forecast as outlook, metrics, profile as prof,
    quality, relationships as rel, semantics, star as stars,
)
from ledgerlight.operators.semantics import Shape
from ledgerlight.plans import exports
from ledgerlight.plans.pipelines import build_model, decide_model, propose_model, run_pipeline
from ledgerlight.session import shared_folder, small_frame
from ledgerlight.types import EDGES, NUMERIC_TYPES, TEMPORAL_TYPES, struct
from ledgerlight.sources import bounded_sql, delimited, naming, warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SALES_SHAPE = Shape(
    time="order_date", revenue="revenue", quantity="units", cost="unit_cost", customer="customer_id",
    order="order_id", product="product_id", measures=("revenue", "units", "unit_cost"),
    dimensions=("status", "return_class", "priority_class"),
)
EVENTS_SHAPE = Shape(
    time="ts", revenue="value", quantity=None, cost=None, customer="user_id", order=None,
    product=None, measures=("value",), dimensions=("event_type", "props"),
)
CONFIRMED = {
    ("sales", "customer_id", "customers", "customer_id"): True,
    ("sales", "product_id", "products", "product_id"): True,
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _named(name: str, function: Query) -> None:
    QUERIES[name] = function


def _r(column: str | Column, places: int = 4) -> Column:
    name = column if isinstance(column, str) else None
    rounded = F.round((F.col(column) if name else column).cast("double"), places)
    return rounded.alias(name) if name else rounded


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return exports.load(spark, folder, "events")


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "sales": exports.sales(spark, folder),
        "customers": exports.customers(spark, folder),
        "products": exports.products(spark, folder),
    }


# ---------------------------------------------------------------- sources


@query
def scan_preview(spark: SparkSession, folder: str) -> DataFrame:
    page = warehouse.preview(
        exports.load(spark, folder, "orders"), limit=50, offset=100, order_by=["o_orderkey"]
    )
    return page.withColumn("o_orderdate", _stamp("o_orderdate"))


@query
def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page from the middle of a stored table in an order with many ties."""
    store = warehouse.Warehouse(spark, shared_folder(spark))
    store.write(warehouse.CLEAN, "job_paged", exports.load(spark, folder, "orders"))
    page = store.preview("job_paged", limit=50, offset=1000, order_by=["o_orderpriority", "o_orderdate"])
    return page.withColumn("o_orderdate", _stamp("o_orderdate"))


@query
def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.row_counts({t: exports.load(spark, folder, t) for t in exports.TABLES})


@query
def normalise_headers(spark: SparkSession, folder: str) -> DataFrame:
    headers = ["Customer ID", " Full  Name", "2026 Nation", "Balance (USD)", "Group"]
    return exports.load(spark, folder, "customer").toDF(*naming.header_names(headers))


def _orders_as_file(spark: SparkSession, folder: str) -> str:
    path = shared_folder(spark) + ".csv"
    exports.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("Order ID"), F.col("o_totalprice").alias("Total Price (USD)"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("o_orderpriority").alias("Priority"), (F.col("o_orderkey") % 2 == 0).alias("Is Even"),
        F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("Order ID "),
    ).write.option("header", True).csv(path)
    return path


@query
def scan_delimited(spark: SparkSession, folder: str) -> DataFrame:
    read = delimited.read_delimited(spark, _orders_as_file(spark, folder))
    return read.withColumn("order_date", _stamp("order_date"))


@query
def scan_delimited_odd(spark: SparkSession, folder: str) -> DataFrame:
    """Line breaks inside quotes, and one cell among all rows that is no number."""
    path = shared_folder(spark) + ".csv"
    orders = exports.load(spark, folder, "orders")
    key = F.col("o_orderkey")
    last = orders.agg(F.max("o_orderkey")).scalar()
    orders.select(
        F.when(key == last, F.concat(F.lit("A-"), key.cast("string"))).otherwise(key.cast("string")).alias("Order ID"),
        F.when(key % 7 == 0, F.concat(F.lit("two\nlines, \"quoted\" "), "o_orderpriority"))
        .otherwise(F.col("o_orderpriority")).alias("Note"),
        F.col("o_custkey").alias("Customer"),
    ).write.options(header=True, escape='"').csv(path)
    return delimited.read_delimited(spark, path)


@query
def scan_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of a file, typed from themselves: the first customers' numbers, all of them whole."""
    path = shared_folder(spark) + ".csv"
    suppliers = exports.load(spark, folder, "supplier").orderBy("s_suppkey").coalesce(1)
    suppliers.select(
        F.col("s_suppkey").alias("Supplier"), F.col("s_name").alias("Name"),
        F.when(F.col("s_suppkey") > 8, F.lit("late")).otherwise(F.col("s_nationkey").cast("string")).alias("Nation"),
    ).write.option("header", True).csv(path)
    sample = delimited.read_sample(spark, path, 6)
    kinds = F.lit(", ".join(kind for _, kind in sample.dtypes))
    return sample.withColumn("types", kinds)


@query
def upload_names(spark: SparkSession, folder: str) -> DataFrame:
    """Table names and separators for uploads called after the nations; other file types are refused."""
    endings = [".csv", " (2).TSV", ".txt", ".xls"]
    names = [row["n_name"] for row in exports.load(spark, folder, "nation").orderBy("n_nationkey").collect()]
    taken: list[str] = []
    rows = []
    for number, name in enumerate(names):  # one short name per upload
        file = f"{number % 5} {name.title()} sales{endings[number % 4]}" if number % 3 else f"Sales{endings[number % 4]}"
        try:
            separator = {"\t": "tab"}.get(found := naming.separator_for(file), found)
            taken.append(naming.table_slug(file, taken))
            rows.append((file, taken[-1], separator))
        except naming.InvalidName:
            rows.append((file, "", "refused"))
    return small_frame(spark, rows, struct("file string, slug string, separator string"))


@query
def warehouse_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Loading again replaces, dropping removes every layer: rows of each table after each step."""
    store = warehouse.Warehouse(spark, shared_folder(spark))
    orders, found = exports.load(spark, folder, "orders"), []

    def note(step: str) -> None:
        for layer in (warehouse.RAW, warehouse.CLEAN):
            there = store.exists(layer, "job_loads")
            found.append((step, layer, store.row_count(layer, "job_loads") if there else -1))

    store.write(warehouse.RAW, "job_loads", orders)
    store.write(warehouse.CLEAN, "job_loads", store.read(warehouse.RAW, "job_loads").where("o_orderstatus = 'F'"))
    note("loaded")
    store.write(warehouse.RAW, "job_loads", orders.select("o_orderkey").where("o_custkey % 2 = 0"))
    note("loaded again")
    store.drop("job_loads")
    note("dropped")
    return small_frame(spark, found, struct("step string, layer string, rows bigint"))


@query
def parametric_query(spark: SparkSession, folder: str) -> DataFrame:
    store = warehouse.Warehouse(spark, shared_folder(spark))
    store.write(warehouse.CLEAN, "job_orders", exports.load(spark, folder, "orders"))
    return store.query(
        "SELECT o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total "
        "FROM clean.job_orders WHERE o_totalprice >= :low AND o_orderstatus <> :status GROUP BY o_orderpriority",
        low=1000.0, status="O'Neil",
    )


@query
def detect_schema(spark: SparkSession, folder: str) -> DataFrame:
    read = delimited.read_delimited(spark, _orders_as_file(spark, folder))
    return delimited.detect_schema(read).select(
        "position", "name", "normalized_name", "data_type", "nullable"
    )


@query
def bounded_select(spark: SparkSession, folder: str) -> DataFrame:
    text = """```sql
    WITH monthly AS (
        SELECT date_format(order_date, 'yyyy-MM') AS month, count(*) AS lines FROM sales GROUP BY 1
    )
    SELECT month, lines FROM monthly ORDER BY lines DESC, month LIMIT 5;
    ```"""
    return bounded_sql.bounded_select(spark, text, tables={"sales": exports.sales(spark, folder)})


# ---------------------------------------------------------------- profile

_BASE = ["table", "column", "row_count", "null_count", "distinct_count"]


@query
def profile_base(spark: SparkSession, folder: str) -> DataFrame:
    tables = {
        "orders": exports.load(spark, folder, "orders"),
        "events": _events(spark, folder),
        "messy_sales": exports.messy_sales(spark, folder),
    }
    rows = [prof.profile(df, name, base_only=True) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows).select(
        *_BASE, _r("null_fraction", 6), _r("distinct_fraction", 6), "is_constant", "is_empty"
    )


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Profile rows of all numeric columns of lineitem and events."""
    tables = {"lineitem": exports.load(spark, folder, "lineitem"), "events": _events(spark, folder)}
    rows = [
        prof.profile(df, name, columns=[c for c, kind in prof.column_types(df).items() if kind in NUMERIC_TYPES])
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder).select(
        "column", *[_r(c, 4) for c in (
            "min_value", "max_value", "mean_value", "median_value", "stddev_value", "q1", "q3",
        )],
    )


@query
def profile_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder).select("column", "outlier_count")


@query
def profile_temporal(spark: SparkSession, folder: str) -> DataFrame:
    tables = {t: exports.load(spark, folder, t) for t in ("orders", "events", "lineitem")}
    rows = [
        prof.profile(df, t, columns=[c for c, kind in prof.column_types(df).items() if kind in TEMPORAL_TYPES])
        for t, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows).select("column", "min_date", "max_date")


@query
def profile_string(spark: SparkSession, folder: str) -> DataFrame:
    return prof.profile(exports.messy_sales(spark, folder), "messy_sales").where(
        ~F.col("is_empty")
    ).select(
        "column", "blank_count", "null_token_count", "whitespace_count",
        *[_r(c, 6) for c in ("numeric_like_fraction", "date_like_fraction", "boolean_like_fraction")],
    )


@query
def profile_top_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = prof.profile(exports.messy_sales(spark, folder), "messy_sales")
    return rows.select("column", F.posexplode("top_values").alias("place", "top")).select(
        "column", (F.col("place") + 1).alias("place"), "top.value", "top.count", _r(F.col("top.fraction"), 6).alias("fraction")
    )


@query
def duplicate_count(spark: SparkSession, folder: str) -> DataFrame:
    return prof.duplicate_summary(exports.messy_sales(spark, folder))


# ---------------------------------------------------------------- cleaning and quality


def _raw_findings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    df = exports.messy_sales(spark, folder)
    return df, *prof.survey(df, "messy_sales")


@query
def cleaning_plan(spark: SparkSession, folder: str) -> DataFrame:
    _, rows, duplicates = _raw_findings(spark, folder)
    return cleaning.audit(cleaning.plan_cleaning(rows, duplicates)).select(
        F.coalesce("column", F.lit("*")).alias("column"), F.array_join("actions", " ").alias("actions"),
        F.coalesce("resulting_type", F.lit("-")).alias("resulting_type"), "reason",
    )


@query
def clean_messy_sales(spark: SparkSession, folder: str) -> DataFrame:
    df, rows, duplicates = _raw_findings(spark, folder)
    cleaned = cleaning.clean(df, cleaning.plan_cleaning(rows, duplicates))
    return cleaned.withColumn("order_date", _stamp("order_date"))


@query
def quality_issues(spark: SparkSession, folder: str) -> DataFrame:
    df, rows, duplicates = _raw_findings(spark, folder)
    count = rows.first()["row_count"]
    return quality.quality_issues(rows, count, duplicates).select(
        F.coalesce("column_name", F.lit("*")).alias("column_name"), "code", "severity", "message"
    )


@query
def quality_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Findings about number columns, and about the same table without rows."""
    price = F.col("l_extendedprice")
    df = exports.load(spark, folder, "lineitem").select(
        "l_quantity", F.pow(price, F.lit(6)).alias("steep"), F.when(F.col("l_linenumber") == 7, price).alias("rare"),
    )
    found = []
    for name, frame in (("full", df), ("empty", df.where("l_quantity < 0"))):
        rows, duplicates = prof.survey(frame, name)
        issues = quality.quality_issues(rows, rows.first()["row_count"], duplicates)
        found.append(issues.select(
            F.lit(name).alias("table"), F.coalesce("column_name", F.lit("*")).alias("column_name"), "code", "severity", "message",
        ))
    return found[0].unionByName(found[1])


@query
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    df, rows, duplicates = _raw_findings(spark, folder)
    count = rows.first()["row_count"]
    clean_rows = cleaning.clean_row_count(df, cleaning.plan_cleaning(rows, duplicates))
    issues = quality.quality_issues(rows, count, duplicates)
    return quality.quality_report(issues, len(df.columns), count, clean_rows)


# ---------------------------------------------------------------- semantics and metrics


def _meaning(df: DataFrame, table: str) -> DataFrame:
    return semantics.classify(prof.profile(df, table, base_only=True)).select(
        "column", "data_type", "role", F.array_join("tags", " ").alias("tags")
    )


@query
def semantics_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _meaning(exports.sales(spark, folder), "sales")


@query
def semantics_events(spark: SparkSession, folder: str) -> DataFrame:
    return _meaning(_events(spark, folder), "events")


@query
def stored_roles(spark: SparkSession, folder: str) -> DataFrame:
    """A user's role stays after the table is loaded again; a column of another type is classified anew."""
    df = exports.sales(spark, folder)
    first = semantics.classify(prof.profile(df, "sales", base_only=True))
    mine = F.col("column").isin("units", "status")
    corrected = first.withColumns({
        "role": F.when(mine, "ignored").otherwise(F.col("role")), "rationale": F.lit("stored"),
    })
    again = df.drop("unit_cost").withColumn("status", (F.col("status") == "O")).withColumn("price", F.col("revenue") / 2)
    found = semantics.resolve(prof.profile(again, "sales", base_only=True), corrected)
    can = {name for name, possible in semantics.shape_of(found).capabilities.items() if possible}
    return found.select(
        "column", "data_type", "role", (F.col("rationale") == "stored").alias("kept"),
        F.lit(" ".join(sorted(can))).alias("capabilities"),
    )


@query
def finite_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """NaN and infinities among the amounts of events: none reaches a result."""
    n = F.col("event_id") % 10
    odd = F.when(n == 3, F.lit("NaN")).when(n == 4, F.lit("Infinity")).when(n == 5, F.lit("-Infinity"))
    amount = F.coalesce(odd.cast("double"), F.col("value"))
    return _events(spark, folder).groupBy("event_type").agg(
        F.count(finite(amount)).alias("finite"), _r(F.sum(finite(amount)), 4).alias("total"),
        _r(finite(F.sum(amount))).alias("with_all"), _r(ratio(F.sum("value"), F.sum(F.lit(0)))).alias("per_nothing"),
    )


def _kpis(df: DataFrame, shape: Shape) -> DataFrame:
    return metrics.kpis(df, shape).select(
        "rank", "key", "label", "format", _r("value", 4),
        F.date_format("growth.period", "yyyy-MM-dd").alias("growth_period"),
        *[_r(F.col(f"growth.{part}"), 4).alias(f"growth_{part}") for part in ("value", "previous")],
        _r(F.col("growth.change"), 6).alias("growth_change"),
    )


@query
def kpis_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _kpis(exports.sales(spark, folder), SALES_SHAPE)


@query
def kpis_events(spark: SparkSession, folder: str) -> DataFrame:
    return _kpis(_events(spark, folder), EVENTS_SHAPE)


def _series_query(grain: str, sales: bool) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = exports.sales(spark, folder) if sales else _events(spark, folder)
        return metrics.timeseries(df, SALES_SHAPE if sales else EVENTS_SHAPE, grain).select(
            _stamp("period"), _r("value")
        )
    return run


for _grain in ("day", "week"):
    _named(f"timeseries_{_grain}", _series_query(_grain, sales=False))
for _grain in ("month", "quarter", "year"):
    _named(f"timeseries_{_grain}", _series_query(_grain, sales=True))


@query
def timeseries_records(spark: SparkSession, folder: str) -> DataFrame:
    shape = Shape("ts", None, None, None, "user_id", None, None, (), ("event_type",))
    return metrics.timeseries(_events(spark, folder), shape, "day").select(_stamp("period"), _r("value"))


@query
def growth_month(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.growth(exports.sales(spark, folder), SALES_SHAPE).select(
        _stamp("period"), _r("value"), _r("previous"), _r("change", 6)
    )


@query
def breakdown_segment(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder)
    shape = Shape("order_date", "revenue", None, None, None, None, None, ("revenue",), ("customers_segment",))
    wide = stars.star("sales", tables, _confirmed(spark))
    return metrics.breakdown(wide, shape).select("label", _r("value"))


@query
def breakdown_records(spark: SparkSession, folder: str) -> DataFrame:
    shape = Shape("ts", None, None, None, "user_id", None, None, (), ("event_type", "props"))
    return metrics.breakdown(_events(spark, folder), shape, "props", limit=7).select("label", _r("value"))


# ---------------------------------------------------------------- relationships and star


def _confirmed(spark: SparkSession) -> DataFrame:
    rows = [(*edge, 1.0, 1.0, 0, True, "", answer) for edge, answer in CONFIRMED.items()]
    return small_frame(spark, rows, EDGES)


@query
def containment_pairs(spark: SparkSession, folder: str) -> DataFrame:
    index = rel.index_values(_tables(spark, folder))
    pairs = rel.candidate_pairs(rel.describe(index))
    return rel.measure_containment(index, pairs).select(*rel.EDGE, "to_distinct", _r("containment", 6))


@query
def detect_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return rel.detect(_tables(spark, folder)).select(
        *rel.EDGE, "containment", "confidence", "distinct_values", "name_match", "rationale"
    )


@query
def merge_decisions(spark: SparkSession, folder: str) -> DataFrame:
    found = rel.detect(_tables(spark, folder))
    rejected = ("customers", "nation_id", "products", "product_id")
    decided = rel.decide(found.where("confidence >= 0.9"), {**CONFIRMED, rejected: False})
    known = decided.where("from_column <> 'customer_id' OR from_table <> 'customers'")
    return rel.merge_decisions(known, found).select(*rel.EDGE, "confidence", "confirmed")


@query
def star_sales(spark: SparkSession, folder: str) -> DataFrame:
    wide = stars.star("sales", _tables(spark, folder), _confirmed(spark))
    return wide.withColumns({"order_date": _stamp("order_date"), "revenue": _r("revenue")})


@query
def star_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    wide = stars.star("sales", _tables(spark, folder), _confirmed(spark))
    return wide.groupBy("customers_segment", "products_category").agg(
        F.count("*").alias("rows"), F.round(F.sum("revenue"), 4).alias("revenue")
    )


@query
def table_roles(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder)
    edges = rel.decide(rel.detect(tables), CONFIRMED)
    return stars.model_summary(tables, edges).select(
        "table", "role", "rows", F.coalesce("joined_to", F.lit("")).alias("joined_to")
    )


@query
def star_columns(spark: SparkSession, folder: str) -> DataFrame:
    """What detected and confirmed edges add to the fact, and how often each column is filled."""
    tables = _tables(spark, folder)
    edges = rel.decide(rel.detect(tables), CONFIRMED)
    described = stars.star_columns("sales", tables, edges)
    names = [row["column"] for row in described.collect()]
    counts = stars.star("sales", tables, edges).agg(
        F.array(*[F.struct(F.lit(n).alias("column"), F.count(n).alias("filled")) for n in names]).alias("counts")
    )
    return described.join(counts.select(F.inline("counts")), "column")


@query
def model_job(spark: SparkSession, folder: str) -> DataFrame:
    """Tables stored, edges proposed and decided, star views rebuilt, and the star read back."""
    store = warehouse.Warehouse(spark, shared_folder(spark))
    names = {name: f"job_{name}" for name in ("sales", "customers", "products")}
    for name, frame in _tables(spark, folder).items():
        store.write(warehouse.CLEAN, names[name], frame)
    decisions = {
        (names[a], b, names[c], d): answer for (a, b, c, d), answer in CONFIRMED.items()
    }
    for first_time in (True, False):  # the second detection finds the decisions of the first
        edges = propose_model(store, list(names.values()), name="job")
        if first_time:
            decide_model(store, decisions, "job")
    build_model(store, list(names.values()), edges)
    star = spark.table(store.target(names["sales"]))
    return star.groupBy(
        F.col("job_customers_segment").alias("customers_segment"),
        F.col("job_products_category").alias("products_category"),
    ).agg(F.count("*").alias("rows"), F.round(F.sum("revenue"), 4).alias("revenue"))


# ---------------------------------------------------------------- predictions


def _outlook(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.select(
        *keys, _stamp("period"), _r("value", 2), _r("lower", 2), _r("upper", 2), "method",
        "history_points", _r("noise_ratio", 6),
    )


@query
def forecast_linear(spark: SparkSession, folder: str) -> DataFrame:
    """All sales by year: few enough periods for the straight trend."""
    series = metrics.period_totals(exports.sales(spark, folder), SALES_SHAPE, "year")
    return _outlook(outlook.forecast(series, horizon=6))


@query
def forecast_linear_by_status(spark: SparkSession, folder: str) -> DataFrame:
    series = metrics.period_totals(exports.sales(spark, folder), SALES_SHAPE, "year", keys=["status"])
    return _outlook(outlook.forecast(series, ["status"], horizon=6), "status")


@query
def forecast_seasonal_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The seasonal branch, all sales by month: periods, and band widths against the first."""
    series = metrics.period_totals(exports.sales(spark, folder), SALES_SHAPE)
    rows = outlook.forecast(series, horizon=6, allow_negative=True)
    width = F.col("upper") - F.col("lower")
    first = rows.agg(F.min_by(width, F.col("period"))).scalar()
    return rows.select(
        _stamp("period"), "method", "history_points", _r(width / first, 4).alias("width_ratio")
    )


@query
def forecast_seasonal(spark: SparkSession, folder: str) -> DataFrame:
    series = metrics.period_totals(exports.sales(spark, folder), SALES_SHAPE)
    return _outlook(outlook.forecast(series, horizon=6))


def _flagged(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.select(
        *keys, _stamp("period"), _r("value", 4), _r("expected", 2), _r("deviation_ratio", 6),
        _r("z_score", 4), "direction", "severity",
    )


@query
def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(anomaly.anomalies(metrics.period_totals(exports.sales(spark, folder), SALES_SHAPE)))


@query
def anomalies_by_type(spark: SparkSession, folder: str) -> DataFrame:
    series = metrics.period_totals(_events(spark, folder), EVENTS_SHAPE, "day", ["event_type"])
    return _flagged(anomaly.anomalies(series, ["event_type"], sensitivity=1.5), "event_type")


@query
def rfm_features(spark: SparkSession, folder: str) -> DataFrame:
    return lapse.rfm(exports.sales(spark, folder), SALES_SHAPE).select(
        "customer", "recency_days", "frequency", _r("monetary"), "tenure_days"
    )


@query
def rfm_text_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates kept as text, some of them unreadable: those rows do not count."""
    text = F.when(F.col("order_id") % 50 == 0, F.lit("soon")).otherwise(F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
    return lapse.rfm(exports.sales(spark, folder).withColumn("order_date", text), SALES_SHAPE).select(
        "customer", "recency_days", "frequency", _r("monetary"), "tenure_days"
    )


@query
def churn_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    return lapse.lapse_cutoff(lapse.rfm(exports.sales(spark, folder), SALES_SHAPE))


@query
def churn_labels(spark: SparkSession, folder: str) -> DataFrame:
    model = lapse.churn(exports.sales(spark, folder), SALES_SHAPE)
    return model.scores.groupBy("lapsed").agg(
        F.count("*").alias("customers"), F.max("recency_days").alias("longest"),
        F.min("recency_days").alias("shortest"),
    )


@query
def churn_model(spark: SparkSession, folder: str) -> DataFrame:
    """Drivers and quality of the fit."""
    model = lapse.churn(exports.sales(spark, folder), SALES_SHAPE)
    return model.drivers.select(
        "feature", "label", _r("coefficient", 6), "direction", F.lit(model.cutoff_days).alias("cutoff_days"),
        F.lit(model.customers).cast("bigint").alias("customers"), F.lit(model.lapsed).cast("bigint").alias("lapsed"),
        _r(F.lit(model.accuracy), 6).alias("accuracy"), F.lit(model.definition).alias("definition"),
    )


@query
def churn_scores(spark: SparkSession, folder: str) -> DataFrame:
    model = lapse.churn(exports.sales(spark, folder), SALES_SHAPE)
    return model.at_risk(10).select(
        "customer", _r("risk", 4), "band", "recency_days", "frequency", _r("monetary"), "reason"
    )


# ---------------------------------------------------------------- pipelines


@query
def pipeline_kpis(spark: SparkSession, folder: str) -> DataFrame:
    """Untidy file to raw table, clean table, semantics and metrics, all stored and read back."""
    place = shared_folder(spark)
    path = place + ".csv"
    exports.messy_sales(spark, folder).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    cleaned, analysed = run_pipeline(spark, path, table="messy_sales", location=place)
    return analysed.kpis.select("key", _r("value", 4))
