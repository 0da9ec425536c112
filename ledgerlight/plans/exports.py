"""Business exports over the TPC-H-like tables: what a company's files would look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line with customer, product, money and dates."""
    lines, orders, parts = (load(spark, folder, t) for t in ("lineitem", "orders", "part"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"), F.col("o_orderdate").alias("order_date"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
            F.col("l_quantity").alias("units"),
            (F.col("l_quantity") * F.col("p_retailprice")).alias("unit_cost"),
            F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("return_class"),
            F.col("o_orderpriority").alias("priority_class"),
        )
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation_id"),
        F.col("c_acctbal").alias("balance"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"),
    )


def messy_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as an untidy spreadsheet: all text, padded, with placeholders and copies."""
    order, part, text = F.col("l_orderkey"), F.col("l_partkey"), lambda c: c.cast("string")
    name = F.concat(F.lit("Customer "), text(F.col("l_suppkey") % 97))
    copies = F.when(order % 100 == 7, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        load(spark, folder, "lineitem")
        .withColumn("copy", F.explode(copies))
        .select(
            text(order).alias("order_no"),
            F.when(F.col("l_linenumber") == 3, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(name).alias("customer"),
            F.when(order % 50 == 0, F.lit("N/A"))
            .otherwise(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))).alias("revenue"),
            F.when(order % 40 == 1, F.date_format("l_shipdate", "yyyy/MM/dd"))
            .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("order_date"),
            F.when(F.col("l_returnflag") == "R", "Yes").otherwise("no").alias("active"),
            F.lit(None).cast("string").alias("notes"),
            F.lit("UK").alias("country"),
            F.when(part % 10 < 6, text(F.col("l_quantity").cast("int")))
            .otherwise(F.concat(F.lit("lot "), text(part % 7))).alias("remark"),
            F.concat_ws("-", text(order), text(part), text(F.col("l_suppkey"))).alias("tracking"),
            F.when(order % 3 == 0, F.when(order % 2 == 0, " unknown").otherwise("gift")).alias("wrap"),
        )
    )
