"""Star views: a fact table with the columns of the dimensions it points at.

Always a left join on a key that is unique in the dimension, so rows and sums of the fact
do not change.  No broadcast is forced: Spark broadcasts a dimension only if its size
allows, and otherwise sort-merges, with adaptive execution splitting a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.session import small_frame
from ledgerlight.sources.naming import identifier
from ledgerlight.types import logical_type, struct


class Join(NamedTuple):
    dimension: str
    fact_column: str
    dimension_column: str
    columns: tuple[tuple[str, str], ...]  # (column, name in the star)


def joins_for(fact: str, columns: Mapping[str, Iterable[str]], edges: DataFrame) -> list[Join]:
    """Joins of a fact from the confirmed edges; ``columns`` lists each table's columns."""
    rows = (
        edges.where(F.col("confirmed") & (F.col("from_table") == fact))
        .orderBy(F.desc("confidence"), "from_column", "to_table").collect()
    )
    joins: list[Join] = []
    for row in rows:
        again = any(join.dimension == row.to_table for join in joins)
        prefix = f"{row.to_table}_{row.from_column}" if again else row.to_table
        joins.append(Join(
            row.to_table, row.from_column, row.to_column,
            tuple((c, f"{prefix}_{c}") for c in columns[row.to_table] if c != row.to_column),
        ))
    return joins


def star(fact: str, tables: Mapping[str, DataFrame], edges: DataFrame) -> DataFrame:
    """The wide frame of one fact; columns no query asks for are pruned from the scans."""
    frame = tables[fact]
    for number, join in enumerate(joins_for(fact, {t: df.columns for t, df in tables.items()}, edges)):
        key = f"__key_{number}"
        dimension = tables[join.dimension].select(
            F.col(join.dimension_column).alias(key), *[F.col(c).alias(name) for c, name in join.columns]
        )
        frame = frame.join(dimension, frame[join.fact_column] == dimension[key], "left").drop(key)
    return frame


def star_sql(fact: str, columns: Mapping[str, Iterable[str]], edges: DataFrame, database: str) -> str:
    """The same as a SELECT over stored tables, for a catalog view that is never stale.

    Each dimension comes as a subselect that already has the star's names and a key column,
    which the outer list leaves out.
    """
    joins = joins_for(fact, columns, edges)
    left = f"{identifier(database)}.{identifier(fact)}"
    text = f"{left} AS fact"
    for number, join in enumerate(joins):
        inner = ", ".join(
            f"{identifier(c)} AS {identifier(name)}"
            for c, name in [(join.dimension_column, f"__key_{number}"), *join.columns]
        )
        text += (
            f" LEFT JOIN (SELECT {inner} FROM {identifier(database)}.{identifier(join.dimension)}) AS side_{number}"
            f" ON fact.{identifier(join.fact_column)} = side_{number}.`__key_{number}`"
        )
    left_out = ", ".join(f"`__key_{number}`" for number in range(len(joins)))
    return f"SELECT *{f' EXCEPT ({left_out})' if left_out else ''} FROM {text}"


def table_roles(spark: SparkSession, tables: Iterable[str], edges: DataFrame) -> DataFrame:
    """``table, role``: fact if it points at another table, dimension if only pointed at."""
    used = edges.where(F.col("confirmed"))
    ends = used.select(F.col("from_table").alias("table"), F.lit("fact").alias("role")).unionByName(
        used.select(F.col("to_table").alias("table"), F.lit("dimension").alias("role"))
    )
    # "fact" sorts after "dimension", so the maximum is the stronger role.
    strongest = ends.groupBy("table").agg(F.max("role").alias("role"))
    names = small_frame(spark, [(t,) for t in tables], struct("table string"))
    return names.join(strongest, "table", "left").select(
        "table", F.coalesce("role", F.lit("unknown")).alias("role")
    ).orderBy("table")


def star_columns(fact: str, tables: Mapping[str, DataFrame], edges: DataFrame) -> DataFrame:
    """``column, description`` of what a star adds to its fact."""
    rows = [
        (name, f"{logical_type(tables[join.dimension].schema[c].dataType)}, "
               f"from {join.dimension} via {join.fact_column}")
        for join in joins_for(fact, {t: df.columns for t, df in tables.items()}, edges)
        for c, name in join.columns
    ]
    return small_frame(edges.sparkSession, rows, struct("column string, description string"))


def model_summary(tables: Mapping[str, DataFrame], edges: DataFrame) -> DataFrame:
    """``table, role, rows, joined_to`` for every table of the model."""
    spark = edges.sparkSession
    rows = small_frame(spark, [(t, df.count()) for t, df in tables.items()], struct("table string, rows bigint"))
    joined = edges.where(F.col("confirmed")).groupBy(F.col("from_table").alias("table")).agg(
        F.concat_ws(", ", F.sort_array(F.collect_set(F.concat(F.col("to_table"), F.lit(" on "), F.col("from_column")))))
        .alias("joined_to")
    )
    return (
        table_roles(spark, tables, edges).join(rows, "table").join(joined, "table", "left").orderBy("table")
    )
