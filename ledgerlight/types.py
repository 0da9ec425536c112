"""Logical types and the fixed schemas of every frame the library returns."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INTEGER, DECIMAL, BOOLEAN, DATE, TIMESTAMP, UNKNOWN = (
    "string", "integer", "decimal", "boolean", "date", "timestamp", "unknown",
)
NUMERIC_TYPES = (INTEGER, DECIMAL)
TEMPORAL_TYPES = (DATE, TIMESTAMP)


def logical_type(dtype: T.DataType) -> str:
    """Collapse a Spark type into the closed logical vocabulary."""
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.IntegralType):
        return INTEGER
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return DECIMAL
    if isinstance(dtype, T.DateType):
        return DATE
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    return UNKNOWN


def type_family(logical: str) -> str:
    """Comparability class: only columns of one family can reference each other."""
    return {
        INTEGER: "numeric", DECIMAL: "numeric", STRING: "text",
        DATE: "temporal", TIMESTAMP: "temporal", BOOLEAN: "boolean",
    }.get(logical, "other")


TOP_VALUES = T.ArrayType(
    T.StructType([
        T.StructField("value", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("fraction", T.DoubleType()),
    ])
)


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()),
}


def struct(spec: str) -> T.StructType:
    pairs = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


COLUMNS = struct(
    "position int, name string, normalized_name string, data_type string, source_type string, "
    "nullable boolean, sample_values strings"
)

PROFILE = struct(
    "table string, layer string, position int, column string, data_type string, "
    "row_count bigint, null_count bigint, null_fraction double, distinct_count bigint, "
    "distinct_fraction double, is_constant boolean, is_empty boolean, "
    "min_value double, max_value double, mean_value double, median_value double, "
    "stddev_value double, q1 double, q3 double, outlier_count bigint, "
    "min_date string, max_date string, "
    "blank_count bigint, null_token_count bigint, whitespace_count bigint, "
    "numeric_like_fraction double, date_like_fraction double, boolean_like_fraction double"
).add("top_values", TOP_VALUES)

EDGES = struct(
    "from_table string, from_column string, to_table string, to_column string, "
    "containment double, confidence double, distinct_values bigint, name_match boolean, "
    "rationale string, confirmed boolean"
)
