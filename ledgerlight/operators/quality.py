"""Quality findings and a 0-100 score, as rules over profile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight import types as lt
from ledgerlight.functions.numbers import count_text, percent_text
from ledgerlight.session import small_frame

# Rule thresholds and what each finding costs.
MOSTLY_NULL = 0.5
MOSTLY_UNIQUE, UNIQUE_NEEDS_ROWS = 0.9, 10
MIXED_FROM, MIXED_BELOW = 0.5, 0.95
MANY_OUTLIERS = 0.05
MANY_DUPLICATES = 0.01
PENALTIES = {"error": 25.0, "warning": 10.0, "info": 2.0}

_ISSUE = "struct<code:string,severity:string,message:string,details:map<string,string>>"
_SCHEMA = "code string, severity string, column_name string, message string, details map<string,string>"


def _issue(holds: Column, code: str, severity: str | Column, message: Column, **details: Column) -> Column:
    entries = [part for k, v in details.items() for part in (F.lit(k), v.cast("string"))]
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        holds,
        F.struct(
            F.lit(code).alias("code"), severity.alias("severity"), message.alias("message"),
            F.create_map(*entries).alias("details"),
        ).cast(_ISSUE),
    )


def column_issues(profile: DataFrame) -> DataFrame:
    """Findings about single columns; an empty column has that finding only."""
    name = F.concat(F.lit("'"), F.col("column"), F.lit("'"))
    say = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    filled = ~F.col("is_empty")
    is_text = F.col("data_type") == lt.STRING
    numeric_share = F.coalesce(F.col("numeric_like_fraction"), F.lit(0.0))
    outlier_share = F.try_divide(F.col("outlier_count"), F.col("row_count") - F.col("null_count"))
    rules = [
        _issue(F.col("is_empty"), "empty_column", "error",
               say(name, "has no values at all."), null_count=F.col("null_count")),
        _issue(filled & (F.col("null_fraction") >= MOSTLY_NULL), "high_null_rate", "warning",
               say(name, "is", percent_text(F.col("null_fraction")), "null, so its totals and means mislead."),
               null_count=F.col("null_count"), null_fraction=F.bround(F.col("null_fraction"), 4)),
        _issue(filled & F.col("is_constant"), "constant_column", "info",
               say(name, "never changes and explains nothing."), distinct_count=F.col("distinct_count")),
        _issue(filled & is_text & (numeric_share >= MIXED_FROM) & (numeric_share < MIXED_BELOW),
               "mixed_types", "warning",
               say(name, "is", percent_text(numeric_share), "numbers and the rest text; it stayed text."),
               numeric_like_fraction=F.bround(numeric_share, 4)),
        _issue(filled & is_text & (F.col("distinct_fraction") >= MOSTLY_UNIQUE)
               & (F.col("row_count") > UNIQUE_NEEDS_ROWS), "high_cardinality", "info",
               say(name, "has nearly as many values as rows, like an identifier."),
               distinct_fraction=F.bround(F.col("distinct_fraction"), 4)),
        _issue(filled & F.col("data_type").isin(*lt.NUMERIC_TYPES) & (outlier_share >= MANY_OUTLIERS),
               "outliers", "info",
               say(name, "has", F.col("outlier_count").cast("string"), "extreme values,",
                   percent_text(outlier_share), "of those present."),
               outlier_count=F.col("outlier_count"), q1=F.col("q1"), q3=F.col("q3")),
    ]
    return (
        profile.select("column", F.explode(F.array_compact(F.array(*rules))).alias("issue"))
        .select("issue.code", "issue.severity", F.col("column").alias("column_name"),
                "issue.message", "issue.details")
    )


def table_issues(counts: DataFrame) -> DataFrame:
    """Findings about whole tables, from a frame with ``row_count`` and ``duplicate_rows``."""
    rows, extra = F.col("row_count"), F.col("duplicate_rows")
    share = F.try_divide(extra, rows)
    rules = [
        _issue(rows == 0, "empty_dataset", "error", F.lit("The table has no rows.")),
        _issue((rows > 0) & (extra > 0), "duplicate_rows",
               F.when(share > MANY_DUPLICATES, F.lit("warning")).otherwise("info"),
               F.concat_ws(" ", count_text(extra, "repeated row"), F.lit("dropped, or"),
                           percent_text(share), F.lit("of the table.")),
               duplicate_rows=extra, duplicate_fraction=F.bround(share, 4)),
    ]
    return counts.select(F.explode(F.array_compact(F.array(*rules))).alias("issue")).select(
        "issue.code", "issue.severity", F.lit(None).cast("string").alias("column_name"),
        "issue.message", "issue.details",
    )


def quality_issues(profile: DataFrame, row_count: int, duplicate_rows: int) -> DataFrame:
    """All findings, table-level ones first; ``duplicate_rows`` is 0 when none are dropped."""
    counts = small_frame(
        profile.sparkSession, [(row_count, duplicate_rows)], lt.struct("row_count bigint, duplicate_rows bigint")
    )
    found = table_issues(counts)
    return found.unionByName(column_issues(profile)) if row_count else found


def _score(column_count: int) -> Column:
    if column_count <= 0:
        return F.lit(0)
    weight = F.element_at(
        F.create_map(*[F.lit(x) for item in PENALTIES.items() for x in item]), F.col("severity")
    )
    cost = F.when(F.col("column_name").isNull(), weight).otherwise(weight / column_count)
    left = F.bround(100 - F.coalesce(F.sum(cost), F.lit(0.0)), 0).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), left))


def quality_score(issues: DataFrame, column_count: int) -> DataFrame:
    """One row ``score``: table findings cost their full weight, column findings a share."""
    return issues.agg(F.count("*"), _score(column_count).alias("score")).select("score")


def quality_report(
    issues: DataFrame, column_count: int, raw_rows: int, clean_rows: int
) -> DataFrame:
    """One row: score, findings per severity, rows before, after and removed."""
    return issues.agg(
        F.count("*").alias("issue_count"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in PENALTIES],
        _score(column_count).alias("score"),
    ).withColumns({
        "raw_rows": F.lit(raw_rows).cast("bigint"),
        "clean_rows": F.lit(clean_rows).cast("bigint"),
        "rows_removed": F.lit(raw_rows - clean_rows).cast("bigint"),
    })
