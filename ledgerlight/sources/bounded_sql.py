"""Ad-hoc SQL from people and tools that are not trusted: one query, few rows, a deadline.

Spark's own parser says what a text is.  Every node of the parsed plan must be of a kind a query is
made of, every relation must be allowed by its full name or be a common table expression in scope,
and functions that call arbitrary Java or name files are refused.  What passes is run as it stands.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator, Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Row, SparkSession

# Fixed values.
DEFAULT_ROWS = 200
MOST_ROWS = 1000
DEADLINE_SECONDS = 20.0

REFUSED_FUNCTIONS = frozenset({"java_method", "reflect", "try_reflect", "read_files", "input_file_name"})
#: Kinds of plan nodes that only ask for data.
QUERY_NODES = frozenset("""
    Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join LateralJoin
    SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedWith WithWindowDefinition Window
    Generate UnresolvedPivot Pivot UnresolvedUnpivot Unpivot Sample UnresolvedHint OneRowRelation$ OneRowRelation
    UnresolvedInlineTable LocalRelation UnresolvedRelation UnresolvedTableValuedFunction UnresolvedTVFAliases
""".split())


class RefusedQuery(ValueError):
    """The text is not a single harmless query over the allowed tables."""


class DeadlineExceeded(TimeoutError):
    """The query ran too long and its jobs were cancelled."""


class BoundedRows(list[Row]):
    """The rows that were fetched; ``cut`` tells whether the query has more."""

    cut = False


def _items(sequence) -> Iterator:
    return (sequence.apply(n) for n in range(sequence.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _check_functions(expression) -> None:
    kind = _kind(expression)
    if kind == "UnresolvedFunction":
        name = list(_items(expression.nameParts()))[-1].lower()
        if name in REFUSED_FUNCTIONS:
            raise RefusedQuery(f"{name} is not permitted")
    elif kind == "ExpressionWithUnresolvedIdentifier":
        raise RefusedQuery("names put together at run time are not permitted")
    for child in _items(expression.children()):
        _check_functions(child)


def _check(plan, allowed: frozenset[str] | None, scope: frozenset[str]) -> None:
    """Refuse what is no query, or reads a relation that is neither allowed nor in scope."""
    kind = _kind(plan)
    if kind not in QUERY_NODES:
        raise RefusedQuery(f"only queries are permitted, not {kind}")
    if kind == "UnresolvedRelation":
        parts = [part.lower() for part in _items(plan.multipartIdentifier())]
        known = len(parts) == 1 and parts[0] in scope
        if not known and (len(parts) > 1 if allowed is None else ".".join(parts) not in allowed):
            raise RefusedQuery(f"unknown table {'.'.join(parts)}")
    if kind == "UnresolvedTableValuedFunction":
        name = list(_items(plan.name()))[-1].lower()
        if name in REFUSED_FUNCTIONS:
            raise RefusedQuery(f"{name} is not permitted")
    if kind == "UnresolvedWith":  # an expression sees those before it, the query sees all
        for relation in _items(plan.cteRelations()):
            _check(relation._2(), allowed, scope)
            scope |= {relation._1().lower()}
    for expression in _items(plan.expressions()):
        _check_functions(expression)
    for inner in (plan.children(), plan.subqueries()):
        for child in _items(inner):
            _check(child, allowed, scope)


def _body(text: str) -> str:
    """The statement itself: a surrounding Markdown fence is not part of it."""
    lines = text.strip().splitlines()
    if len(lines) > 2 and lines[0].startswith("```") and lines[-1].strip() == "```":
        lines = lines[1:-1]
    return "\n".join(lines).rstrip("; \n\t")


def _bounded(
    spark: SparkSession, text: str, allowed: Iterable[str] | None, tables: Mapping[str, DataFrame] | None
) -> tuple[DataFrame, int]:
    body = _body(text)
    if not body:
        raise RefusedQuery("the query is empty")
    if allowed is None and tables is not None:
        allowed = list(tables)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
        _check(plan, None if allowed is None else frozenset(name.lower() for name in allowed), frozenset())
        rows = DEFAULT_ROWS
        if _kind(plan) == "GlobalLimit" and _kind(plan.limitExpr()) == "Literal":
            rows = min(int(plan.limitExpr().toString()), MOST_ROWS)
        if not tables:
            return spark.sql(body), rows
        # The frames get names of their own for the moment of analysis; the text sees them as expressions.
        views = {name: f"bounded_{uuid.uuid4().hex}" for name in tables}
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        try:
            named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
            return spark.sql(f"WITH {named} SELECT * FROM (\n{body}\n)"), rows
        finally:
            for view in views.values():
                spark.catalog.dropTempView(view)
    except (ParseException, AnalysisException) as problem:
        raise RefusedQuery(str(problem).splitlines()[0]) from problem


def bounded_select(
    spark: SparkSession,
    text: str,
    allowed: Iterable[str] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Lazy result of one query, limited to ``DEFAULT_ROWS`` or its own limit, at most ``MOST_ROWS``.

    ``tables`` are seen under their names by this query alone.  ``run_bounded`` also tells
    whether rows are missing.
    """
    frame, rows = _bounded(spark, text, allowed, tables)
    return frame.limit(rows)


def run_bounded(
    spark: SparkSession, text: str, seconds: float = DEADLINE_SECONDS,
    allowed: Iterable[str] | None = None, tables: Mapping[str, DataFrame] | None = None,
) -> BoundedRows:
    """The rows, cancelled on the cluster once ``seconds`` have passed.

    The caller is released at once; tasks stop at their next check, so clusters should also
    set ``spark.task.reaper.enabled`` to be rid of tasks caught in a tight loop.
    """
    frame, most = _bounded(spark, text, allowed, tables)
    context, tag = spark.sparkContext, f"bounded-{uuid.uuid4().hex}"
    expired = threading.Event()

    def cancel() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    context.addJobTag(tag)
    timer.start()
    try:
        rows = BoundedRows(frame.limit(most + 1).collect())
    except Exception as problem:
        if expired.is_set():
            raise DeadlineExceeded(f"stopped after {seconds:g} seconds") from problem
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    rows.cut = len(rows) > most
    del rows[most:]
    return rows
