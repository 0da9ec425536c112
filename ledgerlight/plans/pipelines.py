"""The end-to-end jobs: file to clean table, clean table to metrics, tables to a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.operators import relationships
from ledgerlight.operators.cleaning import audit, clean, plan_cleaning
from ledgerlight.operators.metrics import kpis
from ledgerlight.operators.profile import profile, survey
from ledgerlight.operators.quality import quality_issues, quality_report
from ledgerlight.operators.semantics import Shape, resolve, shape_of
from ledgerlight.sources.delimited import read_delimited
from ledgerlight.sources.naming import table_slug
from ledgerlight.session import small_frame
from ledgerlight.sources.warehouse import CLEAN, META, RAW, Warehouse
from ledgerlight.types import struct


@dataclass(frozen=True)
class Cleaned:
    """A cleaned table, what was changed and what was found."""

    table: DataFrame
    raw_profile: DataFrame
    profile: DataFrame
    actions: DataFrame
    issues: DataFrame
    report: DataFrame


@dataclass(frozen=True)
class Analysed:
    semantics: DataFrame
    shape: Shape
    kpis: DataFrame


def _rows(profile_rows: DataFrame, df: DataFrame) -> int:
    first = profile_rows.first()
    return first["row_count"] if first else df.count()


def clean_table(warehouse: Warehouse, table: str, deduplicate: bool = True) -> Cleaned:
    """Profile the raw table, clean it in one pass, store and profile the result.

    Findings describe the raw table; the profile that is kept describes the clean one.
    """
    raw = warehouse.read(RAW, table)
    before, duplicates = survey(raw, table, RAW, duplicates=deduplicate)
    rows = _rows(before, raw)
    plan = plan_cleaning(before, duplicates, deduplicate)
    stored = warehouse.write(CLEAN, table, clean(raw, plan))
    after = warehouse.keep(f"{table}_profile", profile(stored, table, CLEAN))
    issues = warehouse.keep(f"{table}_issues", quality_issues(before, rows, duplicates))
    report = quality_report(issues, len(raw.columns), rows, _rows(after, stored))
    return Cleaned(stored, before, after, audit(plan), issues, report)


def analyse_table(warehouse: Warehouse, table: str, profile_rows: DataFrame | None = None) -> Analysed:
    """Classify a clean table and compute every metric it supports.

    Roles that are kept, corrected by a user or not, are used where column and type still fit.
    """
    df = warehouse.read(CLEAN, table)
    rows = profile(df, table, CLEAN, base_only=True) if profile_rows is None else profile_rows
    semantics = warehouse.keep(f"{table}_roles", resolve(rows, warehouse.kept(f"{table}_roles")))
    shape = shape_of(semantics)
    found = warehouse.keep(f"{table}_metrics", kpis(df, shape, warehouse.name(CLEAN, table)))
    return Analysed(semantics, shape, found)


def ingest(
    spark: SparkSession, warehouse: Warehouse, path: str, table: str | None = None, one_task: bool = False
) -> str:
    """Store a delimited file as a raw table; repeating it replaces the table."""
    name = table or table_slug(path)
    warehouse.write(RAW, name, read_delimited(spark, path, one_task))
    return name


def run_pipeline(
    spark: SparkSession,
    path: str,
    table: str | None = None,
    deduplicate: bool = True,
    location: str | None = None,
    one_task: bool = False,
) -> tuple[Cleaned, Analysed]:
    """File to raw table, clean table, semantics and metrics."""
    warehouse = Warehouse(spark, location)
    name = ingest(spark, warehouse, path, table, one_task)
    cleaned = clean_table(warehouse, name, deduplicate)
    return cleaned, analyse_table(warehouse, name, cleaned.profile)


def current_index(warehouse: Warehouse, tables: Sequence[str], name: str = "model") -> relationships.ValueIndex:
    """The kept value index of clean tables; only tables written since are read.

    What is kept names the versions it was made from, its own among them, so that an update that broke
    off in the middle is noticed, and the index made anew.
    """
    values, columns, made = (f"{name}_{part}" for part in ("values", "columns", "versions"))
    now = {t: warehouse.version(CLEAN, t) for t in tables}
    kept = warehouse.kept(made)
    then = {row["table"]: row["version"] for row in kept.collect()} if kept is not None else {}
    known = None
    if then and all(then.pop(f"meta.{part}", None) == warehouse.version(META, part) for part in (values, columns)):
        known = relationships.ValueIndex(warehouse.kept(columns), warehouse.kept(values))
        if then == now:
            return known
    changed = [t for t in tables if known is None or then.get(t) != now[t]]
    index = relationships.index_values({t: warehouse.read(CLEAN, t) for t in tables}, known, changed)
    index = relationships.ValueIndex(
        warehouse.keep(columns, index.columns), warehouse.write(META, values, index.presence)
    )
    now |= {f"meta.{part}": warehouse.version(META, part) for part in (values, columns)}
    warehouse.keep(made, small_frame(warehouse.spark, now.items(), struct("table string, version string")))
    return index


def propose_model(
    warehouse: Warehouse, tables: Sequence[str], known: DataFrame | None = None, name: str = "model"
) -> DataFrame:
    """Proposed relationships among clean tables, merged into those known or kept, and kept.

    Decisions taken on an edge stay; ``decide_model`` takes them.
    """
    if len(tables) < 2:
        raise ValueError("relationship detection needs at least two tables")
    found = relationships.propose(current_index(warehouse, tables, name))
    known = warehouse.kept(f"{name}_edges") if known is None else known
    merged = found if known is None else relationships.merge_decisions(known, found)
    return warehouse.keep(f"{name}_edges", merged).orderBy(F.desc("confidence"))


def decide_model(warehouse: Warehouse, decisions: Mapping[tuple[str, str, str, str], bool], name: str = "model") -> DataFrame:
    """Confirm or reject kept edges."""
    edges = warehouse.kept(f"{name}_edges")
    if edges is None:
        raise LookupError(f"no edges are kept for {name}")
    return warehouse.keep(f"{name}_edges", relationships.decide(edges, decisions))


def build_model(warehouse: Warehouse, tables: Sequence[str], edges: DataFrame) -> list[str]:
    """Star views from the confirmed edges; returns the fact tables."""
    return warehouse.rebuild_stars(tables, edges)
