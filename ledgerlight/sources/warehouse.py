"""Catalog tables in three databases: raw, clean and star."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlight.operators.star import star_sql
from ledgerlight.session import small_frame
from ledgerlight.sources.naming import identifier
from ledgerlight.sources.pages import RANGE, Pages, ordered_copy

RAW, CLEAN, STAR, META = "raw", "clean", "star", "meta"


#: Results kept per table.
RESULTS = ("profile", "issues", "roles", "metrics", "pages", "paged")
_PAGED = T.StructType([
    T.StructField("place", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("sizes", T.ArrayType(T.LongType())),
])


def preview(
    df: DataFrame, limit: int = 50, offset: int = 0, order_by: Sequence[str] = ()
) -> DataFrame:
    """A page of rows; give ``order_by`` to make pages repeatable."""
    page = df.orderBy(*order_by) if order_by else df
    return page.offset(max(0, offset)).limit(max(1, limit))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, rows`` for several tables in one job; each scan reads no column."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    result = counts[0]
    for frame in counts[1:]:
        result = result.unionByName(frame)
    return result


class Warehouse:
    """Tables of one workspace, named ``raw.x``, ``clean.x`` and ``star.x``; ``meta.x`` has results.

    A table is a view of its current version.  Writing makes a new version and then lets the view name
    it, in one catalog operation: a load that fails or is killed before leaves the old rows in place,
    readers see one version or the other, and repeating a load changes nothing.  The old version is
    dropped after the switch.
    """

    def __init__(self, spark: SparkSession, location: str | None = None):
        """``location`` stores the versions in that folder instead of the catalog's own."""
        self.spark = spark
        self.versions = "versions"
        for database in (RAW, CLEAN, STAR, META):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        if location:
            self.versions += "_" + hashlib.sha256(location.encode()).hexdigest()[:16]
        at = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.versions}{at}")

    def name(self, layer: str, table: str) -> str:
        return f"{identifier(layer)}.{identifier(table)}"

    def write(self, layer: str, table: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        for column in df.columns:
            identifier(column)
        name, version = self.name(layer, table), f"{self.versions}.{layer}_{uuid.uuid4().hex}"
        df.write.saveAsTable(version, partitionBy=list(partition_by) or None, compression="zstd")
        self._switch(name, version)
        return self.read(layer, table)

    def _switch(self, name: str, version: str) -> None:
        old = self._version(name)
        if old is None and self.spark.catalog.tableExists(name):  # from before tables had versions
            self.spark.sql(f"DROP TABLE {name}")
        self.spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('version' = '{version}') AS SELECT * FROM {version}")
        if old:
            self.spark.sql(f"DROP TABLE IF EXISTS {old}")

    def _version(self, name: str) -> str | None:
        if not self.spark.catalog.tableExists(name):
            return None
        found = {row["key"]: row["value"] for row in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        return found.get("version")

    def version(self, layer: str, table: str) -> str | None:
        """What names the rows that a table holds now: another write, another version."""
        return self._version(self.name(layer, table))

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(layer, table))

    def keep(self, table: str, results: DataFrame) -> DataFrame:
        """Replace a small set of results (one row per column, edge or metric) as a whole.

        The rows pass through the driver, so a set may be made from its former self.
        """
        return self.write(META, table, small_frame(self.spark, results.collect(), results.schema))

    def kept(self, table: str) -> DataFrame | None:
        return self.read(META, table) if self.exists(META, table) else None

    def exists(self, layer: str, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(layer, table))

    def layer_of(self, table: str, wanted: str | None = None) -> str:
        """``wanted`` if given, else the cleaned table where there is one."""
        layer = wanted or (CLEAN if self.exists(CLEAN, table) else RAW)
        if not self.exists(layer, table):
            raise LookupError(f"{table} has no {layer} table yet")
        return layer

    def preview(
        self, table: str, layer: str | None = None, limit: int = 50, offset: int = 0, order_by: Sequence[str] = ()
    ) -> DataFrame:
        """A page of a table; with ``order_by`` from an ordered copy, which is made at the first page."""
        layer = self.layer_of(table, layer)
        if not order_by:
            return preview(self.read(layer, table), limit, offset)
        return self.pages(layer, table, order_by).page(limit, offset)

    def pages(self, layer: str, table: str, order_by: Sequence[str]) -> Pages:
        """The table's ordered copy, made anew when the table or the order has changed."""
        copy, made = f"{table}_pages", f"{table}_paged"
        now = [self.version(layer, table), *order_by]
        kept = self.kept(made)
        if kept is not None:
            rows = kept.orderBy("place").collect()
            if [r["name"] for r in rows] == [*now, self.version(META, copy)]:
                return Pages(self.kept(copy), tuple((n, size) for n, size in enumerate(rows[0]["sizes"]) if size))
        stored = self.write(META, copy, ordered_copy(self.read(layer, table), order_by), [RANGE])
        pages = Pages.of(stored)
        sizes = dict(pages.sizes)
        counts = [sizes.get(n, 0) for n in range(max(sizes, default=-1) + 1)]
        names = [*now, self.version(META, copy)]
        self.keep(made, small_frame(
            self.spark, [(place, name, counts) for place, name in enumerate(names)], _PAGED
        ))
        return pages

    def row_count(self, layer: str, table: str) -> int:
        return self.read(layer, table).count()

    def drop(self, table: str) -> None:
        """Remove a table from every layer, with its star view and results."""
        self.spark.sql(f"DROP VIEW IF EXISTS {self.name(STAR, table)}")
        results = [(META, f"{table}_{part}") for part in RESULTS]
        for name in [self.name(*pair) for pair in ((RAW, table), (CLEAN, table), *results)]:
            version = self._version(name)
            self.spark.sql(f"DROP VIEW IF EXISTS {name}")
            if version:
                self.spark.sql(f"DROP TABLE IF EXISTS {version}")

    def query(self, sql: str, **parameters: Any) -> DataFrame:
        """Trusted SQL with ``:name`` parameters."""
        return self.spark.sql(sql, args=parameters)

    def tables(self, layer: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(layer) if not t.isTemporary)

    def rebuild_stars(self, tables: Iterable[str], edges: DataFrame) -> list[str]:
        """Create the star view of every fact and drop the view of every former fact."""
        tables = list(tables)
        columns = {t: self.read(CLEAN, t).columns for t in tables}
        facts = {r[0] for r in edges.where("confirmed").select("from_table").distinct().collect()}
        for table in tables:
            view = self.name(STAR, table)
            if table in facts:
                self.spark.sql(f"CREATE OR REPLACE VIEW {view} AS {star_sql(table, columns, edges, CLEAN)}")
            else:
                self.spark.sql(f"DROP VIEW IF EXISTS {view}")
        return sorted(facts & set(tables))

    def target(self, table: str) -> str:
        """What an analytical query should read: the star view if there is one."""
        return self.name(STAR if self.exists(STAR, table) else CLEAN, table)
