"""Foreign keys between tables, proposed from value containment.

A value index groups every distinct key value of all tables once, with a bit mask of the columns that
hold it.  Distinct counts of columns and the containment of every pair of columns are conditional
counts over those masks.  No pair of rows is ever emitted, and a value that fills a third of a table
is folded before the shuffle.  An index can be kept: when a table changes, that table alone is read,
its bits are cleared in the kept index, and its new values are merged in.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import batched, count

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerlight import types as lt
from ledgerlight.functions.numbers import percent_text
from ledgerlight.operators.cells import KEY, TYPES, cells
from ledgerlight.operators.profile import base_profile, column_types
from ledgerlight.operators.semantics import DIMENSION, IDENTIFIER, KEY_ENDING, may_be_key, with_meaning
from ledgerlight.session import small_frame, stored

# What counts as evidence.
LEAST_CONTAINMENT = 0.80
LEAST_TARGET_VALUES = 2
LEAST_ROWS = 3
FEW_TARGET_VALUES = 5
NAME_BONUS = 0.05

BITS = 62
PAIRS_PER_SCAN = 500
EDGE = ["from_table", "from_column", "to_table", "to_column"]
_FAMILY = {t: lt.type_family(t) for t in (
    lt.STRING, lt.INTEGER, lt.DECIMAL, lt.BOOLEAN, lt.DATE, lt.TIMESTAMP, lt.UNKNOWN,
)}


@dataclass(frozen=True)
class ValueIndex:
    """``columns``: base profile, role, family and ``slot`` (bit) of every key column.

    ``presence``: one row per distinct key value of a family, with words of 62 column bits.
    """

    columns: DataFrame
    presence: DataFrame

    def words(self) -> list[str]:
        return [c for c in self.presence.columns if c not in ("family", *KEY)]


COLUMNS = T.StructType([*(f for f in lt.PROFILE if f.name in (
    "table", "layer", "position", "column", "data_type", "row_count", "null_count", "distinct_count",
)), T.StructField("slot", T.IntegerType())])


def _holds(slot: int) -> Column:
    return F.col(f"w{slot // BITS}").bitwiseAND(F.lit(1 << slot % BITS)) != 0


def _comparable(df: DataFrame) -> DataFrame:
    """Zoned timestamps as wall-clock ones, so that they compare with dates."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def _counts(tables: Mapping[str, DataFrame], columns: Mapping[str, list[str]]) -> dict[str, tuple[int, list[int]]]:
    """Rows, and non-null values per key column, of every table; one job without a shuffle of rows."""
    parts = [
        df.agg(F.count("*").alias("rows"), F.array(*[F.count(f"`{c}`") for c in columns[name]]).cast("array<bigint>").alias("present"))
        .select(F.lit(name).alias("table"), "rows", "present")
        for name, df in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).collect() if parts else []
    return {row["table"]: (row["rows"], row["present"]) for row in rows}


def index_values(
    tables: Mapping[str, DataFrame], known: ValueIndex | None = None, changed: Iterable[str] | None = None
) -> ValueIndex:
    """The value index of ``tables``; of an index ``known`` only the tables ``changed`` are read again."""
    fresh = set(tables) if known is None or changed is None else set(changed) & set(tables)
    rows = [] if known is None else [row.asDict() for row in known.columns.collect()]
    stay = [row for row in rows if row["table"] in tables and row["table"] not in fresh]
    fresh |= set(tables) - {row["table"] for row in rows}
    if known is not None and not (fresh & set(tables)) and len(stay) == len(rows):
        return known

    kinds = {t: column_types(tables[t]) for t in sorted(fresh)}
    keys = {t: [c for c, kind in kinds[t].items() if may_be_key(c, kind)] for t in kinds}
    used = {row["slot"] for row in stay}
    free = (slot for slot in count() if slot not in used)
    slots = {(t, c): next(free) for t in keys for c in keys[t]}
    width = max([-1, *used, *slots.values()]) // BITS + 1
    words = [f"w{w}" for w in range(width)]

    zero = F.lit(0).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot") % BITS)
    parts = []
    for t, names in keys.items():
        if names:
            families = F.create_map(*[x for c in names for x in (F.lit(slots[t, c]), F.lit(_FAMILY[kinds[t][c]]))])
            listed = cells(_comparable(tables[t].select(*[f"`{c}`" for c in names])), [(slots[t, c], c) for c in names])
            parts.append(listed.select(families[F.col("slot")].alias("family"), *KEY, *[
                F.when(F.floor(F.col("slot") / BITS) == w, bit).otherwise(zero).alias(word) for w, word in enumerate(words)
            ]))
    if stay:
        gone = [row["slot"] for row in rows if row not in stay]
        kept = [sum(1 << slot % BITS for slot in gone if slot // BITS == w) for w in range(width)]
        parts.append(known.presence.select("family", *KEY, *[
            (F.col(word).bitwiseAND(~kept[w]) if word in known.words() else zero).alias(word) for w, word in enumerate(words)
        ]))
    spark = next(iter(tables.values())).sparkSession
    if not parts:
        fields = [("family", "string"), *((k, TYPES[k]) for k in KEY), ("w0", "bigint")]
        presence = spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in fields))
    else:
        merged = reduce(DataFrame.unionByName, parts).groupBy("family", *KEY).agg(*[F.bit_or(w).alias(w) for w in words])
        presence = stored(merged.where(reduce(lambda a, b: a | b, [F.col(w) != 0 for w in words])))

    counts = _counts({t: tables[t] for t in keys}, keys)
    distinct = {}
    for batch in batched(slots.values(), PAIRS_PER_SCAN):
        found = presence.agg(*[F.count_if(_holds(slot)).alias(f"s{slot}") for slot in batch]).first()
        distinct.update(zip(batch, found))
    described = [
        {"table": t, "layer": "clean", "position": position, "column": c, "data_type": kinds[t][c],
         "row_count": counts[t][0], "null_count": counts[t][0] - counts[t][1][position],
         "distinct_count": distinct[slots[t, c]], "slot": slots[t, c]}
        for t in keys for position, c in enumerate(keys[t])
    ]
    order = sorted([*stay, *described], key=lambda row: (row["table"], row["position"]))
    return ValueIndex(small_frame(spark, [[row[n] for n in COLUMNS.names] for row in order], COLUMNS), presence)


def describe(index: ValueIndex) -> DataFrame:
    """Base profile with role, for every column that could take part in a relationship."""
    return with_meaning(base_profile(index.columns))


def candidate_pairs(columns: DataFrame) -> DataFrame:
    """Pairs worth measuring: same type family, other table, and a target that is a key.

    A source with far more values than the target cannot reach the containment asked for,
    so such pairs are dropped before any data is read.
    """
    family = reduce(
        lambda chain, item: chain.when(F.col("data_type") == item[0], F.lit(item[1])),
        _FAMILY.items(), F.when(F.lit(False), F.lit("")),
    )
    usable = columns.where(
        F.col("role").isin(IDENTIFIER, DIMENSION) & (F.col("row_count") >= LEAST_ROWS)
    ).withColumn("family", family).where(F.col("family") != "other")
    source = usable.select(
        "family", F.col("table").alias("from_table"), F.col("column").alias("from_column"),
        F.col("distinct_count").alias("from_distinct"),
    ).where(F.col("from_distinct") > 0)
    target = usable.where(
        (F.col("distinct_count") >= LEAST_TARGET_VALUES)
        & (F.col("distinct_count") == F.col("row_count") - F.col("null_count"))
    ).select(
        "family", F.col("table").alias("to_table"), F.col("column").alias("to_column"),
        F.col("distinct_count").alias("to_distinct"),
    )
    return source.join(target, "family").where(
        (F.col("from_table") != F.col("to_table"))
        & (F.col("to_distinct") / F.col("from_distinct") >= LEAST_CONTAINMENT)
    )


def measure_containment(index: ValueIndex, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``containment``: share of the source's distinct values found in the target."""
    wanted = pairs.orderBy(*EDGE).collect()
    schema = T.StructType(pairs.schema.fields + [T.StructField("containment", T.DoubleType())])
    slots = {(row["table"], row["column"]): row["slot"] for row in index.columns.collect()}
    rows = []
    for batch in batched(wanted, PAIRS_PER_SCAN):
        counted = index.presence.agg(*[
            F.struct(
                F.count_if(_holds(slots[p.from_table, p.from_column])).alias("all"),
                F.count_if(
                    _holds(slots[p.from_table, p.from_column]) & _holds(slots[p.to_table, p.to_column])
                ).alias("found"),
            )
            for p in batch
        ]).first()
        rows += [(*p, n["found"] / n["all"] if n["all"] else 0.0) for p, n in zip(batch, counted)]
    return small_frame(pairs.sparkSession, rows, schema)


def names_agree(from_column: Column, to_table: Column, to_column: Column) -> Column:
    """Same name, same stem, or a stem that is the target table's name in the singular."""
    source, table, target = map(F.lower, (from_column, to_table, to_column))
    stem = lambda name: F.regexp_replace(name, KEY_ENDING, "")
    singular = (
        F.when(table.endswith("ies"), F.regexp_replace(table, "ies$", "y"))
        .when(table.endswith("s") & ~table.endswith("ss"), F.regexp_replace(table, "s$", ""))
        .otherwise(table)
    )
    return (source == target) | (
        (stem(source) != "")
        & ((stem(source) == stem(target)) | ((stem(source) == singular) & target.rlike(KEY_ENDING)))
    )


def accept(measured: DataFrame) -> DataFrame:
    """Edges (schema ``types.EDGES``): enough containment, best target per source column."""
    share = F.col("containment")
    agreed = names_agree(F.col("from_column"), F.col("to_table"), F.col("to_column"))
    why = F.concat(
        percent_text(share), F.lit(" of the values of "), F.concat_ws(".", "from_table", "from_column"),
        F.lit(" are among the "), F.col("to_distinct").cast("string"), F.lit(" of "),
        F.concat_ws(".", "to_table", "to_column"),
        F.when(F.col("name_match"), F.lit(", and the names agree")).otherwise(F.lit("")),
        F.when(share < 1, F.concat(F.lit("; "), percent_text(1 - share), F.lit(" have no match")))
        .otherwise(F.lit("")), F.lit("."),
    )
    score = F.bround(F.col("shown") + F.when(F.col("name_match"), NAME_BONUS).otherwise(0.0), 4)
    kept = (
        measured.withColumn("name_match", agreed)
        .where((share >= LEAST_CONTAINMENT) & ((F.col("to_distinct") >= FEW_TARGET_VALUES) | F.col("name_match")))
        .withColumn("rationale", why)
        .withColumn("shown", F.bround(share, 4))
        .withColumn("confidence", F.least(F.lit(1.0), score))
    )
    best = Window.partitionBy("from_table", "from_column").orderBy(
        F.desc("confidence"), F.desc("name_match"), "to_table", "to_column"
    )
    return (
        kept.withColumn("place", F.row_number().over(best))
        .where(F.col("place") == 1)
        .select(
            *EDGE, F.col("shown").alias("containment"), "confidence",
            F.col("to_distinct").alias("distinct_values"), "name_match", "rationale",
            F.lit(None).cast("boolean").alias("confirmed"),
        )
        .orderBy("from_table", F.desc("confidence"), "from_column")
    )


def detect(tables: Mapping[str, DataFrame], index: ValueIndex | None = None) -> DataFrame:
    """Propose foreign keys among ``tables``; ``index`` is their value index if known."""
    if len(tables) < 2:
        raise ValueError("relationship detection needs at least two tables")
    return propose(index_values(tables) if index is None else index)


def propose(index: ValueIndex) -> DataFrame:
    """Edges from a value index alone."""
    return accept(measure_containment(index, candidate_pairs(describe(index))))


def merge_decisions(known: DataFrame, found: DataFrame) -> DataFrame:
    """Refresh evidence on known edges, add new ones, keep every decision already taken."""
    pick = lambda name: F.coalesce(F.col(f"f.{name}"), F.col(f"k.{name}")).alias(name)
    same = [F.col(f"k.{c}") == F.col(f"f.{c}") for c in EDGE]
    return (
        known.alias("k").join(found.alias("f"), same, "full_outer")
        .select(*[F.col("k.confirmed") if n == "confirmed" else pick(n) for n in lt.EDGES.fieldNames()])
        .orderBy(F.desc("confidence"), *EDGE)
    )


def decide(edges: DataFrame, decisions: Mapping[tuple[str, str, str, str], bool]) -> DataFrame:
    """Set ``confirmed`` for the edges named by ``(from table, column, to table, column)``."""
    unknown = set(decisions) - {tuple(row) for row in edges.select(*EDGE).collect()}
    if unknown:
        raise ValueError(f"no such relationship: {sorted(unknown)}")
    confirmed = F.col("confirmed")
    for edge, answer in decisions.items():
        same = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(EDGE, edge)])
        confirmed = F.when(same, F.lit(answer)).otherwise(confirmed)
    return edges.withColumn("confirmed", confirmed)
