"""Mixing sources to target weights by Poisson replication.

A source's rate is its weight's share of the wanted rows over the rows it has, which is how often
each of its documents should appear on average.  Each document draws its number of copies by
inverting the Poisson distribution of that rate at a point hashed from the seed and its key, is
exploded by it, and all copies are shuffled by a second hash.  Rates above ``PART`` are split
into equal parts with a draw each, so that the distribution's head never underflows.

Sources without a given weight have the default weight; a null source is a source of its own.
Documents are keyed by id and text, so a repeated row draws like its twin but is drawn for by
itself.  Null ids and texts count as empty.  A source with weight 0 leaves no rows, and an empty
table gives none.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm.common import free_name, stored

#: Largest rate that is inverted in one draw.
PART = 16
#: Values of one draw beyond the rate; the tail behind them is below the resolution of a draw.
TAIL = 60
SEED = "mix-1"
_BITS = 48


def unit(*parts: Column) -> Column:
    """A number in [0, 1) of 48 bits, hashed from the given texts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, _BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << _BITS))


def rates(
    docs: DataFrame, source_column: str = "source", weights: Mapping[str, float] | None = None,
    default_weight: float = 1.0, rows: int | None = None,
) -> DataFrame:
    """One row per source: n_docs, rate, parts, and the cumulative distribution of one part."""
    sizes = docs.groupBy(F.col(f"`{source_column}`").cast("string").alias("mix_source")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )
    weight = F.lit(float(default_weight))
    if weights:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(F.element_at(given, F.coalesce("mix_source", F.lit(""))), weight)
    sizes = stored(sizes.withColumn("weight", weight))
    all_weight, all_docs = sizes.agg(F.sum("weight"), F.sum("n_docs")).first()  # two numbers
    wanted = all_docs if rows is None else rows
    share = F.col("weight") / F.lit(all_weight).cast("double")
    rate = share * F.lit(wanted).cast("double") / F.col("n_docs")
    start = F.struct(F.exp(-F.col("part_rate")).alias("p"), F.array(F.exp(-F.col("part_rate"))).alias("cdf"))

    def extend(state, k):
        p = state["p"] * F.col("part_rate") / k
        return F.struct(
            p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf")
        )

    return (
        sizes.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
        .withColumn("part_rate", F.col("rate") / F.col("parts"))
        .withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(PART + TAIL)), start, extend)["cdf"])
        .select("mix_source", "n_docs", "rate", "parts", "cdf")
    )


def mix(
    docs: DataFrame, source_column: str = "source", id_column: str = "doc_id", text_column: str = "text",
    weights: Mapping[str, float] | None = None, default_weight: float = 1.0, rows: int | None = None,
    seed: str = SEED, copy_column: str | None = "copy",
) -> DataFrame:
    """The documents' columns, each row as often as drawn, in shuffled order.

    ``copy_column`` numbers a document's copies from 0; None leaves it out.
    """
    table = stored(rates(docs, source_column, weights, default_weight, rows))
    names = {n: free_name(docs, f"_mix_{n}") for n in ("source", "parts", "cdf", "key", "copy", "place")}
    table = table.select(
        F.col("mix_source").alias(names["source"]), F.col("parts").alias(names["parts"]),
        F.col("cdf").alias(names["cdf"]),
    )
    key = F.md5(F.concat_ws(
        "|", F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")),
    ).cast("binary"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(names["parts"])), F.lit(0),
        lambda total, part: total + F.size(F.filter(
            names["cdf"], lambda edge: unit(F.lit(seed), part.cast("string"), F.col(names["key"])) >= edge
        )),
    )
    copied = (
        docs.withColumn(names["key"], key)
        .join(table, F.col(f"`{source_column}`").cast("string").eqNullSafe(F.col(names["source"])))
        .withColumn(names["copy"], drawn).filter(F.col(names["copy"]) > 0)
        .withColumn(names["copy"], F.explode(F.sequence(F.lit(0), F.col(names["copy"]) - 1)))
    )
    place = F.md5(F.concat_ws(
        "|", F.lit(seed), F.lit("place"), F.col(names["copy"]).cast("string"), F.col(names["key"])
    ).cast("binary"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    shuffled = copied.select(*columns, names["copy"], place.alias(names["place"])).repartition(
        names["place"]
    ).sortWithinPartitions(names["place"])
    if copy_column is None:
        return shuffled.select(*columns)
    return shuffled.select(*columns, F.col(names["copy"]).cast("long").alias(free_name(docs, copy_column)))
