"""Pages of an ordered table without sorting it for each.

An ordered copy is made once: rows are dealt into ranges of the sort columns, sorted in each, and
numbered; the copy is partitioned by range.  With the number of rows per range, a page's ranges are
known beforehand, so a page at any offset reads the one or two ranges that hold it and no other.
Ties in the asked order are broken by all other columns, so pages never overlap; rows that are equal
throughout may stand in for one another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F, types as T

RANGE, PLACE = "range_number", "range_place"
#: Bits of a row's place in its range; Spark numbers rows so.
_PLACE_BITS = 33


def _order(df: DataFrame, order_by: Sequence[str]) -> list[str]:
    unordered = (T.MapType, T.VariantType)
    rest = [f.name for f in df.schema if f.name not in order_by and not isinstance(f.dataType, unordered)]
    return [*order_by, *rest]


def ordered_copy(df: DataFrame, order_by: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with RANGE and PLACE, to be written partitioned by RANGE."""
    order = _order(df, order_by)
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    numbered = dealt.withColumn(PLACE, F.monotonically_increasing_id())
    return numbered.withColumns({
        RANGE: F.shiftright(PLACE, _PLACE_BITS).cast("int"), PLACE: F.col(PLACE).bitwiseAND((1 << _PLACE_BITS) - 1),
    })


@dataclass(frozen=True)
class Pages:
    """A stored ordered copy, and the rows of each range in order."""

    copy: DataFrame
    sizes: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, copy: DataFrame) -> Pages:
        sizes = copy.groupBy(RANGE).agg(F.count("*").alias("n")).collect()  # one row per range
        return cls(copy, tuple(sorted((row[RANGE], row["n"]) for row in sizes)))

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.sizes)

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        limit, offset = max(1, limit), max(0, offset)
        ends = list(accumulate(n for _, n in self.sizes))
        wanted, held = None, []
        for (number, n), end in zip(self.sizes, ends):
            first, last = max(offset, end - n) - (end - n), min(offset + limit, end) - (end - n)
            if first < last:
                held.append(number)
                part = (F.col(RANGE) == number) & F.col(PLACE).between(first, last - 1)
                wanted = part if wanted is None else wanted | part
        if wanted is None:
            return self.copy.drop(RANGE, PLACE).limit(0)
        page = self.copy.where(F.col(RANGE).isin(held)).where(wanted)
        return page.orderBy(RANGE, PLACE).drop(RANGE, PLACE)  # as many rows as the page has
