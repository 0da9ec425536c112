"""Records of delimited text as rows, however many lines a quoted cell spans, on all cores.

Spark splits a text file into byte ranges of whole lines, but only what came before a range tells
whether it begins inside quotes.  Reading such a file in one task avoids the question; here it is
answered by a prefix scan.  A line takes the reader from one of two states, at a record's start or
inside quotes, to one of them.  So does a range, and ranges compose:

1. every range runs its lines that hold a quote from both states, and gives both outcomes;
2. the outcomes are composed in file order, one row per range with quotes, on the driver;
3. every range, now knowing its state, puts the lines of its records together.  Only a record that
   runs beyond its range is left in pieces, which are put together by a shuffle of those pieces.

A quote opens a cell at its start only, two in a row within one stand for a quote, and what follows a
closing quote up to the separator is plain text; so ``5" pipe`` opens nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

QUOTE = '"'
_RANGE = ("file", "begin")


class RangesChanged(RuntimeError):
    """Spark cut the files into other ranges than a moment before; reading again helps."""


def ends_inside(line: str, separator: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of ``line``, which began ``inside`` one or not."""
    place, opening = 0, separator + QUOTE
    if not inside:
        if line.startswith(QUOTE):
            place = 1
        else:
            place = line.find(opening) + 2
            if place == 1:
                return False
    while True:
        close = line.find(QUOTE, place)
        if close < 0:
            return True
        if line.startswith(QUOTE, close + 1):
            place = close + 2
            continue
        place = line.find(opening, close + 1) + 2
        if place == 1:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, begin: lines in order within each range; carriage returns stay where they are."""
    reader = spark.read
    first = reader.option("lineSep", "\n").text(path).head(1)
    if not first or "\r" not in first[0]["value"][:-1]:  # else lines end with carriage returns alone
        reader = reader.option("lineSep", "\n")
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")
    )


def _outcomes(lines: DataFrame, separator: str) -> list:
    """Per range with quotes, for either state at its beginning: the state at its end, and what came by.

    ``breaks`` tells whether a line ended inside quotes, ``closed`` whether one ended outside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for line, *key in zip(*(column.to_pylist() for column in batch.columns)):
                state = found.setdefault(tuple(key), [False, True, False, False])
                state[0] = ends_inside(line, separator, state[0])
                state[1] = ends_inside(line, separator, state[1])
                state[2] = state[2] or state[0]
                state[3] = state[3] or not state[1]
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
            *(pa.array([state[n] for state in found.values()], pa.bool_()) for n in range(4)),
        ], [*_RANGE, "from_start", "from_inside", "breaks", "closed"])

    quoted = lines.where(F.contains("value", F.lit(QUOTE)))
    return quoted.mapInArrow(
        run, "file string, begin long, from_start boolean, from_inside boolean, breaks boolean, closed boolean"
    ).collect()  # one row per range with quotes


class States:
    """Of every range: whether it begins inside quotes, and in which range that record began."""

    def __init__(self, outcomes: list) -> None:
        by_file = defaultdict(list)
        #: Whether any record goes on after a line break.
        self.broken = any(row["breaks"] for row in outcomes)
        for row in outcomes:
            by_file[row["file"]].append(row)
        #: Per file: range beginnings, and (inside, opener) at the end of each.
        self.files: dict[str, tuple[list[int], list[tuple[bool, int]]]] = {}
        for file, rows in by_file.items():
            rows.sort(key=lambda r: r["begin"])
            ends, inside, opener = [], False, 0
            for row in rows:
                if not inside or row["closed"]:
                    began = row["begin"]
                else:
                    began = opener
                inside, opener = (row["from_inside"] if inside else row["from_start"]), began
                ends.append((inside, opener))
            self.files[file] = ([r["begin"] for r in rows], ends)

    @property
    def any_piece(self) -> bool:
        return any(inside for _, ends in self.files.values() for inside, _ in ends)

    def at(self, file: str, begin: int) -> tuple[bool, int]:
        begins, ends = self.files.get(file, ((), ()))
        before = bisect_left(begins, begin)
        return ends[before - 1] if before else (False, 0)

    def known(self, file: str, begin: int) -> bool:
        begins, _ = self.files.get(file, ((), ()))
        place = bisect_left(begins, begin)
        return place < len(begins) and begins[place] == begin


def _assembled(lines: DataFrame, states: States, separator: str) -> DataFrame:
    """value, header, and for pieces of records beyond one range: file, opener, begin.

    ``header`` marks the first record of a file.
    """
    shared = lines.sparkSession.sparkContext.broadcast(states)  # one entry per range with quotes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = shared.value
        now, inside, opener, held, header = None, False, 0, [], False
        out: list[list] = [[] for _ in range(5)]

        def give(value, opener=None):
            nonlocal header
            if opener is None:
                value = value.removesuffix("\r")
                if not value.strip():
                    return
            for column, item in zip(out, (value, header, *((now[0], opener, now[1]) if opener is not None else (None,) * 3))):
                column.append(item)
            header = False

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64()))],
                ["value", "header", "file", "opener", "begin"],
            )
            for column in out:
                column.clear()
            return batch

        def close():
            """The range has ended; what is held goes on in the next one."""
            if held:
                give("\n".join(held), opener)
                held.clear()

        def plain(values):
            """Lines that are records, as they came."""
            values = pc.replace_substring_regex(values, "\r$", "")
            values = values.filter(pc.not_equal(pc.utf8_trim_whitespace(values), ""))
            nothing = [pa.nulls(len(values), kind) for kind in (pa.string(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays(
                [values, pa.array([False] * len(values), pa.bool_()), *nothing], ["value", "header", "file", "opener", "begin"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [(batch.column(1)[n].as_py(), batch.column(2)[n].as_py()) for n in (0, -1)]
            if now == ends[0] == ends[1] and not inside and not header and not pc.any(
                pc.match_substring(batch.column(0), QUOTE)
            ).as_py():
                yield plain(batch.column(0))
                continue
            values, quoted = batch.column(0), pc.match_substring(batch.column(0), QUOTE).to_pylist()
            files, begins = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for line, has_quote, *key in zip(values.to_pylist(), quoted, files, begins):
                if now is None or now[1] != key[1] or now[0] != key[0]:
                    close()
                    now = tuple(key)
                    inside, opener = states.at(*now)
                    header = now[1] == 0
                if has_quote:
                    if not states.known(*now):
                        raise RangesChanged(f"{now[0]} was cut into other ranges; read it again")
                    begun = inside
                    inside = ends_inside(line, separator, inside)
                    if not begun and not inside:
                        give(line)
                        continue
                    if not begun:
                        opener = now[1]
                    held.append(line)
                    if not inside:
                        whole = "\n".join(held)
                        held.clear()
                        give(whole, opener if opener != now[1] else None)
                elif inside:
                    held.append(line)
                else:
                    give(line)
            if out[0]:
                yield flush()
        close()
        if out[0]:
            yield flush()

    return lines.mapInArrow(run, "value string, header boolean, file string, opener long, begin long")


def broken_records(spark: SparkSession, path: str, separator: str) -> DataFrame | None:
    """One row ``value`` per record, without blank lines and without each file's first record.

    None if no record of ``path`` has a line break: then every line is a record.
    """
    lines = _lines(spark, path)
    states = States(_outcomes(lines, separator))
    if not states.broken:
        return None
    parts = _assembled(lines, states, separator)
    whole = parts.where(F.col("opener").isNull() & ~F.col("header")).select("value")
    if not states.any_piece:
        return whole
    joined = (
        parts.where(F.col("opener").isNotNull()).groupBy("file", "opener")
        .agg(F.sort_array(F.collect_list(F.struct("begin", "value"))).alias("pieces"), F.max("header").alias("header"))
        .where(~F.col("header")).select(F.array_join("pieces.value", "\n").alias("value"))
    )
    return whole.union(joined.select(F.regexp_replace("value", "\r$", "").alias("value")))
