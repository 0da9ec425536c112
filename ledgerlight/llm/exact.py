"""Exact deduplication by a Grace hash join of the corpus with itself.

Texts are equal when identical after deleting white space.  Each map task first folds its own
rows in a hash table, so that a text filling a third of the corpus leaves a task once.  The
shuffle is the first partitioning; a task whose bucket outgrows its table keeps partitioning
to spill files, one digest byte per level, until every bucket fits.  The table probes openly
and compares complete contents; the digest only chooses slots, files and partitions.

Of equal texts the row with the most code points stays, then the one with the smallest id
(null ids last); of rows equal even in that, one.  Null text counts as empty, and empty texts
are equal to each other.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import WHITE, free_name, stored, text_of

#: Bytes of distinct contents one table may hold before a task partitions further.
TABLE_BYTES = 48 << 20
FANOUT = 16
_DELETED = b" \t\n\x0b\x0c\r"
_CLASSES = "digest string, content binary, group_size long, length long, id long, ties long"
_NO_ID = 1 << 63  # after every id


class ContentTable:
    """Open addressing with linear probing; an entry is (content, size, length, id, ties)."""

    def __init__(self) -> None:
        self.slots, self.entries, self.bytes = [-1] * 1024, [], 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        """The slot that holds ``content``, or the free one where it belongs."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (entry := self.slots[at]) >= 0:
            known = self.entries[entry]
            if known[0] == digest:
                if known[1] == content:
                    return at
                raise ValueError(f"two different texts have the digest {digest.hex()}")
            at = (at + 1) & mask
        return at

    def fold(self, row: list, room: bool) -> bool:
        """Add a row to its content's entry; without ``room`` only if there is one."""
        at = self._slot(row[0], row[1])
        if self.slots[at] >= 0:
            known = self.entries[self.slots[at]]
            known[2] += row[2]
            if (-row[3], row[4]) < (-known[3], known[4]):
                known[3:] = row[3:]
            elif row[3] == known[3] and row[4] == known[4]:
                known[5] += row[5]
            return True
        if not room:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append(row)
        self.bytes += len(row[1]) + 200
        if 2 * len(self.entries) > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        for number, entry in enumerate(self.entries):
            self.slots[self._slot(entry[0], entry[1])] = number


def grace(rows: Iterable[list], table_bytes: int, level: int = 0) -> Iterator[list]:
    """One entry per distinct content, holding at most ``table_bytes`` of them at a time."""
    table, files = ContentTable(), {}
    for row in rows:
        if not table.fold(row, table.bytes < table_bytes):
            part = row[0][8 + level % 24] % FANOUT
            if part not in files:
                files[part] = tempfile.TemporaryFile()  # has no name: gone with the task
            pickle.dump(row, files[part], pickle.HIGHEST_PROTOCOL)
    yield from table.entries
    del table
    for file in files.values():
        with file:
            file.seek(0)
            yield from grace(_spilled(file), table_bytes, level + 1)


def _spilled(file) -> Iterator[list]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _batch(entries: list[list]) -> pa.RecordBatch:
    digest, content, size, length, ids, ties = zip(*entries)
    return pa.RecordBatch.from_arrays([
        pa.array([d.hex() for d in digest], pa.string()), pa.array(content, pa.binary()),
        pa.array(size, pa.int64()), pa.array(length, pa.int64()),
        pa.array([None if i == _NO_ID else i for i in ids], pa.int64()), pa.array(ties, pa.int64()),
    ], ["digest", "content", "group_size", "length", "id", "ties"])


def _batches(entries: Iterable[list]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for entry in entries:
        held.append(entry)
        size += len(entry[1])
        if len(held) >= 10_000 or size > 8 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _fold_locally(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            for doc, length, text in zip(*(c.to_pylist() for c in batch.columns)):
                content = text.translate(None, _DELETED)
                doc = _NO_ID if doc is None else doc
                table.fold([hashlib.sha256(content).digest(), content, 1, length, doc, 1], True)
                if table.bytes >= table_bytes:
                    yield from _batches(table.entries)
                    table = ContentTable()
        yield from _batches(table.entries)

    return run


def _join_buckets(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            [bytes.fromhex(row[0]), *row[1:4], _NO_ID if row[4] is None else row[4], row[5]]
            for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))
        )
        yield from _batches([e[0], b"", *e[2:]] for e in grace(rows, table_bytes))

    return run


def content_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """One row per distinct text: digest, group_size, id and length of the row that stays, ties."""
    text = text_of(text_column)
    rows = docs.select(F.col(f"`{id_column}`").cast("long"), F.length(text).cast("long"), text.cast("binary"))
    return (
        rows.mapInArrow(_fold_locally(table_bytes), _CLASSES)
        .repartition("digest")
        .mapInArrow(_join_buckets(table_bytes), _CLASSES)
        .drop("content")
    )


def _digest(text_column: str):
    return F.sha2(F.regexp_replace(text_of(text_column), f"[{WHITE}]+", "").cast("binary"), 256)


def mark_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """Each row's id with keep_id, group_size, kept and text_sha256 of the text without white space."""
    rows = stored(docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), _digest(text_column).alias("text_sha256"),
        F.length(text_of(text_column)).cast("long").alias("length"), F.monotonically_increasing_id().alias("row"),
    ))
    classes = content_classes(docs, id_column, text_column, table_bytes).select(
        F.col("digest").alias("text_sha256"), F.col("id").alias("keep_id"), "group_size",
        F.col("length").alias("keep_length"), "ties",
    )
    classes = stored(classes)
    joined = rows.join(classes, "text_sha256", "left")
    best = (F.col("length") == F.col("keep_length")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = (
        rows.join(classes.filter("ties > 1"), "text_sha256").filter(best)
        .groupBy(F.col("text_sha256").alias("tied")).agg(F.min("row").alias("first_row"))
    )
    return joined.join(first, F.col("text_sha256") == F.col("tied"), "left").select(
        "doc_id", "keep_id", "group_size",
        (best & ((F.col("ties") == 1) | (F.col("row") == F.col("first_row")))).alias("kept"), "text_sha256",
    )


def drop_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """The rows that stay, all their columns unchanged.

    Rows and winners meet on id, length and digest together, so a large group of copies is
    spread over all tasks.
    """
    key = free_name(docs, "_content_key")

    def named(doc, length, digest):
        return F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("-")), length.cast("string"), digest)

    winners = content_classes(docs, id_column, text_column, table_bytes).select(
        named(F.col("id"), F.col("length"), F.col("digest")).alias(key)
    )
    keyed = docs.withColumn(
        key, named(F.col(f"`{id_column}`").cast("long"), F.length(text_of(text_column)), _digest(text_column))
    )
    return keyed.join(stored(winners), key, "left_semi").dropDuplicates([key]).drop(key)
