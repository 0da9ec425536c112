"""Packing documents' tokens into windows by Karmarkar-Karp multiway differencing.

A document becomes its token ids plus an end id.  Every ``capacity`` ids in a row are a window of
their own; what is left over is packed in groups of ``group`` leftovers.  A group is split into as
few windows as its sum needs by differencing: two partial partitions with opposing imbalances are
merged, the most uneven first, until one is left, whose windows are near-equal.  The number of
windows rises whenever one exceeds its capacity.  Documents may be cut, and one leftover in
``every`` is, beforehand, into pieces of ``grain`` ids: such fine pieces level what whole leftovers
leave uneven, so the count hardly rises above what the sum needs.  Neighbouring pieces that land in one
window are one piece again.

A task groups the documents it reads as they come, so no key decides where a piece goes, no text
moves, and a task holds one group at a time.  Only its last group is smaller than the others.
Null and empty texts are documents of one end id, null ids stay null, and repeated rows are packed one by
one; other columns are not read.  An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import text_of
from ledgerlight.llm.encoding import Encoder

CAPACITY, GROUP, EVERY, GRAIN = 2048, 512, 16, 32
END_ID = 1
COLUMNS = (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
)


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Split items into ``windows`` near-equal parts, given as lists of item numbers.

    A partial partition lists its non-empty sums, largest first, with their items.
    """
    heap = [(-size, n, [(size, [n])]) for n, size in enumerate(lengths)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = max(0, len(one) + len(two) - windows)
        keep = len(one) - shared
        merged = one[:keep] + two[shared:]
        merged += [(a[0] + b[0], a[1] + b[1]) for a, b in zip(reversed(one[keep:]), two)]
        merged.sort(key=_sum, reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    return [items for _, items in heap[0][2]] if heap else []


def _sum(part: tuple[int, list[int]]) -> int:
    return part[0]


def windows_for(lengths: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal windows of which none exceeds ``capacity``, as lists of item numbers."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        parts = difference(lengths, windows)
        if all(sum(lengths[i] for i in part) <= capacity for part in parts):
            return parts
        windows += 1


def cut(sizes: list[int], every: int, grain: int) -> list[tuple[int, int, int]]:
    """(item, start, length): items whole, but one in ``every`` in pieces of ``grain`` at most."""
    pieces = []
    for item, size in enumerate(sizes):
        step = size if item % every else grain
        pieces += [(item, start, min(step, size - start)) for start in range(0, size, step)]
    return pieces


def joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces in order, neighbours of one item as one."""
    out: list[tuple[int, int, int]] = []
    for item, start, length in sorted(pieces):
        if out and out[-1][0] == item and out[-1][1] + out[-1][2] == start:
            out[-1] = (item, out[-1][1], out[-1][2] + length)
        else:
            out.append((item, start, length))
    return out


def pack(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY, group: int = GROUP, every: int = EVERY, grain: int = GRAIN,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``ids_crc32`` is the checksum of the piece's ids as little-endian unsigned 32-bit integers;
    ``doc_tokens`` counts the end id too.
    """
    encoder = Encoder(tokenizer)
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_of(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        rest: list[tuple[int | None, int, array, int]] = []
        rows: list[tuple] = []

        def piece(doc, start, ids, total, offset):
            if sys.byteorder == "big":
                ids = array("I", ids)
                ids.byteswap()
            rows.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, offset))

        def close():
            nonlocal sequence
            pieces = cut([len(r[2]) for r in rest], every, grain)
            for window in windows_for([length for _, _, length in pieces], capacity):
                offset = 0
                for item, start, length in joined([pieces[n] for n in window]):
                    doc, first, ids, total = rest[item]
                    piece(doc, first + start, ids[start:start + length], total, offset)
                    offset += length
                sequence += 1
            rest.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py())
                ids.append(END_ID)
                total = len(ids)
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    piece(doc, start, ids[start:start + capacity], total, 0)
                    sequence += 1
                if total > whole:
                    rest.append((doc, whole, ids[whole:], total))
                if len(rest) == group:
                    close()
            if rows:
                yield _batch(rows)
                rows.clear()
        close()
        if rows:
            yield _batch(rows)

    return texts.mapInArrow(run, ", ".join(f"`{name}` long" for name in COLUMNS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], COLUMNS)
