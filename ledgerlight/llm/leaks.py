"""Benchmark decontamination by a prefix-filtered set join.

An item's words are cut into windows of ``window`` consecutive words; an item of fewer is one window.
A window is leaked where its words occur in a document in a row.  As a set of word shingles it must
then be contained in the document whole, so one shingle is enough to join on, and the best is the
rarest: shingles are ordered by how often the corpus holds them, and a window's prefix is its first.
Windows with a shingle that the corpus lacks are leaked nowhere and go at once.

Documents are read twice.  The first time they count the benchmark's shingles, the second time they
give the places of prefix shingles, each with the words around it.  What may matter is decided by a
bitmap of shingle hashes of bounded size, so no text moves and nothing that grows is broadcast; what
the bitmap lets through by chance is dropped by the join.  A joined row counts if the window fits
between the text's ends (length and position) and its words are those around the place (exact).

Words are runs of ASCII letters and digits and of all code points from 0x80 on, A-Z in lower case.
Null texts, empty texts and texts of separators only have no words: such documents are clean and such
items have no windows.  Repeated documents are found one by one, repeated items count as one; null
item ids are left out of lists but their windows are hit.  Empty tables give clean documents or none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm.common import stored, text_of
from ledgerlight.llm.filters import bitmap, passes

WINDOW, SHINGLE = 10, 3
#: Bytes of text that are looked at together.
BLOCK = 1 << 18
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_DRAW = np.random.Generator(np.random.PCG64(20240229))
#: A word's hash is the sum of a number per byte times a number per place; spaces add nothing.
_BYTES = _DRAW.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_BYTES[32] = 0
_PLACES = _DRAW.integers(0, 1 << 64, 1 << 16, np.uint64) | np.uint64(1)


class Words:
    """The words of some texts on end: where each lies, its hash, and the text it is of."""

    def __init__(self, texts: Sequence[str]) -> None:
        parts = [text.encode("utf-8", "surrogatepass").translate(_FOLD) for text in texts]
        self.data = b" ".join(parts)
        found = [self._words(begin, end) for begin, end in self._cuts()]
        self.starts, self.ends, self.hashes = (
            np.concatenate([f[n] for f in found]) if found else np.empty(0, kind)
            for n, kind in enumerate((np.int64, np.int64, np.uint64))
        )
        #: Number of the first word of each text, and of all words.
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(part) + 1 for part in parts)]))
        self.text = np.repeat(np.arange(len(parts)), np.diff(self.first))

    def _cuts(self) -> Iterator[tuple[int, int]]:
        """Stretches of about BLOCK bytes that end at spaces."""
        begin = 0
        while begin < len(self.data):
            end = self.data.find(b" ", begin + BLOCK)
            end = len(self.data) if end < 0 else end
            yield begin, end
            begin = end

    def _words(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(self.data, np.uint8, end - begin, begin)
        edges = np.flatnonzero(np.diff(codes != 32, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return starts, ends, np.empty(0, np.uint64)
        place = np.arange(starts[0], len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
        terms = _BYTES[codes[starts[0]:]] * _PLACES[place & 0xFFFF]
        return starts + begin, ends + begin, np.add.reduceat(terms, starts - starts[0])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of its first word, and a hash, of every run of ``size`` words of one text."""
        count = len(self.hashes) - size + 1
        if count < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        found = np.full(count, size, np.uint64)
        for n in range(size):
            found = (found ^ self.hashes[n:n + count]) * _MIX
            found ^= found >> _SHIFT
        whole = np.flatnonzero(self.text[:count] == self.text[size - 1:])
        return whole, found[whole] * _MIX

    def between(self, first: int, last: int) -> str:
        """The words from ``first`` to before ``last``, joined by spaces."""
        if last <= first:
            return ""
        return b" ".join(self.data[self.starts[first]:self.ends[last - 1]].split()).decode("utf-8", "replace")


def _blocks(texts: pa.Array) -> Iterator[Words]:
    """The texts in order, as many together as have about BLOCK characters."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if size >= BLOCK:
            yield Words(held)
            held, size = [], 0
    if held:
        yield Words(held)


def _windows(items: DataFrame, window: int, shingle: int, item_column: str, text_column: str) -> DataFrame:
    """(item, words, size, part, shingles): every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = Words([text.as_py()])
                count = len(words.hashes)
                if not count:
                    continue
                size = min(window, count)
                part = min(shingle, size)
                prints = words.shingles(part)[1].view(np.int64)
                for begin in range(0, count - size + 1, 10_000):
                    places = range(begin, min(begin + 10_000, count - size + 1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item] * len(places), pa.string()),
                        pa.array([words.between(p, p + size) for p in places], pa.string()),
                        pa.array([size] * len(places), pa.int32()), pa.array([part] * len(places), pa.int32()),
                        pa.array([prints[p:p + size - part + 1] for p in places], pa.list_(pa.int64())),
                    ], ["item", "words", "size", "part", "shingles"])

    texts = items.select(F.col(f"`{item_column}`").cast("string"), text_of(text_column))
    return texts.mapInArrow(cut, "item string, words string, size int, part int, shingles array<long>")


def _counted(texts: DataFrame, bits: np.ndarray, parts: Sequence[int]) -> DataFrame:
    """(shingle, n): how often the corpus holds the shingles that pass, added up per batch first."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.empty(0, np.uint64)]
            for words in _blocks(batch.column(batch.num_columns - 1)):
                for part in parts:
                    _, prints = words.shingles(part)
                    kept.append(prints[passes(shared.value, prints)])
            found, times = np.unique(np.concatenate(kept), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["shingle", "n"])

    return texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _places(texts: DataFrame, bits: np.ndarray, parts: Sequence[int], window: int) -> DataFrame:
    """(id, n_words, found): the places of shingles that pass, with ``window`` words on either side."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    found_type = pa.list_(pa.struct([
        ("shingle", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("around", pa.string())
    ]))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for words in _blocks(batch.column(1)):
                held: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
                for part in parts:
                    at, prints = words.shingles(part)
                    passed = passes(shared.value, prints)
                    for word, shingle in zip(at[passed].tolist(), prints[passed].view(np.int64).tolist()):
                        text = words.text[word]
                        low, high = words.first[text], words.first[text + 1]
                        begin = max(low, word - window)
                        held[text].append({
                            "shingle": shingle, "place": int(word - low), "before": int(word - begin),
                            "around": words.between(begin, min(high, word + window)),
                        })
                sizes += np.diff(words.first).tolist()
                found += held
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, found_type)], ["id", "n_words", "found"]
            )

    kind = dict(texts.dtypes)["id"]
    return texts.mapInArrow(locate, (
        f"id {kind}, n_words long, found array<struct<shingle:long,place:long,before:int,around:string>>"
    ))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_hit, spans) of (row, starts, sizes): overlapping and touching spans as one, and their words."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        hits, spans = [], []
        for starts, sizes in zip(batch.column(1), batch.column(2)):
            begin = starts.values.to_numpy()
            order = np.argsort(begin, kind="stable")
            begin = begin[order]
            reach = np.maximum.accumulate(begin + sizes.values.to_numpy()[order])
            new = np.append(True, begin[1:] > reach[:-1])
            ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
            hits.append(int((ends - begin[new]).sum()))
            spans.append([{"start": s, "end": e} for s, e in zip(begin[new].tolist(), ends.tolist())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hits, pa.int64()), pa.array(spans, spans_type)], ["row", "n_hit", "spans"]
        )


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """One row per document: the id, n_words, n_hit, spans (of word numbers, end exclusive), items (sorted)."""
    cut = stored(_windows(items, window, shingle, item_column, item_text_column))
    windows = stored(cut.groupBy("words", "size", "part").agg(F.first("shingles").alias("shingles"))
                     .withColumn("window", F.monotonically_increasing_id()))
    members = cut.join(windows.select("words", "size", "window"), ["words", "size"]).select("window", "item").distinct()
    members = stored(members)
    parts = [row["part"] for row in windows.select("part").distinct().collect()]  # ``shingle`` numbers at most

    texts = docs.select(F.col(f"`{id_column}`").alias("id"), text_of(text_column).alias("text"))
    single = windows.select("window", F.posexplode("shingles").alias("at", "shingle"))
    counts = _counted(texts, bitmap(single, "shingle"), parts)
    rarest = (
        single.join(stored(counts), "shingle", "left").groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("prefix"))
        .filter("prefix.n > 0")
    )
    prefixes = stored(windows.join(rarest, "window").select(
        "window", "size", F.split("words", " ").alias("words"), "prefix.shingle", "prefix.at"
    ))
    found = stored(
        _places(texts, bitmap(prefixes, "shingle"), parts, window).withColumn("row", F.monotonically_increasing_id())
    )
    places = found.filter(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("one"))
    places = places.select("row", "n_words", "one.*")
    fits = (F.col("place") >= F.col("at")) & (F.col("place") - F.col("at") + F.col("size") <= F.col("n_words"))
    same = F.expr("slice(split(around, ' '), before - at + 1, size) = words")
    hits = stored(places.join(prefixes, "shingle").filter(fits & same).select(
        "row", "window", (F.col("place") - F.col("at")).alias("start"), F.col("size").cast("long").alias("size")
    ))
    spans = hits.select("row", "start", "size").distinct().groupBy("row").agg(
        F.collect_list(F.struct("start", "size")).alias("held")
    ).select("row", "held.start", "held.size").mapInArrow(
        _merged, "row long, n_hit long, spans array<struct<start:long,end:long>>"
    )
    named = hits.select("row", "window").distinct().join(members, "window").groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )
    leaks = stored(spans.join(named, "row", "left"))
    none = F.lit(0).cast("long")
    return found.select("row", "id", "n_words").join(leaks, "row", "left").select(
        F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<start:long,end:long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def summary() -> list[Column]:
    """n_hit, n_items, items_sha256 and contaminated of the rows of ``find_leaks``."""
    return [
        F.col("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    ]
