"""Importance resampling towards a target distribution, by hashed n-grams.

A text's A-Z are lowered and every run of separators is collapsed to one space.  Then one regular
expression per n, scanned with overlapping matches and held between word boundaries by look-arounds,
gives the span of every n-gram; the CRC-32 of its bytes names its bucket.  Buckets are counted over
all documents and over the target's texts; a bucket's gain is 1000 times the log ratio of the two
smoothed shares, rounded down.  A document's weight is the mean gain of its n-grams, rounded down,
and its score adds Gumbel noise made from its id, so that the highest scores are a draw without
replacement by weight.

Texts are scanned once: what is stored is each document's bucket numbers, from which counts and
weights come.  Each task adds up its own counts before they are shuffled.  The draw finds the score
of its last place in the counts per score (whole numbers within some hundred thousand, whatever the
corpus), and sorts only what reaches it, by ranges, so no task holds more than its range.

Null and empty texts, and texts of separators only, have no n-grams: weight 0, and too few words to
be drawn.  Null ids are hashed as the empty text and come after all others in a tie.  Repeated rows
are documents of their own; of rows with equal id and score the smaller hash of the text comes
first.  With an empty target all gains follow from smoothing alone; an empty table gives no rows.
The added columns (``ADDED``) replace columns of these names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import free_name, stored, text_of

BUCKETS, NGRAMS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
ADDED = ("n_words", "n_features", "weight", "score", "rank")
#: Bytes of words, A-Z in lower case; separators become spaces.  Code points from 0x80 on are words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Scanner:
    """Bucket numbers of all runs of 1 to ``ngrams`` words of a text."""

    def __init__(self, ngrams: int, buckets: int) -> None:
        import regex

        self.buckets = buckets
        self.patterns = [
            regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(1, ngrams + 1)
        ]

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        line, crc = b" ".join(words), zlib.crc32
        found = [
            crc(match[0]) for pattern in self.patterns for match in pattern.finditer(line, overlapped=True)
        ]
        return len(words), (np.array(found, np.uint32) % np.uint32(self.buckets)).astype(np.uint32)


def scan(
    docs: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, text_column: str = "text",
    features: str = "features",
) -> DataFrame:
    """``docs`` with n_words, and ``features``: the little-endian 32-bit bucket of every n-gram."""

    @F.pandas_udf("n_words long, buckets binary")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(ngrams, buckets)
        for texts in batches:
            rows = [scanner(text) for text in texts]
            yield pd.DataFrame({"n_words": [n for n, _ in rows], "buckets": [f.astype("<u4").tobytes() for _, f in rows]})

    found = free_name(docs, "_scanned")
    return (
        docs.withColumn(found, scanned(text_of(text_column)))
        .withColumn("n_words", F.col(f"{found}.n_words")).withColumn(features, F.col(f"{found}.buckets")).drop(found)
    )


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS, features: str = "features") -> np.ndarray:
    """How often each bucket occurs: ``buckets`` numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    folded = scanned.select(F.col(f"`{features}`")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in folded.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the corpus)), shares smoothed by one."""
    size, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_corpus + size) / ((s + 1.0) * (all_target + size))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def weigh(
    scanned: DataFrame, gains: np.ndarray, seed: int = SEED, id_column: str = "doc_id", features: str = "features",
) -> DataFrame:
    """``scanned`` with n_features, weight and score in place of ``features``."""
    shared = scanned.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    @F.pandas_udf("n long, weight long")
    def weighed(column: pd.Series) -> pd.DataFrame:
        rows = []
        for held in column:
            found = np.frombuffer(held, "<u4")
            rows.append((len(found), int(shared.value[found].sum()) // len(found) if len(found) else 0))
        return pd.DataFrame(rows, columns=["n", "weight"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 256)
    drawn = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    found = free_name(scanned, "_weighed")
    out = scanned.withColumn(found, weighed(F.col(f"`{features}`"))).drop(features)
    return (
        out.withColumn("n_features", F.col(f"{found}.n")).withColumn("weight", F.col(f"{found}.weight"))
        .withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(drawn))).cast("long")).drop(found)
    )


def draw(
    weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_column: str = "doc_id",
    order: Sequence[str] = (),
) -> DataFrame:
    """``weighed`` with rank: 1, 2, 3... for the drawn documents by falling score, else null.

    Ties go to the smaller id, then to the smaller value of the columns ``order``.
    ``weighed`` is read several times and should be stored.
    """
    able = F.col("n_words") >= least_words
    counts = weighed.filter(able).groupBy("score").count().toPandas().sort_values("score", ascending=False)
    places = percent * int(counts["count"].sum()) // 100
    if not places:
        return weighed.withColumn("rank", F.lit(None).cast("long"))
    reached = int((counts["count"].cumsum() < places).sum())
    cut = int(counts["score"].iloc[reached])

    chosen = able & (F.col("score") >= cut)
    by = [F.col("score").desc(), F.col(f"`{id_column}`").asc_nulls_last(), *(F.col(f"`{c}`").asc_nulls_last() for c in order)]
    place = free_name(weighed, "_place")
    # the id of a row of a sorted range: the range's number, then 33 bits for the row's place in it
    ranged = stored(
        weighed.filter(chosen).repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn(place, F.monotonically_increasing_id())
    )
    part = F.shiftright(place, 33)
    ends = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row per partition
    starts, before = {}, 0
    for row in sorted(ends, key=lambda r: r["part"]):
        starts[row["part"]] = before
        before += row["n"]
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)), part)
    rank = offset.cast("long") + F.col(place).bitwiseAND((1 << 33) - 1) + 1
    ranked = ranged.withColumn("rank", F.when(rank <= places, rank)).drop(place)
    rest = weighed.filter(~F.coalesce(chosen, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, ngrams: int = NGRAMS, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, seed: int = SEED, carry: Sequence[str] | None = None,
    id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
) -> DataFrame:
    """All documents, their columns (or those of ``carry``) and n_words, n_features, weight, score, rank.

    The documents with a rank are the draw: ``percent`` of those with ``least_words`` words.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    if id_column not in kept:
        kept = [id_column, *kept]
    features, tie = free_name(docs, "_features"), free_name(docs, "_tie")
    hashed = F.xxhash64(text_of(text_column)).alias(tie)
    scanned = stored(
        scan(docs, ngrams, buckets, text_column, features)
        .select(*(f"`{c}`" for c in kept), hashed, "n_words", features)
    )
    wanted = scan(target.select(F.col(f"`{target_column}`").alias("text")), ngrams, buckets)
    gains = bucket_gains(bucket_counts(scanned, buckets, features), bucket_counts(wanted, buckets))
    weighed = stored(weigh(scanned, gains, seed, id_column, features))
    return draw(weighed, percent, least_words, id_column, [tie]).drop(tie)
