"""Quality rules: repetition counts and a log-likelihood ratio of hashed byte n-grams.

Two multinomials over ``BUCKETS`` hash buckets of byte trigrams are counted: one over the trusted
documents (those labelled good), one over the whole corpus.  A document's verdict is the mean over
its trigrams of log(p_trusted / p_corpus), both smoothed by one: per trigram, so length does not
count.  Every document is held against the same threshold.  Counts cover every document; each task
adds up its own before they are shuffled.  Texts are moved for the trusted multinomial only: a bitmap
of trusted ids of bounded size tells a scan which documents may be trusted, and those are joined.

Words are runs of anything but ASCII white space.  Null texts have no words and fail the base
rule, as do all texts of fewer than ``LEAST_WORDS`` words.  Without trusted documents the ratio is
0 for every document.  Repeated rows are counted and judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import free_name, text_of
from ledgerlight.llm.filters import bitmap, passes

BUCKETS_LOG2 = 16
BUCKETS = 1 << BUCKETS_LOG2
#: Mean log ratio from which a document stays.
THRESHOLD = -0.35
LEAST_WORDS, REPEATED_PERCENT = 50, 50
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
COLUMNS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of a text's byte trigrams, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < 3:
        return np.empty(0, np.uint32)
    wide = data.astype(np.uint32)
    grams = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)


def base_counts(text: str) -> tuple[int, ...]:
    """n_words and the four counts of COLUMNS."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six characters only
    lines, seen, copies = text.split("\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line.strip(_WHITE):
                copies += line in seen
                seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, _WHITE)), sum(map(text.count, _SYMBOLS)),
        copies, _repeated(words),
    )


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)
    size = len(numbers)
    if size == len(words):
        return 0
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:len(words) - 2 + shift] |= again
    return int(covered.sum())


def _counted(texts: DataFrame, column: str, name: str) -> DataFrame:
    """(bucket, ``name``) over all rows, added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                grams = trigrams(text.as_py())
                # a long text fills most buckets, a short one few
                if len(grams) > BUCKETS // 8:
                    total += np.bincount(grams, minlength=BUCKETS)
                else:
                    np.add.at(total, grams, 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    return texts.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def ngram_counts(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(bucket, n_trusted, n_corpus) over all documents; ``trusted`` has the ids of good ones."""
    good = trusted.select(F.col(f"`{id_column}`").cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(good.select(F.xxhash64("id").alias("hash")), "hash"))

    @F.pandas_udf("boolean")
    def may_be_trusted(hashes: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, hashes.to_numpy(np.int64).view(np.uint64)))

    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text_of(text_column).alias("text"))
    some = texts.filter("id IS NOT NULL").filter(may_be_trusted(F.xxhash64("id"))).join(good, "id", "left_semi")
    return _counted(texts, "text", "n_corpus").join(_counted(some, "text", "n_trusted"), "bucket", "left").select(
        "bucket", F.coalesce("n_trusted", F.lit(0)).alias("n_trusted"), "n_corpus"
    )


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The log ratio of every bucket: ``BUCKETS`` numbers, whatever the corpus."""
    good, corpus = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():  # at most BUCKETS rows
        good[row["bucket"]], corpus[row["bucket"]] = row["n_trusted"], row["n_corpus"]
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((corpus + 1) / (corpus.sum() + BUCKETS))


def judge(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with n_words, the base counts, log_ratio, base_failed and kept (replacing such columns)."""
    ratios = log_ratios(ngram_counts(docs, trusted, id_column, text_column))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ratio double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        weights, rows = shared.value, []
        for text in texts:
            grams = trigrams(text)
            rows.append((*base_counts(text), float(weights[grams].mean()) if len(grams) else 0.0))
        return pd.DataFrame(rows, columns=["n_words", *COLUMNS, "log_ratio"])

    found = free_name(docs, "_measured")
    out = docs.withColumn(found, measured(text_of(text_column)))
    for name in ("n_words", *COLUMNS, "log_ratio"):
        out = out.withColumn(name, F.col(f"{found}.{name}"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold)
    ).drop(found)
