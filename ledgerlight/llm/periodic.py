"""Periodic runs of words, by seeds on diagonals.

A run is a stretch of words with smallest period q, at least ``max(least, 2 * q)`` words long, that
no neighbouring word extends.  Its words and those q places later agree over length - q places, a
stretch on diagonal q.  That stretch is ``max(least - q, q)`` words long at least, so every run has a
seed: an equal pair of k-grams q places apart, k being the overlap that is guaranteed.  For lags up
to ``least`` k is half of it; for lags from k to 2k it is k, and k doubles from level to level.  k-grams
are named exactly, each level from the names of the one before, and indexed by sorting.

Of a diagonal's stretch only the first pair is enumerated: the words before its two places differ.  At
a lag of k or more, occurrences of one k-gram closer than that overlap and share the word before them,
so their pairs are few whatever repeats: a text of one word ten thousand times gives thousands, not
millions.  A seed is extended word by word.  A table per lag tells how far that diagonal has been
covered; a seed within is not extended again, and neither is one that begins a known run at a
multiple of its period.  Stretches of one extent have one smallest period, which is kept.

Documents are independent, so nothing is shuffled and a task holds one batch of texts.  Null and empty
texts, and texts of white space only, have no words and no runs.  Repeated rows are documents of their
own; an empty table gives no rows.  The column that is added replaces one of its name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import text_of

LEAST = 12
#: What the added column holds: runs by start, then period; the text without repeats.
TYPE = "runs array<struct<start:long,length:long,period:long>>, n_words long, collapsed string"


def find_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in an array of word numbers, by start, then period."""
    n, k = len(words), least // 2
    if n < least:
        return []
    best: dict[tuple[int, int], int] = {}
    covered: dict[int, int] = {}
    begun: dict[int, list[tuple[int, int]]] = {}
    names, low = _grams(words, k), 1
    while len(names) > low:
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        if not (ranked[1:] == ranked[:-1]).any():
            break
        for start, lag in _seeds(order, ranked, words, low, 2 * k):
            if covered.get(lag, -1) > start or any(
                lag % period == 0 and start + lag <= end for period, end in begun.get(start, ())
            ):
                continue  # known, or of a known run's extent
            end = start + lag + k + _agreeing(words, start + k, start + lag + k)
            covered[lag] = end - lag
            if end - start >= max(least, 2 * lag):
                begun.setdefault(start, []).append((lag, end))
                if best.get((start, end), n) > lag:
                    best[start, end] = lag
        low, wider = 2 * k, len(names) - k
        if wider <= 0:
            break
        names, k = _pairs(names[:wider], names[k:]), 2 * k
    return sorted((start, end - start, lag) for (start, end), lag in best.items())


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A number for the ``k`` words from each place on, equal only for equal words."""
    names, length = words, 1
    for bit in bin(k)[3:]:
        names, length = _pairs(names[:len(names) - length], names[length:]), 2 * length
        if bit == "1":
            names, length = _pairs(names[:len(names) - 1], words[length:]), length + 1
    return names


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    size = int(two.max()) + 1 if len(two) else 1
    return np.unique(one * size + two, return_inverse=True)[1]


def _seeds(order: np.ndarray, ranked: np.ndarray, words: np.ndarray, low: int, high: int):
    """(place, lag) of equal k-grams, low <= lag < high, after different words; by lag, then place."""
    size = len(order)
    before = np.where(order > 0, words[order - 1], -1)
    # of each entry, the next one of its k-gram after another word
    change = np.append(np.flatnonzero((before[1:] != before[:-1]) | (ranked[1:] != ranked[:-1])) + 1, size)
    other = change[np.searchsorted(change, np.arange(size), side="right")]
    # begin at the first entry of the same k-gram that is ``low`` places on
    keys, first = ranked * (2 * size) + order, np.arange(size)
    at = _unlike(np.searchsorted(keys, keys + low), first, ranked, before, other)
    places, lags = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(first):
        inside = at < size
        first, at = first[inside], at[inside]
        lag = order[at] - order[first]
        inside = (ranked[at] == ranked[first]) & (lag < high)
        first, at, lag = first[inside], at[inside], lag[inside]
        places.append(order[first])
        lags.append(lag)
        at = _unlike(at + 1, first, ranked, before, other)
    places, lags = np.concatenate(places), np.concatenate(lags)
    sort = np.lexsort((places, lags))
    return zip(places[sort].tolist(), lags[sort].tolist())


def _unlike(at, first, ranked, before, other) -> np.ndarray:
    """The entries ``at``, or the next after another word where ``at`` has the word before ``first``."""
    near = np.minimum(at, len(ranked) - 1)
    same = (at < len(ranked)) & (ranked[near] == ranked[first]) & (before[near] == before[first])
    return np.where(same, other[near], at)


def _agreeing(words: np.ndarray, one: int, two: int, step: int = 64) -> int:
    """How many words from place ``one`` on equal those from place ``two`` on."""
    done, n = 0, len(words)
    while two + done < n:
        left, right = words[one + done:one + done + step], words[two + done:two + done + step]
        differ = left[:len(right)] != right
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + len(right), 2 * step
    return done


def text_runs(text: str, least: int = LEAST) -> tuple[list[tuple[int, int, int]], int, str]:
    """The runs of a text, its number of words, and the words that no run repeats, joined by spaces."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six characters only
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)
    runs = find_runs(ids, least) if len(numbers) < len(words) else []
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [word for word, n in zip(words, np.cumsum(gone).tolist()) if not n]
    return runs, len(ids), b" ".join(words).decode("utf-8", "surrogatepass")


def mark_runs(
    docs: DataFrame, least: int = LEAST, text_column: str = "text", into: str = "periodic"
) -> DataFrame:
    """``docs`` with a column ``into``: the runs, the number of words, the text without repeats."""

    @F.pandas_udf(TYPE)
    def marked(texts: pd.Series) -> pd.DataFrame:
        rows = [text_runs(text, least) for text in texts]
        return pd.DataFrame({
            "runs": [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs, _, _ in rows],
            "n_words": [n for _, n, _ in rows], "collapsed": [text for _, _, text in rows],
        })

    return docs.withColumn(into, marked(text_of(text_column)))


def digests(marked: DataFrame, into: str = "periodic"):
    """Columns: n_runs; start, length, period and exponent of the longest run; two digests."""
    runs = F.col(f"{into}.runs")
    # the longest, then the first, then the smallest period
    longest = F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period")
    )))
    length, period = -longest["size"], longest["period"]
    lines = F.transform(runs, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")
    ))
    return [
        F.size(runs).cast("long").alias("n_runs"),
        longest["start"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col(f"{into}.collapsed"), 256).alias("collapsed_sha256"),
    ]
