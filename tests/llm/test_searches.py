"""Resampling, periodic runs and leaks against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlight.llm import filters, leaks, periodic, queries, resampling
from tests.llm.helpers import WORD, frame, odd_texts, prose, rows, same_rows

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return LETTERS.findall((text or "").translate(LOW))


def grams(text, longest):
    words = words_of(text)
    return [
        zlib.crc32(" ".join(words[i:i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_against_plain_version(spark, longest):
    size, texts = 50, [*odd_texts(), *(prose(900 + n, 15 + n) for n in range(40))]
    goal = [prose(901, 30), None, "", odd_texts()[5]]
    target = spark.createDataFrame([(n, t) for n, t in enumerate(goal)], "item_id long, text string")
    got = resampling.resample(frame(spark, rows(texts)), target, percent=30, ngrams=longest, buckets=size, seed=7)

    def counts(of):
        out = [0] * size
        for text in of:
            for found in grams(text, longest):
                out[found % size] += 1
        return out

    records = rows(texts)
    s, t = counts(r[1] for r in records), counts(goal)
    gains = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + size) / ((a + 1) * (sum(t) + size)))) for a, b in zip(s, t)
    ]
    wanted = []
    for doc, text, *_ in records:
        own = [gains[found % size] for found in grams(text, longest)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        wanted.append((doc, len(words_of(text)), len(own), weight, score))
    able = sorted(((-w[4], w[0] is None, w[0] or 0) for w in wanted if w[1] >= 20))
    drawn = [key for key in able[:30 * len(able) // 100]]
    found = got.collect()
    assert sorted([tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score")) for r in found], key=repr) \
        == sorted(wanted, key=repr)
    ranked = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in found if r["rank"])
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn
    assert set(frame(spark).columns) < set(got.columns)


def test_resampling_of_empty_tables_and_one_word(spark):
    empty, target = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, target).count() == 0
    got = resampling.resample(frame(spark), target).collect()
    assert len(got) == len(rows(odd_texts())) and sum(r["rank"] is not None for r in got) > 0
    few = resampling.resample(frame(spark, [(1, "x y", None, None, None, None, None)]), target).collect()
    assert [(r["n_words"], r["rank"]) for r in few] == [(2, None)]
    clash = frame(spark).withColumnRenamed("kept", "rank").withColumnRenamed("row_key", "_features")
    assert set(resampling.resample(clash, target).columns) == {
        *(c for c in clash.columns if c != "rank"), *resampling.ADDED
    }


def test_overlapping_scan_takes_all_runs():
    n, found = resampling.Scanner(3, 1 << 31)("A-b,,C é\tA")
    assert n == 5 and sorted(found.tolist()) == sorted(x % (1 << 31) for x in grams("a b c é a", 3))


def plain_runs(words, least=12):
    out = {}
    for lag in range(1, len(words) // 2 + 1):
        place = 0
        while place + lag < len(words):
            start = place
            while place + lag < len(words) and words[place] == words[place + lag]:
                place += 1
            if place + lag - start >= max(least, 2 * lag):
                out.setdefault((start, place + lag), lag)
            place += 1
    return sorted((start, end - start, lag) for (start, end), lag in out.items())


def test_runs_against_plain_version():
    draw = random.Random(5)
    for trial in range(1500):
        letters = draw.choice([1, 2, 2, 3, 8])
        words = [draw.randrange(letters) for _ in range(draw.randint(0, 130))]
        for _ in range(draw.randint(0, 4)):
            if len(words) > 20:
                start, period = draw.randrange(len(words)), draw.randint(1, 40)
                for i in range(start, min(len(words), start + draw.randint(1, 100))):
                    words[i] = words[start + (i - start) % period]
        for least in (12, 7):
            assert periodic.find_runs(np.array(words, np.int64), least) == plain_runs(words, least)


def test_runs_of_long_texts_stay_cheap():
    """A quadratic search of these would take hours."""
    constant = np.zeros(100_000, np.int64)
    assert periodic.find_runs(constant) == [(0, 100_000, 1)]
    draw = random.Random(1)
    line = list(range(9))  # a line repeated between different words has no run
    words = [x for n in range(20_000) for x in (*line, 100 + draw.randrange(10**6))]
    assert periodic.find_runs(np.unique(words, return_inverse=True)[1]) == []


def plain_summary(text):
    words = WORD.findall(text or "")
    runs = plain_runs(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_marked_runs_of_a_table(spark):
    texts = [*odd_texts()[:13], prose(3, 300), "a b c " * 9 + "x", ("a b c " * 5 + "d ") * 4, "go go go stop " * 30]
    docs = frame(spark, rows(texts))
    marked = periodic.mark_runs(docs)
    assert marked.columns == [*docs.columns, "periodic"]
    got = marked.select("doc_id", *periodic.digests(marked)).collect()
    assert same_rows([tuple(r) for r in got], [(r[0], *plain_summary(r[1])) for r in rows(texts)])
    assert periodic.mark_runs(frame(spark, [])).count() == 0


def test_periodic_query(spark, tmp_path):
    """The query on a small table, with its planted ends, against the plain version."""
    records = [(n, prose(n, 5 + n % 90), "en", "s", 1, None, None) for n in range(150)]
    records += [(200, None, None, None, None, None, None), (None, "go " * 20, None, None, None, None, None)]
    frame(spark, records).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for doc, text, *_ in records:
        h, words = zlib.crc32(str(doc).encode()), WORD.findall(text or "")
        if doc is not None and h % 10 == 0 and words:
            g = h // 10
            a, old = g % len(words), list(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            for i in range(a, len(words)):
                words[i] = old[a + (i - a) % p]
        wanted.append((doc, *plain_summary(" ".join(words))))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert same_rows([tuple(r) for r in got.collect()], wanted)


def plain_leaks(records, items, window):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[i:i + size]), set()).add(item)
    out = []
    for doc, text, *_ in records:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(words[i:i + size])]
        out.append((doc, len(words), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return out


@pytest.mark.parametrize("window,shingle", [(10, 3), (4, 1), (6, 6)])
def test_leaks_against_plain_version(spark, window, shingle):
    passages = [prose(70 + n, 25) for n in range(6)]
    items = [*enumerate(passages), (6, None), (7, ""), (8, " ,;"), (9, passages[0]), (None, passages[1]),
             (10, "go stop go"), (11, "word"), (12, "a a a a a a a a a a a a"), (12, "one more " * 4), (0, "b b")]
    texts = [*odd_texts(), passages[0], f"{prose(1, 30)} {passages[2].upper()}! {prose(2, 30)}",
             " ".join(passages[3].split()[:9]), f"{passages[4]}, {passages[5]}; {passages[4]}", "a " * 30,
             " ".join(passages[1].split()[5:16]), passages[0].replace(" ", " "), "x go-stop. GO"]
    texts += [f"{prose(300 + n, 9)} {passages[n % 6]} {n}" for n in range(60)]  # passages that many share
    records = rows(texts)
    got = leaks.find_leaks(
        frame(spark, records), spark.createDataFrame(items, "item_id long, text string"), window, shingle
    ).collect()
    assert same_rows(
        [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got], plain_leaks(records, items, window)
    )
    for row in got:
        spans = [(s["start"], s["end"]) for s in row["spans"]]
        assert row["n_hit"] == sum(e - b for b, e in spans) and spans == sorted(spans)


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(frame(spark, []), none).count() == 0
    assert leaks.find_leaks(frame(spark, []), none.union(spark.createDataFrame([(1, "a b")], none.schema))).count() == 0
    got = leaks.find_leaks(frame(spark), none).collect()
    assert len(got) == len(rows(odd_texts())) and not any(r["n_hit"] or r["items"] or r["spans"] for r in got)


def test_bitmap_holds_every_hash(spark):
    hashes = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 64, 5000, np.uint64)
    bits = filters.bitmap(spark.createDataFrame([(int(h.view(np.int64)),) for h in hashes], "h long"), "h")
    assert filters.passes(bits, hashes).all()
    others = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 5000, np.uint64)
    assert filters.passes(bits, others).mean() < 0.15


def test_flags_by_a_bitmap(spark):
    held = spark.range(4000).selectExpr("xxhash64(id) AS h")
    asked = spark.range(2000, 9000).selectExpr("id", "xxhash64(id) AS own", "'x' AS _piece")
    got = filters.flagged(asked, "own", held, "h", "may")
    assert got.columns == ["id", "own", "_piece", "may"]
    rows = got.collect()
    assert len(rows) == 7000 and all(r["may"] for r in rows if r["id"] < 4000)
    assert sum(r["may"] for r in rows if r["id"] >= 4000) < 200
    none = filters.flagged(asked, "own", held.limit(0), "h", "may")
    assert none.filter("may").count() == 0
