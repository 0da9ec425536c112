"""Secret scan, tokens, packing, mixing, quality rules and scores against plain versions."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ledgerlight.llm import mixing, packing, quality, rules, secrets, transducer
from ledgerlight.llm.encoding import Encoder
from tests.llm.helpers import WORD, frame, odd_texts, prose, rows

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_spans(text, rule_set):
    spans = []
    for number, rule in enumerate(rule_set):
        for found in re.finditer(rule.pattern, text or ""):
            if len(found[rule.group]) >= rule.least:
                spans.append((found.start(), number, found.end()))
    return [(rule_set[n].kind, a, b) for a, n, b in sorted(spans)]


def test_secrets_against_plain_search(spark):
    docs = frame(spark)
    got = secrets.scan(docs).select("text", "secrets", *secrets.summary(secrets.scan(docs))[:3]).collect()
    assert len(got) == docs.count()
    for row in got:
        assert [(s["kind"], s["start"], s["end"]) for s in row["secrets"]] == plain_spans(row["text"], secrets.RULES)
        assert all(s["found"] == row["text"][s["start"]:s["end"]] for s in row["secrets"])
    assert max(row["n_assign"] for row in got) >= 3 and max(row["n_hex"] for row in got) == 1


def test_secret_digest(spark):
    scanned = secrets.scan(frame(spark))
    for row in scanned.select("text", *secrets.summary(scanned)).collect():
        base = plain_spans(row["text"], secrets.BASE_RULES)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()


def test_added_columns_replace_those_of_their_names(spark):
    docs = frame(spark).withColumnRenamed("row_key", "secrets").withColumnRenamed("kept", "score")
    scanned = quality.score(secrets.scan(docs), 0.25)
    assert scanned.columns == docs.columns and scanned.count() == docs.count()
    assert {r["score"] for r in scanned.collect()} == {0.25}
    assert dict(scanned.dtypes)["secrets"].startswith("array<struct<kind:string")


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("abcd|xyz") == sorted([frozenset({"abc", "bcd"}), frozenset({"xyz"})], key=sorted)
    assert secrets.trigram_query("ab?c.ef") is None
    assert secrets.trigram_query("(?:AB|cd)efg[0-9]+hij") == [
        frozenset({"abe", "bef", "efg", "hij"}), frozenset({"cde", "def", "efg", "hij"})
    ]


def test_token_counts_against_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = transducer.count_tokens(frame(spark), PIECES, chunk=100).collect()
    assert len(got) == len(rows(odd_texts()))
    for row in got:
        assert row["n_tokens"] == len(library.encode(row["text"] or ""))
        assert row["n_bytes"] == len((row["text"] or "").encode()) and row["over_limit"] == (row["n_tokens"] > 4096)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunk_maps_compose(chunk):
    import sentencepiece

    library, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), transducer.Transducer.from_file(PIECES)
    for text in [*filter(None, odd_texts()[:12]), " ▁▁ a  b▁", "1234567890" * 9, "<s> </s> <0x0A>", "ab" * 200]:
        assert machine.count(text, chunk) == len(library.encode(text))


def test_text_without_spaces_is_held_once():
    """No chunk of it has a mark; prefixes of the scan must not each hold their text."""
    import sentencepiece

    library, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), transducer.Transducer.from_file(PIECES)
    for text in [prose(11, 15_000).replace(" ", "\n"), "日本語。" * 15_000, "ab" * 30_000]:
        assert machine.count(text, 64) == machine.count(text) == len(library.encode(text))
        tracemalloc.start()
        machine.count(text, 64)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16e6


def test_memory_is_bounded_within_a_text(monkeypatch):
    """A long text without spaces meets new states all along; the old ones go before it ends."""
    import sentencepiece

    library, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), transducer.Transducer.from_file(PIECES)
    letters = np.random.Generator(np.random.PCG64(6)).integers(97, 123, 400_000, np.uint8).tobytes().decode()
    monkeypatch.setattr(transducer, "MEMORY", 30_000)
    cleared, clear = [], machine.clear
    monkeypatch.setattr(machine, "clear", lambda: cleared.append(len(machine.states)) or clear())
    tracemalloc.start()
    assert machine.count(letters, 1024) == len(library.encode(letters))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(cleared) > 4 and max(cleared) < 60_000 and peak < 100e6


def test_forgotten_states_go_without_a_search_for_circles():
    """Counting is done with Python's search for circles of references off."""
    import gc

    machine = transducer.Transducer.from_file(PIECES)
    gc.collect()
    gc.disable()
    try:
        machine.count("some words \u2603 then \U0001f600 and more \u2603\u2603 words " * 3)
        assert len(machine.states) > 20
        machine.clear()
        left = [o for o in gc.get_objects() if isinstance(o, transducer.State) and o.machine is machine]
        assert len(left) == 1 and machine.count("words \u2603") > 0
    finally:
        gc.enable()


def test_encoder_against_library():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(BYTES), Encoder(BYTES)
    plain = Encoder(BYTES, plain=True)
    for text in [*filter(None, odd_texts()), "hi <|endoftext|> x", "a\x85b  c d 日本\n\n x  y"]:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert plain.decode(plain.encode(text)) == text


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    docs = frame(spark)
    got = [tuple(r) for r in packing.pack(docs, BYTES, capacity=256, group=8, every=3, grain=10).collect()]
    library, wanted = Tokenizer.from_file(BYTES), Counter()
    for doc, text, *_ in rows(odd_texts()):
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted[(doc, tuple([*ids, packing.END_ID]))] += 1
    starts = Counter((r[0], r[1], r[2], r[3], r[4]) for r in got)
    for (doc, ids), times in wanted.items():
        assert sum(r[2] for r in got if r[0] == doc and r[4] == len(ids)) % len(ids) == 0
        assert {r[1] for r in got if r[0] == doc and r[4] == len(ids)} >= {0}
    for doc, start, length, checksum, total in starts:
        assert any(
            d == doc and len(ids) == total
            and zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()) == checksum
            for d, ids in wanted
        )
    windows = {}
    for *_, length, _, _, sequence, offset in got:
        windows.setdefault(sequence, []).append((offset, length))
    for pieces in windows.values():
        reached = 0
        for offset, length in sorted(pieces):
            assert offset == reached and length > 0
            reached += length
        assert reached <= 256
    assert sum(r[2] for r in got) == sum(len(ids) * times for (_, ids), times in wanted.items())


def test_differencing_and_rising_window_count():
    lengths = [7, 6, 5, 4, 4, 3, 3, 2]
    sums = sorted(sum(lengths[i] for i in part) for part in packing.difference(lengths, 2))
    assert sums == [17, 17]
    parts = packing.windows_for([60, 60, 60], 100)  # two windows would have to hold 120
    assert sorted(map(len, parts)) == [1, 1, 1]
    assert packing.windows_for([], 100) == []


def test_fine_pieces_fill_the_windows():
    draw = np.random.Generator(np.random.PCG64(2))
    sizes = draw.integers(1, 2048, 512).tolist()
    pieces = packing.cut(sizes, packing.EVERY, packing.GRAIN)
    assert packing.joined(pieces) == [(n, 0, size) for n, size in enumerate(sizes)]
    parts = [p for p in packing.windows_for([length for *_, length in pieces], 2048) if p]
    assert all(sum(pieces[n][2] for n in part) <= 2048 for part in parts)
    assert sorted(n for part in parts for n in part) == list(range(len(pieces)))
    assert 1 - sum(sizes) / (2048 * len(parts)) < 0.03


def test_mixing_rates_and_copies(spark):
    texts = [prose(n, 5) for n in range(1500)]
    records = [(n, t, "en", "big" if n % 3 else ["a", "b", None][n % 9 // 3], None, None, None) for n, t in enumerate(texts)]
    docs = frame(spark, records)
    table = {r["mix_source"]: r for r in mixing.rates(docs).collect()}
    assert abs(sum(r["rate"] * r["n_docs"] for r in table.values()) - len(records)) < 1e-6
    got = mixing.mix(docs).collect()
    shares = Counter(r["source"] for r in got)
    assert all(abs(n - 375) < 90 for n in shares.values()) and len(shares) == 4
    copies = {}
    for r in got:
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    again = [tuple(r) for r in mixing.mix(docs).collect()]
    assert sorted(again, key=repr) == sorted(map(tuple, got), key=repr)
    heavy = mixing.mix(docs, weights={"a": 1.0}, default_weight=0.0, rows=50_000, copy_column=None)
    assert heavy.columns == docs.columns and {r[0] for r in heavy.select("source").distinct().collect()} == {"a"}
    assert abs(heavy.count() - 50_000) < 1500  # many parts of a large rate


def test_mixing_odd_rows(spark):
    assert mixing.mix(frame(spark)).columns == [*frame(spark).columns, "copy"]
    assert mixing.mix(frame(spark), rows=10_000).select("text").distinct().count() == len(set(odd_texts()))


def test_quality_rules_against_plain_counts(spark):
    docs = frame(spark)
    trusted = spark.createDataFrame([(5,), (10,), (10,), (None,)], "doc_id long")
    got = rules.judge(docs, trusted).collect()
    assert len(got) == docs.count()
    corpus, good = Counter(), Counter()
    for doc, text, *_ in rows(odd_texts()):
        grams = rules.trigrams(text or "").tolist()
        corpus.update(grams)
        if doc in (5, 10):
            good.update(grams)
    for row in got:
        text = row["text"] or ""
        words, lines = WORD.findall(text), text.split("\n")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        copies = sum(bool(WORD.search(line)) and line in lines[:n] for n, line in enumerate(lines))
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)
        )
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        grams = rules.trigrams(text).tolist()
        ratio = [
            np.log((good[g] + 1) / (good.total() + rules.BUCKETS)) - np.log((corpus[g] + 1) / (corpus.total() + rules.BUCKETS))
            for g in grams
        ]
        assert abs(row["log_ratio"] - (np.mean(ratio) if grams else 0)) < 1e-9
        assert row["kept"] == (not row["base_failed"] and row["log_ratio"] >= rules.THRESHOLD)


def test_quality_scores(spark):
    def junk(n):
        return " | ".join(prose(n, 60).split(" ")) if n % 2 else "same same " * 40

    records = [(n, junk(n) if n % 3 == 0 else prose(n, 80), None, None, None, None, None) for n in range(500)]
    docs = frame(spark, records + rows(odd_texts()))
    labels = spark.createDataFrame([(n, int(n % 3 != 0), 0) for n in range(500)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score").collect()
    assert len(scored) == len(records) + len(rows(odd_texts()))
    assert all(0 <= r["score"] <= 1 for r in scored)
    unseen = [r for r in scored if r["held_out"] and r["doc_id"] >= len(odd_texts())]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in unseen) and len(unseen) > 60
    right = sum((r["score"] >= quality.THRESHOLD) == (r["doc_id"] % 3 != 0) for r in unseen)
    assert right >= 0.97 * len(unseen)
    assert quality.fit(docs, labels.filter("quality = 1")) == 1.0 and quality.fit(docs, labels.limit(0)) == 0.5


def test_attention_slopes_match_differences():
    random = np.random.default_rng(1)
    features, counts = random.normal(size=(12, 267)), np.array([3, 0, 4, 5])
    labels = np.array([1.0, 0, 1, 0])
    model = quality.AttentionModel.fit(features, counts, labels)
    slopes = model._slopes(features, counts, labels)

    def loss():
        p = model.forward(features, counts)[-1]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name in ("W", "V", "U", "w", "c", "d"):
        weights = model.weights[name] = model.weights[name].astype(np.float64)
        at = tuple(0 for _ in weights.shape)
        weights[at] += 1e-5
        above = loss()
        weights[at] -= 2e-5
        below = loss()
        weights[at] += 1e-5
        assert abs((above - below) / 2e-5 - slopes[name][at]) < 1e-4


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert secrets.scan(empty).count() == mixing.mix(empty).count() == packing.pack(empty, BYTES).count() == 0
    assert transducer.count_tokens(empty, PIECES).count() == rules.judge(empty, empty.select("doc_id")).count() == 0
    assert quality.score(empty, quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
