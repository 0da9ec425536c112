"""The corpus pipeline stage by stage, against plain versions of every stage."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from ledgerlight.llm import mixing, passages, quality
from tests.llm.helpers import WORD, changed, odd_texts, prose

FOLDER = os.environ.get("LEDGERLIGHT_TESTDATA", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = " \t\n\x0b\x0c\r"


def documents():
    """Good and bad texts, exact and near copies, repeated rows, nulls and empties."""
    texts = [prose(n, 60 + n) for n in range(60)]
    texts += [" | ".join(prose(n, 70).split(" ")) if n % 2 else "same same " * 40 for n in range(60, 100)]
    texts += [texts[3], texts[3] + " \n", texts[4].upper(), changed(texts[5], 1, 1), changed(texts[6], 2, 30)]
    texts += [*odd_texts(), changed(prose(900, 150), 1, 2), changed(prose(900, 150), 2, 2), changed(prose(900, 150), 3, 2)]
    rows = [(n, t, "en", ["big", "big", "a", None][n % 4], None if t is None else len(t)) for n, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, texts[7], None, "a", None), (None, None, None, None, None)]


def labels():
    return [(n, int(n < 60), 0) for n in range(100)] + [(None, 1, 0), (7, None, 0)]


def plain_features(text):
    """Passages of 64 words with their statistics, one by one."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out = []
    for n in range(0, len(words), passages.WORDS):
        own = words[n:n + passages.WORDS]
        end = words[n + passages.WORDS][0] if n + passages.WORDS < len(words) else words[-1][1]
        whole, after = text[own[0][0]:end].encode(), text[end:words[-1][1]].encode()
        wide = whole + (after + b"\n\n")[:2]
        grams = Counter()
        for i in range(len(whole)):
            grams[((wide[i] << 16 | wide[i + 1] << 8 | wide[i + 2]) * 2654435761 % (1 << 32)) >> 24] += 1
        said = [text[a:b].encode() for a, b in own]
        classes = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>{}[]~^=_\\/@+", "!?", ".,;:'\"()-", "\n")
        shares = [sum(chr(b) in letters for b in whole) for letters in classes] + [sum(b >= 128 for b in whole)]
        out.append([
            *(math.sqrt(grams[k] / len(whole)) for k in range(passages.BINS)), *(s / len(whole) for s in shares),
            len(set(said)) / len(said), sum(a == b for a, b in zip(said, said[1:])) / len(said),
            len(whole) / len(said) / 16, len(said) / passages.WORDS,
        ])
    return np.array(out).reshape(-1, passages.WIDTH)


def plain_score(model, text):
    p, sigmoid = model.weights, lambda x: 1 / (1 + math.exp(-x))
    h = np.tanh(((plain_features(text) - model.mean) / model.scale) @ p["W"] + p["b"])
    e = np.array([float((np.tanh(row @ p["V"]) / (1 + np.exp(-(row @ p["U"])))) @ p["w"]) for row in h])
    a = np.exp(e - e.max()) if len(e) else e
    pooled = (a[:, None] * h).sum(axis=0) / a.sum() if len(e) else np.zeros(h.shape[1])
    return sigmoid(float(pooled @ p["c"] + p["d"][0]))


def squeezed(text):
    return (text or "").translate({ord(c): None for c in WHITE})


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def plain_near(rows):
    """One row of each component of texts that share 0.8 of their shingles, all pairs compared."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return [{tuple(rows[n]) for n in range(len(rows)) if top(n) == root} for root in range(len(rows)) if top(root) == root], sets


def plain_copies(row, rate):
    parts = max(1, math.ceil(rate / mixing.PART))
    edges, p = [], math.exp(-rate / parts)
    for k in range(mixing.PART + mixing.TAIL + 1):
        edges.append((edges[-1] if edges else 0) + p)
        p = p * (rate / parts) / (k + 1)
    key = hashlib.md5(f"{'' if row[0] is None else row[0]}|{row[1] or ''}".encode()).hexdigest()
    draws = [
        int(hashlib.md5(f"{mixing.SEED}|{i}|{key}".encode()).hexdigest()[:12], 16) / float(1 << 48) for i in range(1, parts + 1)
    ]
    return sum(sum(u >= edge for edge in edges) for u in draws)


def test_every_stage_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, stages = documents(), dict(corpus_pipeline.STAGES)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def after(name, rows):
        docs = spark.createDataFrame(rows, SCHEMA)
        got = corpus_pipeline.stored(stages[name](spark, docs, str(tmp_path)))
        return got.columns, [tuple(r) for r in got.collect()]

    columns, kept = after("quality_classifier", rows)
    model = quality.fit(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = [plain_score(model, r[1] or "") for r in rows]
    assert min(abs(s - quality.THRESHOLD) for s in scores) > 1e-4
    wanted = [r for r, s in zip(rows, scores) if s >= quality.THRESHOLD]
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(kept) == Counter(wanted) and {r[0] for r in wanted} >= set(range(60)) and len(wanted) < len(rows) - 30

    columns, unique = after("exact_dedup", kept)
    groups = {}
    for r in kept:
        groups.setdefault(squeezed(r[1]), []).append(r)
    best = {t: min((-len(r[1] or ""), r[0] is None, r[0] or 0) for r in g) for t, g in groups.items()}
    assert len(columns) == 5 and len(unique) == len(groups)
    assert {squeezed(r[1]): (-len(r[1] or ""), r[0] is None, r[0] or 0) for r in unique} == best

    columns, apart = after("minhash_near_dedup", unique)
    parts, _ = plain_near(unique)
    assert len(columns) == 5 and len(apart) == len(parts) <= len(unique) - 3
    assert all(sum(r in part for r in apart) == 1 for part in parts)

    columns, mixed = after("mix_sources", apart)
    sizes = Counter(r[3] for r in apart)
    wanted = Counter()
    for r in apart:
        wanted[r] = plain_copies(r, len(apart) / len(sizes) / sizes[r[3]])
    assert len(columns) == 5 and Counter(mixed) == +wanted

    columns, pieces = after("pack", mixed)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[:2]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in mixed}
    by = [dict(zip(columns, piece)) for piece in pieces]
    assert sum(p["length"] for p in by) == sum(len(ids[r[:2]]) for r in mixed)
    texts = Counter((d, len(i)) for (d, _), i in ids.items())
    for p in by:
        assert any(
            d == p["doc_id"] and len(i) == p["doc_tokens"]
            and zlib.crc32(np.array(i[p["start"]:p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
            for (d, _), i in ids.items()
        )
    for doc, size in texts:
        own = Counter(i for p in by if (p["doc_id"], p["doc_tokens"]) == (doc, size) for i in range(p["start"], p["start"] + p["length"]))
        assert set(own) == set(range(size)) and len(set(own.values())) == 1
    windows = {}
    for p in by:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in windows.values():
        reached = 0
        for offset, length in sorted(held):
            assert offset == reached
            reached += length
        assert reached <= 2048

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == columns and sum(r["length"] for r in whole.collect()) == sum(p["length"] for p in by)


def test_features_do_not_depend_on_neighbours():
    texts = ["  alpha beta,\n gamma ", "", "\n\n zeta eta ", prose(1, 150), " x"]
    together, counts = quality.bags(texts)
    apart = [quality.bags([t])[0] for t in texts]
    assert counts.tolist() == [len(a) for a in apart] == [1, 0, 1, 3, 1]
    assert np.array_equal(together, np.concatenate(apart))
    assert np.allclose(together, np.concatenate([plain_features(t) for t in texts]), atol=1e-6)


def test_empty_tables_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0, name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
