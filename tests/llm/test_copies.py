"""Exact and near duplicates, and connected components, against brute force."""

import hashlib
import random
from itertools import combinations

import pytest

from ledgerlight.llm import exact, minhash
from ledgerlight.llm.components import components
from tests.llm.helpers import SCHEMA, WORD, changed, frame, odd_texts, prose, rows


def squeezed(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


@pytest.mark.parametrize("table_bytes", [exact.TABLE_BYTES, 300])
def test_exact_against_brute_force(spark, table_bytes):
    records = rows(odd_texts())
    got = exact.mark_copies(frame(spark), table_bytes=table_bytes).collect()
    assert len(got) == len(records)
    groups = {}
    for doc, text, *_ in records:
        groups.setdefault(squeezed(text), []).append((-len(text or ""), doc is None, doc or 0, doc))
    wanted = {hashlib.sha256(t.encode()).hexdigest(): (min(g)[3], len(g)) for t, g in groups.items()}
    kept = {}
    for row in got:
        assert (row["keep_id"], row["group_size"]) == wanted[row["text_sha256"]]
        kept.setdefault(row["text_sha256"], []).append(row["kept"])
    assert all(sum(flags) == 1 for flags in kept.values())


def test_exact_filter_keeps_columns_and_one_row_each(spark):
    got = exact.drop_copies(frame(spark))
    assert got.columns == frame(spark).columns
    texts = [squeezed(row["text"]) for row in got.collect()]
    assert len(texts) == len(set(texts)) == len({squeezed(t) for _, t, *_ in rows(odd_texts())})


def test_digest_clash_is_refused():
    table = exact.ContentTable()
    digest = b"\0" * 32
    table.fold([digest, b"one", 1, 3, 1, 1], True)
    with pytest.raises(ValueError):
        table.fold([digest, b"two", 1, 3, 2, 1], True)


def test_grace_partitions_until_buckets_fit():
    contents = [f"text {n % 400}".encode() for n in range(2000)]
    entries = [[hashlib.sha256(c).digest(), c, 1, len(c), n, 1] for n, c in enumerate(contents)]
    got = list(exact.grace(entries, table_bytes=2000))
    assert len(got) == 400 and all(e[2] == 5 for e in got)
    assert {e[1]: e[4] for e in got} == {f"text {n}".encode(): n for n in range(400)}


def shingle_set(text, size):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def near_rows():
    texts, draw = odd_texts(), random.Random(3)
    for base in range(6):
        text = prose(100 + base, 80 + 40 * base)
        texts += [changed(text, 1000 * base + n, draw.randint(0, 5)) for n in range(12)]
    chain = prose(200, 150)
    for n in range(6):  # each close to the one before, the ends far apart
        texts.append(chain)
        chain = changed(chain, 300 + n, 5)
    return rows(texts)


@pytest.mark.parametrize("words", [2, 5])
def test_near_against_brute_force(spark, words):
    records = near_rows()
    sets = [shingle_set(text, words) for _, text, *_ in records]
    parent = list(range(len(records)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(range(len(records)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    names = {}
    for n, record in enumerate(records):
        if record[0] is not None:
            names[top(n)] = min(names.get(top(n), record[0]), record[0])
    wanted = [
        (r[0], len(sets[n]), names.get(top(n)) if sets[n] else r[0]) for n, r in enumerate(records)
    ]
    got = minhash.link_near_copies(frame(spark, records), words=words).collect()
    assert sorted((repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)) == sorted(map(repr, wanted))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def template_rows():
    """A shared passage makes all pairs 0.75 to 0.79 alike; 40 pairs among them have 0.8 to 0.83."""
    template, draw = prose(500, 350).split(" "), random.Random(8)

    def own(count):
        return [f"y{draw.randrange(10**9)}" for _ in range(count)]

    texts = [" ".join(template + own(50)) for _ in range(1120)]
    for _ in range(40):
        tail = own(50)
        texts += [" ".join(template + tail[:12] + own(38)), " ".join(template + tail[:12] + own(38))]
    draw.shuffle(texts)
    return [(n, text, "en", "s1", len(text), "extra", "extra") for n, text in enumerate(texts)]


def test_near_links_within_a_template(spark):
    """The linked pairs share large buckets with many classes that no link reaches."""
    records = template_rows()
    sets = [shingle_set(r[1], 2) for r in records]
    shares, linked = [], {}
    for a, b in combinations(range(len(records)), 2):
        shared = len(sets[a] & sets[b])
        shares.append(shared / (len(sets[a]) + len(sets[b]) - shared))
        if shares[-1] >= 0.8:
            linked[b] = a
    assert len(linked) == 40 and all(0.75 <= s <= 0.83 for s in shares)
    got = {r["doc_id"]: r["component_id"] for r in minhash.link_near_copies(frame(spark, records), words=2).collect()}
    assert got == {n: linked.get(n, n) for n in range(len(records))}


def test_unlinked_copies_of_one_text_make_few_rows(spark, monkeypatch):
    """400 texts with six edits each: all pairs share most shingles, none reaches 0.8."""
    base = prose(77, 300)
    records = [(n, changed(base, n, 6), "en", "s1", 1, "extra", "extra") for n in range(400)]
    sets = [shingle_set(r[1], 5) for r in records]
    assert not any(
        100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in combinations(range(len(records)), 2)
    )
    made, rare = [], minhash._rare_pairs

    def counted(*given):
        pairs = minhash.stored(rare(*given))
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_rare_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.link_near_copies(frame(spark, records)).collect()}
    assert got == {n: n for n in range(400)}
    assert len(made) == 1 and made[0] < 1000  # of 79,800 pairs


def test_near_filter(spark):
    docs = frame(spark, near_rows())
    got = minhash.drop_near_copies(docs, words=2)
    assert got.columns == docs.columns
    kept = {r["component_id"] for r in minhash.link_near_copies(docs, words=2).collect()}
    ids = [r["doc_id"] for r in got.collect()]
    assert set(ids) == kept and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_components_of_random_graphs(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(n, n + 1) for n in range(100, 130)]
    parent = {}

    def top(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in edges:
        one, two = top(a), top(b)
        parent[max(one, two)] = min(one, two)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: top(n) for n in linked}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact.mark_copies(empty).count() == exact.drop_copies(empty).count() == 0
    assert minhash.link_near_copies(empty).count() == minhash.drop_near_copies(empty).count() == 0
    assert exact.drop_copies(empty).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
