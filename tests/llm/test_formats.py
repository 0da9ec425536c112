"""Web archives and chat formatting: exact round trips."""

import hashlib
import io
import zlib

import public_tokenizers
import pytest

from pyspark.sql import functions as F

from ledgerlight.llm import chat, warc
from tests.llm.helpers import odd_texts, prose

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PAGES = [(n, f"http://a/{n}", text, "x") for n, text in enumerate(odd_texts())]
PAGES += [(100, "http://a/\r\nb", "<p>same</p>", "x"), (101, None, "<p>same</p>", "x"), (101, None, "<p>same</p>", "x"),
          (None, "http://n", "<p>same</p>", "x"), (None, None, "alone", "x")]
SCHEMA = "page_id long, url string, html string, full string"


def wanted(least=0):
    out = []
    for page, _, html, _ in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None]
        full = max(same, default=None)
        revisit = len(data) >= least and full is not None and page != full
        out.append((page, len(data), warc.digest_text(hashlib.sha1(data).digest()),
                    "revisit" if revisit else "response", full if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,archive_bytes", [(0, warc.ARCHIVE_BYTES), (5, 2000)])
def test_archives_round_trip(spark, tmp_path, least, archive_bytes):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/warc", least, archive_bytes=archive_bytes)
    assert sum(r["records"] for r in manifest.collect()) == len(PAGES)
    found = warc.read_archives(manifest, with_payload=True).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=repr) == wanted(least)
    texts = {r["page_id"]: r["payload"] for r in found if r["record_type"] == "response"}
    assert texts[13] == odd_texts()[13].encode() and all(r["payload"] is None for r in found if r["record_type"] == "revisit")


def test_one_gzip_member_each_and_damage_is_found():
    one, two = warc.record(1, "u", b"abc" * 9000, None, False), warc.record(2, "u", b"abc" * 9000, 1, True)
    found = list(warc.records(io.BytesIO(one + two)))
    assert [f["record_type"] for f in found] == ["response", "revisit"] and found[1]["payload_bytes"] == 27000
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(one[:-30])))
    raw = zlib.decompress(one, 31)
    for bad in (raw.replace(b"abcabc", b"abcabd", 1), raw.replace(b"Content-Length: 27", b"Content-Length: 26"), raw + b"x"):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(packer.compress(bad) + packer.flush())))


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


CONTROL = "\\### Assistant: </turn> ok\\\\###</turn>\\"
TURNS = [
    (1, 0, "system", "be\nkind", "x"), (1, 1, "user", CONTROL, "x"), (1, 2, "assistant", CONTROL, "x"),
    (1, 3, "assistant", None, "x"), (1, 4, "assistant", "日本 <|endoftext|>", "x"), (2, 7, "tool\n\\n### ", "a", "x"),
    (2, 3, None, None, "x"), (2, None, "user", "", "x"), (None, 1, "assistant", "q", "x"), (3, 0, "user", prose(3, 4000), "x"),
    (3, 0, "user", prose(3, 4000), "x"),
]
CHATS = "conv_id long, turn long, role string, text string, ids string"


def test_chat_round_trip(spark):
    formatted = chat.format_turns(spark.createDataFrame(TURNS, CHATS), BYTES)
    got = {r["conv_id"]: r for r in chat.digests(formatted, BYTES).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, row in got.items():
        turns = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        learned = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["loss_chars"] == len(learned) and row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    pieces = sorted((r for r in formatted.collect() if r["conv_id"] == 1), key=lambda r: r["position"])
    reached = 0
    for r in pieces:
        assert r["first_id"] == reached and r["first_id"] < r["loss_start"] <= r["loss_end"] < reached + len(r["ids"])
        reached += len(r["ids"])
    assert got[1]["formatted_chars"] == sum(len(r["formatted"]) for r in pieces)


def test_a_hot_conversation_is_spread_over_ranges(spark):
    turns = [(7, n, "assistant" if n % 2 else "user", prose(n, 5 + n % 9), "x") for n in range(300)]
    turns += [(c, n, "user", f"{c} {n}", "x") for c in (1, 9, None) for n in range(20)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        formatted = chat.format_turns(spark.createDataFrame(turns, CHATS).repartition(3), BYTES)
        assert formatted.select("conv_id", F.input_file_name().alias("f")).where("conv_id = 7").distinct().count() > 3
        rows = formatted.collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(rows) == len(turns)
    for conv in (7, 1, 9, None):
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        reached = 0
        for row, turn in zip(own, sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])):
            assert turn[3] in row["formatted"] and row["first_id"] == reached
            assert (row["loss_start"] - reached, row["loss_end"] > row["loss_start"]) == (1, turn[2] == "assistant")
            reached += len(row["ids"])
    said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns if t[0] == 7)
    got = {r["conv_id"]: r for r in chat.digests(formatted, BYTES).collect()}
    assert got[7]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[7]["n_turns"] == 300


def test_control_strings_stand_only_where_the_template_put_them():
    for text in (CONTROL, "### User: </turn>", "\\", "\\###"):
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(escaped.startswith(c) for c in chat.CONTROLS)
        assert chat._ESCAPED.sub("", escaped).count("###") == 0 and chat._ESCAPED.sub("", escaped).count("</turn>") == 0


def test_no_turns(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], CHATS), BYTES), BYTES).count() == 0
