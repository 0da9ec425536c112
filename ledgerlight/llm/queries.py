"""Registered queries of the text operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.llm import (
    chat, exact, leaks, minhash, mixing, packing, periodic, quality, resampling, rules, secrets, transducer, warc,
)
from ledgerlight.llm.common import WORD, read, text_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = secrets.scan(read(spark, folder, "documents"))
    return scanned.select("doc_id", *secrets.summary(scanned))


def _secrets_sql() -> str:
    """Spans per rule from what lies between the matches; ``least`` as in the rules."""
    parts = []
    for number, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT row, {number} AS number, '{rule.kind}' AS kind,
         regexp_split_to_array(t, '{pattern}') AS gaps,
         regexp_extract_all(t, '{pattern}', 0) AS found,
         regexp_extract_all(t, '{pattern}', {rule.group}) AS asked, {rule.least} AS least
  FROM texts""")
    base = len(secrets.BASE_RULES)
    counts = ", ".join(
        f"coalesce(count(*) FILTER (number = {n}), 0) AS n_{r.kind}" for n, r in enumerate(secrets.BASE_RULES)
    )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({" UNION ALL ".join(parts)}),
numbered AS (
  SELECT row, number, kind, gaps, found, least, asked, unnest(range(1, len(found) + 1)) AS i FROM matched
), spans AS (
  SELECT row, number, kind,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start,
         length(found[i]) AS size
  FROM numbered WHERE length(asked[i]) >= least
), shown AS (
  SELECT row, number, start::BIGINT AS start,
         kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM spans
), folded AS (
  SELECT row, {counts},
         string_agg(span, ',' ORDER BY start, number) FILTER (number < {base}) AS base,
         string_agg(span, ',' ORDER BY start, number) AS spans
  FROM shown GROUP BY row
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN folded USING (row)
"""


ORACLES["op1_secret_scan"] = _secrets_sql()


@query
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.link_near_copies(read(spark, folder, "documents"), words=2)


@query
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.mark_copies(read(spark, folder, "documents"))


ORACLES["op3_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM texts WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""


@query
def op4_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, folder, "labels")))
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    counted = transducer.count_tokens(read(spark, folder, "documents"), model)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Equal weights for all sources, as many rows as there are documents."""
    return mixing.mix(read(spark, folder, "documents"))


ORACLES["op7_mix_sources"] = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, rate, greatest(1, ceil(rate / {mixing.PART}))::BIGINT AS parts
  FROM (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS rate
        FROM sizes)
), cdf AS (
  SELECT source, parts, rate / parts AS r, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS edge FROM rates
  UNION ALL
  SELECT source, parts, r, k + 1, p * r / (k + 1), edge + p * r / (k + 1) FROM cdf WHERE k < {mixing.PART + mixing.TAIL}
), edges AS (SELECT source, parts, list(edge ORDER BY k) AS edges FROM cdf GROUP BY source, parts),
keyed AS (
  SELECT d.*, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key, parts, edges
  FROM documents d JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
), drawn AS (
  SELECT *, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(edges, lambda e:
      ('0x' || substr(md5('{mixing.SEED}|' || i || '|' || key), 1, 12))::BIGINT / {float(1 << 48)} >= e)))) AS copies
  FROM keyed
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, copies::BIGINT)) AS copy FROM drawn
"""


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = read(spark, folder, "labels").filter("quality = 1")
    judged = rules.judge(read(spark, folder, "documents"), trusted)
    return judged.select("doc_id", "n_words", *rules.COLUMNS, "base_failed", "kept", "log_ratio")


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(read(spark, folder, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         list_aggregate(list_transform(string_split(sha1(coalesce(html, '')), ''),
           lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS full_id
  FROM pages
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         list_sum(list_transform(range(0, 5), lambda k: substr(bits, 5 * i + k + 1, 1)::BIGINT * (16 >> k::INT)))::BIGINT
           + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = full_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> full_id THEN full_id END AS refers_to
FROM hashed
"""


@query
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one, numbered -7, whose texts hold control strings."""
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return chat.digests(chat.format_turns(rows.unionByName(odd), tokenizer), tokenizer)


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(
        read(spark, folder, "documents"), read(spark, folder, "benchmark"), carry=["doc_id"]
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(table: str, key: str) -> str:
    return f"""SELECT row_number() OVER () AS r, {key},
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_LETTERS}') AS w
  FROM {table}"""


#: CRC-32 from its polynomial, once per distinct word.
ORACLES["op11_importance_resampling"] = f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS ({_words_sql("documents", "doc_id")}),
target AS ({_words_sql("benchmark", "item_id")}),
told AS (SELECT r, unnest(w) AS word FROM docs),
goal AS (SELECT unnest(w) AS word FROM target),
vocabulary AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(word))),
           lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket
  FROM (SELECT word FROM told UNION SELECT word FROM goal) v, crc
), s AS (SELECT bucket, count(*) AS n FROM told JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM told) + {resampling.BUCKETS})
           / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM goal) + {resampling.BUCKETS}))))::BIGINT AS gain
  FROM range({resampling.BUCKETS}) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
), weights AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM told JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, n >= {resampling.LEAST_WORDS} AS able,
         row_number() OVER (PARTITION BY n >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place
  FROM scored
)
SELECT doc_id, n AS n_features, n AS n_words, weight, score,
       CASE WHEN able AND place <= {resampling.PERCENT} * (SELECT count(*) FROM ranked WHERE able) // 100 THEN place END AS rank
FROM ranked
"""


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose id's CRC-32 ends in 0 get a periodic end first."""

    @F.pandas_udf("string")
    def planted(hashes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([periodic_end(h, text) for h, text in zip(hashes, texts)], dtype=object)

    docs = read(spark, folder, "documents")
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = periodic.mark_runs(docs.select("doc_id", planted(hashed, text_of()).alias("text")))
    return marked.select("doc_id", *periodic.digests(marked))


def periodic_end(h: int | None, text: str) -> str:
    """The text, or if ``h`` ends in 0 its words, from one on repeating the ones before."""
    if h is None or h != h or int(h) % 10:
        return text
    words, g = WORD.findall(text), int(h) // 10
    if not words:
        return text
    start = g % len(words)
    period = 1 + (len(words) - start) // (3 + g % 8)
    return " ".join(words[:start] + [words[start + (i - start) % period] for i in range(start, len(words))])


@query
def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", *leaks.summary())


ORACLES["op13_decontamination"] = f"""
WITH docs AS ({_words_sql("documents", "doc_id")}),
items AS ({_words_sql("benchmark", "item_id")}),
windows AS (
  SELECT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM (
    SELECT *, unnest(range(1, len(w) - size + 2)) AS i
    FROM (SELECT item_id, w, least(len(w), {leaks.WINDOW}) AS size FROM items WHERE len(w) > 0))
), sizes AS (SELECT DISTINCT size FROM windows),
cut AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS words FROM (
    SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), hits AS (SELECT r, i, size, item_id FROM cut JOIN windows USING (size, words)),
hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM hits) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
