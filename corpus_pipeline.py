"""From raw documents to packed training windows, in five stages.

Each stage works on what the one before it kept, written as Parquet into the shared folder and
read again.  All stages but the last return the columns of ``documents``, further ones included.

Null texts count as empty and null ids, languages and sources are values like others; texts of any
length are read whole.  An empty table passes every stage and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.llm import exact, minhash, mixing, packing, quality
from ledgerlight.llm.common import free_name, read, stored


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Empty and null texts are scored like an empty bag of passages; repeated rows are judged alike; without
    labels of both kinds all documents get one score.
    """
    name = free_name(docs, "_score")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, name).filter(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the one of the smallest id.

    All empty and null texts are one group; of repeated rows one stays; null ids come after all others.
    """
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles stays.

    It is the one of the smallest id; ties of repeated rows leave one row.  Texts without words are
    linked with nothing and stay.
    """
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of as many rows as there are; documents repeat or go.

    A null source is a source; a repeated row draws like its twin.
    """
    return mixing.mix(docs, copy_column=None)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens lies in the training windows.

    An empty or null text is one end id; repeated documents are packed one by one.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_tokens),
]

#: Learned scores, hash sketches and differencing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
