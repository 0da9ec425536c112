"""Near-duplicate documents: MinHash bands, signature check, full sets, connected components.

Every document becomes its set of word shingles.  Documents with equal sets form a class; from
there on only classes move.  A class's sketch is the minima of many universal hash functions;
each band of them names a bucket.  Classes that share a bucket are compared with one anchor of the
bucket: first the sketches, then, where those may agree, the full sets.  Confirmed links are
grown to components by alternating large-star and small-star.

What is left are pairs of one bucket neither of which was its anchor, in different components.
Their classes are joined on rare shingles: with all sets in one order, rare shingles first, a pair
that reaches the threshold has its first common shingle so early in both that enough can follow.
Among equally large sets that is the first ninth at 0.8.  Where a group's sets have spent most of that
on shingles of their own, what all have in common still meets; there the parities of two sets, a
lower bound of their difference, refuse a pair inside the join, before it is a row.  No step lists the
pairs of a bucket, and a bucket, class or component of any size is only ever folded or joined.

Two documents are linked when intersection >= threshold * union of their sets.  With ``bands=40,
rows=6`` a pair at 0.8 shares no bucket with probability 5e-6, and sketches of linked sets fall
below the limit with probability 1e-4 at the threshold itself.  Null texts and texts without words
have an empty set and are linked with nothing.  Rows that repeat a row's id and text are one
document.  Null ids are never a component's name unless it has no other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm.common import free_name, map_batches, stored, text_of
from ledgerlight.llm.components import components
from ledgerlight.llm.shingles import Shingler, Sketcher

WORDS, THRESHOLD, BANDS, ROWS, SEED = 5, 80, 40, 6, 20240229
#: Standard deviations by which a sketch may fall short of the threshold.
SLACK = 3.8
#: A set's parities are those of its shingles' counts in 2**PARITY_BITS classes of hashes.
PARITY_BITS = 9
#: Earlier shingles that an entry carries, to tell a pair's first common one.
EARLIER = 16


def _row_key(id_column: str, text_column: str) -> Column:
    """128 bits of a row's id and text; null and empty texts differ."""
    text = F.concat(F.lit("="), F.col(f"`{text_column}`").cast("string"))
    return F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")), text))


def sketches(docs: DataFrame, words: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, digest of the set, buckets, sketch."""
    shingler, sketcher = Shingler(words), Sketcher(bands, rows, SEED)

    def sketch(batch: pa.RecordBatch):
        sizes, digests, buckets, minima = [], [], [], []
        for text in batch.column(2):
            prints = shingler(text.as_py())
            sizes.append(len(prints))
            if len(prints):
                least = sketcher.minima(prints)
                digests.append(hashlib.blake2b(prints.tobytes(), digest_size=16).hexdigest())
                buckets.append(np.unique(sketcher.buckets(least)))
                minima.append((least & np.uint32(255)).astype(np.uint8).tobytes())
            else:
                digests.append(None)
                buckets.append(None)
                minima.append(None)
        return batch.column(0), batch.column(1), sizes, digests, buckets, minima

    texts = docs.select(
        F.col(f"`{id_column}`").cast("long"), _row_key(id_column, text_column), text_of(text_column)
    )
    return map_batches(
        texts, sketch,
        "doc_id long, row_key string, n_shingles long, digest string, buckets array<long>, minima binary",
    )


def _agreeing(pairs: DataFrame, sketch: DataFrame, threshold: int, functions: int) -> DataFrame:
    """Pairs whose sketches do not rule the threshold out."""
    share = threshold / 100
    limit = share - SLACK * (share * (1 - share) / functions) ** 0.5
    least = functions * (limit + (1 - limit) / 256)  # the low byte of two minima agrees by chance

    def agree(batch: pa.RecordBatch):
        hub, leaf = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, functions) for i in (2, 3)
        )
        passed = pa.array((hub == leaf).sum(axis=1) >= least)
        return batch.column(0).filter(passed), batch.column(1).filter(passed)

    both = pairs
    for side in ("leaf", "hub"):
        both = both.join(sketch.select(F.col("node").alias(side), F.col("minima").alias(f"{side}_minima")), side)
    return map_batches(both.select("hub", "leaf", "hub_minima", "leaf_minima"), agree, "hub long, leaf long")


def _compared(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Pairs with the similarity of their full sets, and whether it reaches the threshold.

    Rows come sorted by hub, whose set is kept.
    """
    shingler = Shingler(words)

    def compare(batch: pa.RecordBatch):
        linked, closeness, known, prints = [], [], None, None
        for hub, hub_text, leaf_text in zip(batch.column(0).to_pylist(), *batch.columns[2:]):
            if known != hub:
                known, prints = hub, shingler(hub_text.as_py())
            other = shingler(leaf_text.as_py())
            shared = len(np.intersect1d(prints, other, assume_unique=True))
            union = len(prints) + len(other) - shared
            linked.append(100 * shared >= threshold * union)
            closeness.append(shared / union)
        return batch.column(0), batch.column(1), closeness, linked

    both = pairs
    for side in ("leaf", "hub"):
        both = both.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text")), side)
    return map_batches(
        both.select("hub", "leaf", "hub_text", "leaf_text"), compare,
        "hub long, leaf long, closeness double, linked boolean",
    )


def _same_size(one: str, two: str, threshold: int) -> Column:
    """Sets of sizes further apart cannot reach the threshold."""
    return 100 * F.least(one, two) >= threshold * F.greatest(one, two)


def _class_components(
    docs: DataFrame, classes: DataFrame, words: int, threshold: int, bands: int, rows: int,
    id_column: str, text_column: str,
) -> DataFrame:
    """(node, component) for classes that are linked with another one."""
    banded = classes.select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    first = banded.groupBy("bucket").agg(
        F.count("node").alias("size"), F.min(F.struct("node", "n_shingles")).alias("anchor")
    ).filter("size > 1")
    shared = stored(banded.join(first.select("bucket", "anchor"), "bucket"))

    needed = shared.select("node").distinct().join(classes.select("node", "row_key", "minima"), "node")
    needed = stored(needed)
    keyed = docs.select(_row_key(id_column, text_column).alias("row_key"), text_of(text_column).alias("text"))
    texts = stored(keyed.dropDuplicates(["row_key"]).join(needed.select("node", "row_key"), "row_key").drop("row_key"))

    def compare(pairs: DataFrame) -> DataFrame:
        likely = _agreeing(pairs.distinct(), needed.select("node", "minima"), threshold, bands * rows)
        return stored(_compared(likely, texts, words, threshold))

    first = compare(
        shared.filter(F.col("node") != F.col("anchor.node"))
        .filter(_same_size("n_shingles", "anchor.n_shingles", threshold))
        .select(F.col("anchor.node").alias("hub"), F.col("node").alias("leaf"))
    ).filter("linked").select("hub", "leaf")
    labels = stored(components(first, "hub", "leaf"))
    left = stored(_unresolved(shared, labels))
    more = compare(_rare_pairs(left, texts, words, threshold)).filter("linked").select("hub", "leaf")
    if more.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("hub"), F.col("component").alias("leaf"))
    return components(known.union(more), "hub", "leaf")


def _unresolved(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component) of classes in a bucket that holds several components besides its anchor's pairs."""
    rest = shared.filter(F.col("node") != F.col("anchor.node")).select("bucket", "node")
    known = rest.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_buckets = known.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most")
    ).filter("least <> most").select("bucket")
    return known.join(open_buckets, "bucket", "left_semi").select("node", "component").distinct()


def _rare_pairs(nodes: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """(hub, leaf) for all pairs of different components that can reach the threshold.

    A pair of sizes a and b reaches it with ``(100 + threshold) * common >= threshold * (a + b)``,
    and at most ``size - place`` shingles are common from the first common one on.  Shingles of one
    component only can be common to no such pair, so they take the first places; the others follow by
    their exact counts.  A pair is given at its first common shingle.
    """
    shingler, shift = Shingler(words), np.uint64(64 - PARITY_BITS)

    def spell(batch: pa.RecordBatch):
        sizes, parities, prints = [], [], []
        for text in batch.column(2):
            found = shingler(text.as_py())
            odd = np.bincount((found >> shift).astype(np.int64), minlength=1 << PARITY_BITS) & 1
            sizes.append(len(found))
            parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            prints.append(found.view(np.int64))
        return batch.column(0), batch.column(1), sizes, parities, prints

    named = texts.join(nodes, "node").select("node", "component", "text")
    spelt = stored(map_batches(
        named, spell, "node long, component long, size long, parity array<long>, prints array<long>"
    ))
    single = spelt.select("node", "component", F.explode("prints").alias("shingle"))
    met = stored(
        single.groupBy("shingle", "component").agg(F.count("node").alias("n")).groupBy("shingle").agg(
            F.sum("n").alias("n"), F.max(F.struct("n", "component"))["component"].alias("main"),
            F.count("component").alias("parts"),
        ).filter("parts > 1").drop("parts")
    )
    shared = single.join(met, "shingle").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "shingle", "main"))).alias("shared")
    )
    # the other set has threshold % of this one's size at least
    begun = spelt.drop("prints").join(shared, "node").withColumn("own", F.col("size") - F.size("shared")).withColumn(
        "prefix", F.slice("shared", 1, F.greatest(F.lit(0), F.expr(
            f"cast(size - ceil({threshold} * size / 100) + 1 - own AS int)"
        )))
    ).select("node", "component", "size", "parity", "own", "prefix", F.posexplode("prefix").alias("at", "one"))
    begun = stored(begun.select(
        "node", "component", "size", "parity", "one.shingle", "one.main", (F.col("own") + F.col("at")).alias("place"),
        F.slice("prefix.shingle", F.lit(1), F.least("at", F.lit(EARLIER))).alias("earlier"),
    ))

    def reaches(side: str) -> Column:
        least = threshold * (F.col("a.size") + F.col("b.size"))
        return (100 + threshold) * (F.col(f"{side}.size") - F.col(f"{side}.place")) >= least

    # a class of hashes that holds an odd number of one set and an even one of the other tells a difference
    differ = sum(
        F.bit_count(F.col("a.parity")[n].bitwiseXOR(F.col("b.parity")[n])) for n in range((1 << PARITY_BITS) // 64)
    )
    near = (100 + threshold) * differ <= (100 - threshold) * (F.col("a.size") + F.col("b.size"))
    # of a pair one side at least is outside the shingle's main component
    early = begun.filter((100 + threshold) * (F.col("size") - F.col("place")) >= 2 * threshold * F.col("size"))
    larger = F.struct("a.size", "a.node") < F.struct("b.size", "b.node")
    parts = []
    for short, long in (
        (early.filter("component <> main"), begun), (early.filter("component = main"), begun.filter("component <> main"))
    ):
        parts.append(
            short.alias("a").join(
                long.alias("b"),
                (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component"))
                & larger & reaches("a") & reaches("b") & near & ~F.arrays_overlap("a.earlier", "b.earlier"),
            ).select(F.col("a.node").alias("hub"), F.col("b.node").alias("leaf"))
        )
    return parts[0].union(parts[1])


def _resolved(
    docs: DataFrame, words: int, threshold: int, bands: int, rows: int, id_column: str, text_column: str
) -> tuple[DataFrame, DataFrame]:
    """The documents' sketches, and per digest the id and row that names its component."""
    sketched = stored(sketches(docs, words, bands, rows, id_column, text_column))
    classes = (
        sketched.filter("n_shingles > 0").groupBy("digest")
        .agg(F.first(F.struct("row_key", "n_shingles", "buckets", "minima")).alias("one"),
             F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("least"))
        .select("digest", "one.*", "least", F.monotonically_increasing_id().alias("node"))
    )
    classes = stored(classes)
    labels = _class_components(docs, classes, words, threshold, bands, rows, id_column, text_column)
    labelled = (
        classes.select("digest", "least", "node").join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = labelled.groupBy("component").agg(F.min("least").alias("name"))
    return sketched, labelled.join(names, "component").select("digest", "name")


def link_near_copies(
    docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    sketched, names = _resolved(docs, words, threshold, bands, rows, id_column, text_column)
    return sketched.select("doc_id", "n_shingles", "digest").join(stored(names), "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(
    docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The rows that name their component, all columns unchanged; texts without words stay."""
    sketched, names = _resolved(docs, words, threshold, bands, rows, id_column, text_column)
    key = free_name(docs, "_row_key")
    kept = names.select(F.col("name.row_key").alias(key)).union(
        sketched.filter("n_shingles = 0").select(F.col("row_key").alias(key))
    ).distinct()
    keyed = docs.withColumn(key, _row_key(id_column, text_column)).dropDuplicates([key])
    return keyed.join(stored(kept), key, "left_semi").drop(key)
