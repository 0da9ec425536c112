"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages; only the document has a label.  Every passage is encoded, a gated
attention unit learns how much each counts, and the score is that of the weighted passage vector:

    h = tanh(x W + b),  e = w . (tanh(h V) * sigmoid(h U)),  a = softmax(e),  score = sigmoid(c . sum a h + d)

All weights are fitted together, by Adam on the documents' cross-entropy.  The fit sees a bounded
sample: the ``sample`` labelled documents with the smallest hash of their id, those of more than
``LONGEST`` passages left out, and ``passages`` passages in all at most (32 MB of features on the
driver).  Scoring reads every passage of every document.

Inputs are the text alone.  A text without words has no passages and gets the score of an empty
bag; null counts as empty.  Without labels of both kinds every score is that of the kind there is,
or 0.5.  Repeated rows are scored alike; an empty table gives an empty result.  The score replaces a
column of its name; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm import passages
from ledgerlight.llm.common import map_batches, stored, text_of

SAMPLE, LONGEST, PASSAGES = 3000, 512, 60_000
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 12, 64, 0.01, 3e-2


def held_out(id_column: str = "doc_id") -> Column:
    """A fifth of the documents, never learned from: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bags(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and how many each text has."""
    found, owners, held, size = [], [], [], 0

    def flush():
        nonlocal size
        if held:
            features, counts = passages.encode([piece for _, piece in held])
            found.append(features)
            owners.append(np.repeat([owner for owner, _ in held], counts))
            held.clear()
            size = 0

    for number, text in enumerate(texts):
        for piece in passages.windows(text.encode("utf-8", "surrogatepass")):
            held.append((number, piece))
            size += len(piece)
            if size > passages.WINDOW:
                flush()
    flush()
    if not found:
        return np.zeros((0, passages.WIDTH), np.float32), np.zeros(len(texts), np.int64)
    return np.concatenate(found), np.bincount(np.concatenate(owners), minlength=len(texts))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Weights by name: W, b (encoder), V, U, w (attention), c, d (score), with input scaling."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray) -> None:
        self.weights, self.mean, self.scale = weights, mean, scale

    def forward(self, features: np.ndarray, counts: np.ndarray):
        p = self.weights
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(features @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        filled = counts > 0  # a bag's passages lie together
        starts = (np.cumsum(counts) - counts)[filled]
        a, pooled = e, np.zeros((len(counts), h.shape[1]))
        if len(starts):
            a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts[filled]))
            a = a / np.repeat(np.add.reduceat(a, starts), counts[filled])
            pooled[filled] = np.add.reduceat(a[:, None] * h, starts)
        return bag, h, t, g, a, pooled, _sigmoid(pooled @ p["c"] + p["d"][0])

    def score(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward((features - self.mean) / self.scale, counts)[-1]

    @classmethod
    def fit(cls, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 5) -> AttentionModel:
        random = np.random.default_rng(seed)
        mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        features = ((features - mean) / scale).astype(np.float32)
        share = np.clip(labels.mean(), 0.01, 0.99)
        weights = {
            "W": random.normal(0, features.shape[1] ** -0.5, (features.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
            "V": random.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": random.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "w": random.normal(0, GATE**-0.5, GATE), "c": random.normal(0, HIDDEN**-0.5, HIDDEN),
            "d": np.array([np.log(share / (1 - share))]),
        }
        weights = {name: value.astype(np.float32) for name, value in weights.items()}
        model = cls(weights, mean, scale)
        moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in weights.items()}
        edges = np.concatenate([[0], np.cumsum(counts)])
        step = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(counts))
            for n in range(0, len(order), BATCH):
                chosen = order[n:n + BATCH]
                rows = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in chosen])
                slopes = model._slopes(features[rows], counts[chosen], labels[chosen])
                step += 1
                for name, slope in slopes.items():
                    one, two = moments[name]
                    one += 0.1 * (slope - one)
                    two += 0.001 * (slope * slope - two)
                    move = one / (1 - 0.9**step) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
                    weights[name] -= (RATE * (move + DECAY * weights[name])).astype(np.float32)
        return model

    def _slopes(self, features, counts, labels) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        p = self.weights
        bag, h, t, g, a, pooled, score = self.forward(features, counts)
        error = (score - labels) / len(labels)
        outer = error[:, None] * p["c"]
        da = (outer[bag] * h).sum(axis=1)
        de = a * (da - np.bincount(bag, a * da, minlength=len(counts))[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * outer[bag] + dt @ p["V"].T + dg @ p["U"].T
        dz = (dh * (1 - h * h)).astype(np.float32)
        return {
            "W": features.T @ dz, "b": dz.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
            "c": pooled.T @ error, "d": np.array([error.sum()]),
        }


def fit(
    docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id",
    text_column: str = "text", sample: int = SAMPLE, most: int = PASSAGES,
) -> AttentionModel | float:
    """The model; or the score to give everything if there are not labels of both kinds.

    At most ``sample`` labels, and the features of as many documents with ``most`` passages together,
    reach the driver.
    """
    draw = F.xxhash64(F.lit("fit"), "id")
    chosen = (
        labels.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id"))
        .groupBy("id").agg(F.max("label").alias("label")).orderBy(draw).limit(sample)
    )
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text_of(text_column).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")  # at most ``sample`` rows

    def measure(batch: pa.RecordBatch):
        ids, known, found = [], [], []
        for doc, label, text in zip(*batch.columns):
            features, counts = bags([text.as_py()])
            if counts[0] <= LONGEST:
                ids.append(doc)
                known.append(label)
                found.append(features.astype(np.float16).tobytes())
        return ids, known, found

    measured = stored(
        map_batches(rows, measure, "id long, label int, features binary")
        .withColumn("draw", draw).withColumn("passages", F.octet_length("features") / (2 * passages.WIDTH))
    )
    order = ["draw", "features"]
    sizes = measured.orderBy(*order).limit(sample).select("passages").collect()
    taken = int((np.cumsum([row["passages"] for row in sizes]) <= most).sum())
    got = measured.orderBy(*order).limit(taken).collect()
    known = np.array([row["label"] for row in got], np.float32)
    if len(set(known.tolist())) < 2:
        return float(known[0]) if len(known) else 0.5
    found = [np.frombuffer(row["features"], np.float16).reshape(-1, passages.WIDTH) for row in got]
    counts = np.array([len(f) for f in found])
    return AttentionModel.fit(np.concatenate(found).astype(np.float32), counts, known)


def score(docs: DataFrame, model: AttentionModel | float, output: str = "score", text_column: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    if isinstance(model, float):
        return docs.withColumn(output, F.lit(model))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out, part, size = [], [], 0
        for text in texts:  # by parts, so that features of one part are held at a time
            part.append(text)
            size += len(text)
            if size > 4 * passages.WINDOW:
                out.append(model.score(*bags(part)))
                part, size = [], 0
        if part:
            out.append(model.score(*bags(part)))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.withColumn(output, scored(text_of(text_column)))
