"""Toxicity: a factorization machine over hashed terms.

A document is its set of terms (ASCII lower case, punctuation cut off), hashed to ``2 ** BITS`` buckets. Every bucket
of the training sample is a feature, and a factorization machine learns a weight for each and a vector whose products
weigh pairs. Interactions such as an insult with a group mention thus get a weight of their own, also where one of
them is neutral alone. No term is left out for its count or z-score: these set how fast it learns, so that the many
rare and unmarked terms don't drown the others.

The sample is bounded by ``max_train_rows`` (hash order of doc_id, so any run takes the same rows); what is
collected to the driver are the buckets of that bounded sample. Scoring is one pass over all texts.

Defined results: null and empty texts have no terms and score as the bias does; labels that are null or lack a document are not
learnt from; with no label of one class every score is the (smoothed) share of label 1; other columns stay;
repeated rows score equal; empty tables give none; texts of any length are read whole; a column named as the new one is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm.packed import Mapped, bounded_batches, make_folder, release, store
from catalogspark.sources.shared import new_path, written

BITS = 20
STEM = 4
#: Texts that a worker looks at at a time.
SLICE = 500
_CUT = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def terms(text: str | None) -> set[bytes]:
    """Words, and behind a caret the first STEM bytes of longer ones, so that inflected forms share a term."""
    words = set((text or "").encode("utf-8", "replace").lower().translate(_CUT).split())
    return words | {b"^" + w[:STEM] for w in words if len(w) > STEM}


def buckets(text: str | None) -> list[int]:
    mask = (1 << BITS) - 1
    return sorted({zlib.crc32(w) & mask for w in terms(text)})


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _buckets(texts: pa.Array) -> pa.Array:
    return pa.array([buckets(t.as_py()) for t in texts], pa.list_(pa.int32()))


@dataclass
class Machine:
    """features: the buckets, sorted; bias, weights and vectors of the machine over them."""

    features: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, vectors) of every bucket; those that were not learnt weigh nothing."""
        w, v = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, self.vectors.shape[1]), np.float32)
        w[self.features], v[self.features] = self.weights, self.vectors
        return w, v


def margins(rows: list[np.ndarray], bias: float, weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """rows: each document's buckets."""
    out = np.full(len(rows), bias)
    for i, r in enumerate(rows):
        if len(r):
            v = vectors[r].astype(float)
            out[i] += weights[r].sum(dtype=float) + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
    return out


def _fit(rows: list[np.ndarray], labels: np.ndarray, pace: np.ndarray, rank: int, epochs: int, seed: int, decay: float) -> tuple:
    """Logistic loss, AdaGrad, one document at a time in a seeded order; pace: each feature's share of the learning rate."""
    rng = np.random.default_rng(seed)
    n = len(pace)
    w, v = np.zeros(n, np.float32), rng.standard_normal((n, rank), np.float32)
    v *= 0.05 * pace[:, None]
    gw, gv = np.full(n, 1e-3, np.float32), np.full((n, rank), 1e-3, np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias, gb = float(np.log(share / (1 - share))), 1e-3
    for epoch in range(epochs):
        rate = 0.3 / (1 + epoch)
        for i in rng.permutation(len(rows)):
            r = rows[i]
            vr = v[r]
            total = vr.sum(0)
            margin = bias + w[r].sum() + 0.5 * ((total**2).sum() - (vr * vr).sum())
            g = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[i]
            gb += g * g
            bias -= rate * g / gb**0.5
            if len(r):
                dw, dv = g + decay * w[r], g * (total - vr) + decay * vr
                gw[r] += dw * dw
                gv[r] += dv * dv
                w[r] -= rate * pace[r] * dw / gw[r] ** 0.5
                v[r] -= rate * pace[r, None] * dv / gv[r] ** 0.5
    return bias, w, v


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 40_000, max_features: int = 1 << BITS, rank: int = 8, epochs: int = 6, seed: int = 7, decay: float = 1e-3, min_z: float = 6.0, max_share: float = 1.0) -> Machine:
    """docs(doc_id, text), labels(doc_id, toxic): the rows to learn from.

    A term learns at the full rate from ``|z| = min_z`` or where every row has it. max_features and max_share leave terms
    out, which the defaults don't.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    # the sample is bounded by max_train_rows, so it may be broadcast
    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = written(seen.select("doc_id", _buckets("text").alias("b"), "toxic"), "toxicity").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    labelled = rows["toxic"].to_numpy().astype(float)
    n, pos = len(labelled), labelled.sum()
    if not pos or pos == n:
        share = (pos + 1) / (n + 2)
        return Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))
    share = pos / n
    of_row = [b for chunk in rows["b"].chunks for b in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1]) if len(chunk)]
    count, marked = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for b, toxic in zip(of_row, labelled, strict=True):  # a row's buckets are distinct
        count[b] += 1
        marked[b] += int(toxic)
    z = np.abs(marked - count * share) / np.sqrt(count * share * (1 - share) + 0.5)
    features = np.flatnonzero((count > 0) & (count <= max_share * n))
    if len(features) > max_features:
        features = np.sort(features[np.lexsort((features, -z[features]))][:max_features])
    where = positions(features)
    pace = np.minimum(1.0, np.maximum((z[features] / min_z) ** 4, count[features] / n)).astype(np.float32)
    at = [(p := where[of_row[i]])[p >= 0] for i in order]
    del rows, of_row, count, marked, z
    bias, w, v = _fit(at, labelled[order], pace, rank, epochs, seed, decay)
    del at
    release()  # the sample's pages go back, the driver has more to do
    return Machine(features, bias, w, v)


def positions(features: np.ndarray) -> np.ndarray:
    """Of each bucket, its position in features, or -1."""
    where = np.full(1 << BITS, -1, np.int32)
    where[features] = np.arange(len(features), dtype=np.int32)
    return where


def score(df: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """Add column ``into``: the likelihood of label 1, from the text alone. Workers map the machine from the shared folder."""
    bounded_batches(df.sparkSession)
    base = make_folder(new_path(df.sparkSession, "toxicity-machine"))
    w, v = machine.dense()
    store(f"{base}/arrays", w, v)
    bias, rank = machine.bias, v.shape[1]
    del w, v
    release()

    @F.arrow_udf(T.DoubleType())
    def _score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = Mapped(base)("arrays")  # read once a task
        weights = raw[: 4 << BITS].view(np.float32)
        vectors = raw[4 << BITS :].view(np.float32).reshape(1 << BITS, rank)
        for texts in batches:
            out = []
            for at in range(0, len(texts), SLICE):
                rows = [np.array(buckets(t.as_py()), np.int64) for t in texts.slice(at, SLICE)]
                out.append(1 / (1 + np.exp(-np.clip(margins(rows, bias, weights, vectors), -30, 30))))
            release()
            yield pa.array(np.concatenate([np.zeros(0), *out]))

    return df.withColumn(into, _score(F.col(text)))
