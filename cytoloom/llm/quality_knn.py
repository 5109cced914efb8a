"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoloom.llm.shared import BITS, dense, groups, marked_texts, sparse, text_vector

WIDTH = (1 << BITS) + 9


class Model:
    """Latent-semantic vectors of a bounded number of labelled texts, and the map from a text's terms to such a vector."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = 48, style: float = 1.0, seed: int = 0):
        n, terms = len(x), 1 << BITS
        self.y = y.astype(np.float32)
        df = (x[:, :terms] > 0).sum(0)
        self.scale = np.concatenate([np.log((1 + n) / (1 + df)) + 0.05, np.full(WIDTH - terms, style)]).astype(np.float32)
        z = self._scaled(x)
        basis = np.random.default_rng(seed).standard_normal((WIDTH, min(rank, n) + 8)).astype(np.float32)
        for _ in range(4):  # the leading right singular vectors, by subspace iteration
            basis = np.linalg.qr(z.T @ (z @ basis))[0]
        _, _, turn = np.linalg.svd(z @ basis, full_matrices=False)
        self.basis = (basis @ turn.T)[:, : min(rank, n)].astype(np.float32)
        self.known = self._unit(z @ self.basis)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z, terms = x * self.scale, 1 << BITS
        z[:, :terms] /= np.maximum(np.linalg.norm(z[:, :terms], axis=1, keepdims=True), 1e-9)
        return z

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray, k: int, power: float) -> np.ndarray:
        """Share of label 1 among the k nearest by cosine, each weighted by its cosine to the given power."""
        near = self._unit(self._scaled(x) @ self.basis) @ self.known.T
        k = min(k, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6) ** power
        return (weight * self.y[top]).sum(1) / weight.sum(1)


def train(docs: DataFrame, marks: DataFrame, per_label: int = 1024, key: str = "doc_id") -> Model | None:
    """marks: columns key and label (0 or 1). Fits on the texts of a sample of about per_label rows of each label; None without rows."""

    @F.arrow_udf(T.BinaryType())
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([sparse(text_vector(t)) for t in texts.to_pylist()], pa.binary())

    known = marks.select(key, F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    rows = marked_texts(docs, known, per_label, 2 * per_label, key).select("label", vectors("text").alias("v")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, bytes(r.v)))
    return Model(dense([r.v for r in rows], WIDTH), np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model | None, text: str = "text", k: int = 15, power: float = 4.0, block: int = 256) -> DataFrame:
    """Adds `score`, 0 to 1, higher for texts like those labelled 1, to every row, from its whole text.

    A text that is null or has no character but white space gets 0.0; every text gets 0.5 if nothing could be learned. Equal texts
    get equal scores; an input column named score is replaced. Ties among neighbours at the k-th place fall to any of the equal.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            out, begun = np.zeros(len(batch)), 0
            for texts in (part.to_pylist() for part in groups(batch)):
                told = [i for i, t in enumerate(texts) if t is not None and t.strip()]
                for at in range(0, len(told), block):
                    part = told[at : at + block]
                    out[begun + np.array(part)] = 0.5 if m is None else np.clip(m.scores(np.stack([text_vector(texts[i]) for i in part]), k, power), 0, 1)
                begun += len(texts)
            yield pa.array(out)

    return docs.withColumn("score", vote(F.col(text)))
