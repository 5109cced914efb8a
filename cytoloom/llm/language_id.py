"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoloom.llm.shared import BITS, beside, dense, groups, labelled_sample, ngram_counts, sparse

UNDETERMINED = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def _vector(text: str) -> np.ndarray:
    v = np.sqrt(ngram_counts(text.lower(), letters_only=True).astype(np.float32))
    return v / max(1e-9, float(np.linalg.norm(v)))


def code_words(k: int, seed: int = 0) -> np.ndarray:
    """k rows of +1 and -1: every split of the labels into two parts up to five labels, else the best of 64 random codes."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        return np.array([[1, *bits] for bits in itertools.product((1, -1), repeat=k - 1)][1:]).T.astype(float)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    codes = [rng.choice((-1.0, 1.0), size=(k, length)) for _ in range(64)]
    codes = [c for c in codes if (np.abs(c.sum(0)) < k).all()] or codes
    return max(codes, key=lambda c: min((c[a] != c[b]).sum() for a, b in itertools.combinations(range(k), 2)))


class Model:
    """names: the learned languages; codes: their code words; weights, bias: a linear classifier for each bit; trust: the bits' weights."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 1e-4, sharp: float = 12.0):
        self.names, self.codes = names, code_words(len(names))
        bits = self.codes.shape[1]
        self.weights, self.bias, self.trust = np.zeros((1 << BITS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32), np.ones(bits)
        if not bits:
            return
        target, gram = self.codes[y], x @ x.T + 1.0  # logistic regression in the span of the rows; the 1 stands for the bias
        each = 1 / np.bincount(y, minlength=len(names))[y][:, None] / len(names)
        a = before = np.zeros_like(target)
        rate = 4 / max(1e-9, float((gram * each).sum(1).max()))
        for t in range(steps):
            z = a + t / (t + 3) * (a - before)
            pull = each * target / (1 + np.exp(target * (gram @ z) * sharp)) * sharp - ridge * z
            before, a = a, z + rate / sharp**2 * pull * len(y) / each.shape[0]
        f = gram @ a * sharp
        self.weights, self.bias = (x.T @ a * sharp).astype(np.float32), (a.sum(0) * sharp).astype(np.float32)
        wrong = ((f * target <= 0) * each).sum(0)
        self.trust = np.log((1 - wrong + 0.01) / (wrong + 0.01))
        self.trust = np.maximum(self.trust, 0.05) / max(self.trust.max(), 0.05)

    def losses(self, v: np.ndarray) -> np.ndarray:
        """Of each language: the logistic losses of its bits, weighted by how far each bit is to be trusted."""
        f = v @ self.weights + self.bias
        return (np.logaddexp(0, -f[:, None, :] * self.codes[None]) * self.trust).sum(2)

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The index of the nearest code word, its share of exp(-loss), and the lead over the next one's share."""
        if len(self.names) == 1:
            return np.zeros(len(v), int), np.ones(len(v)), np.ones(len(v))
        p = -self.losses(v)
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, axis=1)
        return p.argmax(1), top[:, -1], top[:, -1] - top[:, -2]


def train(df: DataFrame, label: str = "lang", per_label: int = 256, most: int = 4096) -> Model | None:
    """Learns from `text` and `label` of a sample of at most about per_label rows a label and `most` in all; None without such rows."""

    @F.arrow_udf(T.BinaryType())
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([sparse(_vector(t)) for t in texts.to_pylist()], pa.binary())

    known = df.select(F.col("text"), F.col(label).cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    rows = labelled_sample(known, "label", per_label, most).select("label", vectors("text").alias("v")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, bytes(r.v)))
    names = sorted({r.label for r in rows})
    return Model(names, dense([r.v for r in rows], 1 << BITS), np.array([names.index(r.label) for r in rows]))


def identify(docs: DataFrame, model: Model | None, text: str = "text", lead: float = 0.1) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to every row, from its whole text.

    A text that is null or has no letter, and every text if nothing could be learned, gets `und`, 0.0 and false. ambiguous: the two
    nearest code words differ by less than `lead` in score. Repeated rows are each answered alike. Input columns of the result's
    names are replaced; all others, whatever their names, stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            name, score, close = np.full(len(batch), UNDETERMINED, dtype=object), np.zeros(len(batch)), np.zeros(len(batch), dtype=bool)
            begun = 0
            for texts in (part.to_pylist() for part in groups(batch)):
                told = [i for i, t in enumerate(texts) if m is not None and t is not None and any(map(str.isalpha, t))]
                for at in range(0, len(told), 256):
                    part = told[at : at + 256]
                    best, share, ahead = m.decode(np.stack([_vector(texts[i]) for i in part]))
                    rows = begun + np.array(part)
                    name[rows], score[rows], close[rows] = [m.names[k] for k in best], share, ahead < lead
                begun += len(texts)
            yield pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(score), pa.array(close)], names=RESULT.names)

    kept = [c for c in docs.columns if c not in RESULT.names]
    return beside(docs, kept, decide(F.col(text)))
