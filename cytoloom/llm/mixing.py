"""Mixing to target weights: a classifier's domain posteriors, and document rates fitted by distributed projected gradients."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoloom.llm.shared import BITS, beside, dense, groups, marked_texts, sparse, text_vector, Work

WIDTH = (1 << BITS) + 9


class Model:
    """Multinomial logistic regression over a text's vector; names: the domains."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-3, sharp: float = 8.0):
        self.names, k = names, len(names)
        target, gram = np.eye(k)[y], x @ x.T + 0.1
        a = before = np.zeros((len(x), k))
        rate = 2.0 / max(1e-9, float(np.abs(gram).sum(1).max()))
        for t in range(steps):
            z = a + t / (t + 3) * (a - before)
            before, a = a, z + rate * ((target - self._softmax(gram @ z * sharp)) - ridge * z)
        self.weights, self.bias = (x.T @ a * sharp).astype(np.float32), (0.1 * a.sum(0) * sharp).astype(np.float32)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(x @ self.weights + self.bias)


def train(docs: DataFrame, marks: DataFrame, per_label: int = 256, most: int = 2048, key: str = "doc_id") -> Model | None:
    """marks: columns key and label, the domain. Learns from the texts of a sample of about per_label rows of each domain, `most` in all."""

    @F.arrow_udf(T.BinaryType())
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([sparse(text_vector(t)) for t in texts.to_pylist()], pa.binary())

    rows = marked_texts(docs, marks.select(key, F.col("label").cast("string").alias("label")), per_label, most, key).select("label", vectors("text").alias("v")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, bytes(r.v)))
    names = sorted({r.label for r in rows})
    return Model(names, dense([r.v for r in rows], WIDTH), np.array([names.index(r.label) for r in rows]))


def memberships(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds posterior, an array over model.names that sums to 1, and tokens, the words between white space, from the whole text.

    A null text has no tokens, and like one of white space alone the posterior of an empty vector, which the bias gives."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("posterior array<double>, tokens long")
    def belong(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        k = len(m.names)
        for batch in batches:
            p, tokens = [np.empty((0, k))], []
            for texts in (part.to_pylist() for part in groups(batch)):
                p += [m.posteriors(np.stack([text_vector(t or "") for t in texts[i : i + 256]])) for i in range(0, len(texts), 256)]
                tokens += [len((t or "").split()) for t in texts]
            flat, ends = np.concatenate(p).astype(float).ravel(), np.arange(0, k * len(batch) + 1, k, dtype=np.int32)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, flat), pa.array(tokens, pa.int64())], names=["posterior", "tokens"])

    return beside(docs, [c for c in docs.columns if c not in ("posterior", "tokens")], belong(F.col(text)))


@dataclass
class Fit:
    """What the rates were fitted to. steps: the gradients of the domains, of which each document's rate is a function."""

    targets: np.ndarray
    before: np.ndarray
    after: np.ndarray
    steps: list[tuple[float, np.ndarray]]
    stay: float

    @property
    def missed(self) -> float:
        """By how much the worst domain misses its target, as a share of all tokens."""
        return float(np.abs(self.after - self.targets).max()) / max(float(self.targets.sum()), 1.0) if len(self.targets) else 0.0


def rates(posterior: Column, fit: Fit) -> Column:
    """The documents' rates after all steps, from 1: r <- max(0, r - step * (posterior . g + stay * (r - 1)))."""
    steps, stay = fit.steps, fit.stay

    @F.arrow_udf(T.DoubleType())
    def rate(p: pa.Array) -> pa.Array:
        p_all = p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
        r = np.ones(len(p_all))
        for s, g in steps:
            r = np.maximum(0.0, r - s * (p_all @ g + stay * (r - 1)))
        return pa.array(r)

    return rate(posterior)


def domain_tokens(members: DataFrame, k: int, rate: Column | None = None) -> np.ndarray:
    """Expected tokens of each of k domains: sums of rate * tokens * posterior."""
    n = F.col("tokens").cast("double") * (F.lit(1.0) if rate is None else F.col("rate"))
    df = members.select("posterior", "tokens") if rate is None else members.select("posterior", "tokens", rate.alias("rate"))
    row = df.agg(*[F.sum(n * F.col("posterior")[i]).alias(f"s{i}") for i in range(k)]).first()
    return np.array([row[f"s{i}"] or 0.0 for i in range(k)])


def fit_rates(members: DataFrame, targets: np.ndarray, stay: float = 1e-4, rounds: int = 40, close: float = 1e-4) -> Fit:
    """Least squares: nonnegative rates r that bring the domains' expected tokens, the sums of r * tokens * posterior, to `targets`,
    moving every token's rate from 1 as little as can be. members: columns posterior and tokens.

    Each round is one pass over the documents that sums what the rates of all earlier rounds give each domain; only such sums, one
    number for each domain, reach the driver, and a document's rate is made again from them, so nothing is kept between rounds. The
    gradients are taken in the metric of tokens and scaled by the domains' second moments, which the first pass sums. Ends when every
    domain is within `close` of its target, as a share of all tokens, or after `rounds`.
    """
    k, n = len(targets), F.col("tokens").cast("double")
    of = lambda i: F.col("posterior")[i]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row, moments = members.agg(*[F.sum(n * of(i) * of(j)).alias(f"g{i}_{j}") for i, j in pairs]).first(), np.zeros((k, k))
    for i, j in pairs:
        moments[i, j] = moments[j, i] = row[f"g{i}_{j}"] or 0.0
    sums = domain_tokens(members, k)
    total = max(float(sums.sum()), 1.0)
    lift = np.linalg.inv(moments + 1e-9 * total * np.eye(k))
    fit, now = Fit(np.asarray(targets, float), sums, sums, [], stay), sums
    for _ in range(rounds):
        if float(np.abs(now - fit.targets).max()) <= close * total:
            break
        fit.steps.append((1.0, lift @ (now - fit.targets)))
        now = domain_tokens(members, k, rates(F.col("posterior"), fit))
    fit.after = now
    return fit


def copies(rate: Column, *key: Column, seed: int = 3) -> Column:
    """How often a row goes out: the whole part of its rate, and once more with its broken part's chance, by a hash of the key."""
    chance = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def target_tokens(sums: np.ndarray, weights: np.ndarray, keep: list[int]) -> np.ndarray:
    """Token totals in proportion to `weights`: their sum is that of `sums`, or more if a domain of `keep` would have to lose tokens."""
    w = np.asarray(weights, float) / float(np.sum(weights))
    return w * max([float(sums.sum()), *(float(sums[i] / w[i]) for i in keep if w[i] > 0)])


def mix(docs: DataFrame, model: Model | None, weights: dict[str, float], keep: tuple[str, ...] = (), text: str = "text", key: tuple[str, ...] = ("doc_id",), carry_text: bool = True, miss: float = 0.01) -> DataFrame:
    """Adds domain (the likeliest), posterior, tokens, rate and copies to every row.

    weights: the target share of each domain's tokens; domains without one get none, weights of unknown domains are left out. The
    targets' sum is that of the rows' tokens, or the least more for which no domain of `keep` loses tokens. rate is 0 or more; `copies` is
    its stochastic rounding by a hash of `key`, so equal keys are rounded alike. Without a model, or a weight above 0 for any of its
    domains, or tokens, every rate and copies is 1. Where no rates bring every domain within `miss` of its target, as a share of all tokens (as
    when texts of two domains look alike), the nearest are taken and a warning says how far they are off. The rows are written with their posteriors to the shared folder, so texts are read once.
    """
    if model is None or not any(weights.get(d, 0) > 0 for d in model.names):
        one = {"domain": F.lit(None).cast("string"), "posterior": F.array().cast("array<double>"), "tokens": F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")).cast("long"), "rate": F.lit(1.0), "copies": F.lit(1)}
        df = docs.withColumns(one)
        return df if carry_text else df.drop(text)
    members = memberships(docs, model, text)
    members = Work(docs.sparkSession).table(members if carry_text else members.drop(text), keep=True)
    sums = domain_tokens(members, len(model.names))
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in model.names])
    fit = fit_rates(members, target_tokens(sums, share, [i for i, d in enumerate(model.names) if d in keep]))
    if fit.missed > miss:
        warnings.warn(f"the rates miss a domain's target by {fit.missed:.3f} of all tokens; targets {fit.targets.tolist()}, reached {fit.after.tolist()}", stacklevel=2)
    names = F.array(*map(F.lit, model.names))
    df = members.withColumns({"domain": names[(F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")], "rate": rates(F.col("posterior"), fit)})
    return df.withColumn("copies", copies(F.col("rate"), *map(F.col, key)))
