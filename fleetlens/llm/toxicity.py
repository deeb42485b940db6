"""Toxicity score: a factorization machine over hashed terms.

Besides a weight per term, every term has a short factor vector; the product of two
vectors is the weight of the pair. So an insult beside a mention of a group can weigh
more than both alone, which a sum of single weights cannot say.

The model is fitted on the driver, on at most ``max_rows`` labelled rows, chosen by a
hash of their id; this bound and ``dimensions`` bound its memory. Scoring reads every
text whole, in the tasks. Defined cases: a null or empty text gets the score of the
intercept; a document id with several labels is toxic if one of them says so; a null
label is none; rows without id are never learned from; without any labelled row, or
with labels of one kind only, every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words as W

_SLICE = 1 << 20
#: Words are runs of letters and digits.
_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[0x30:0x3A] = _NOT_WORD[0x41:0x5B] = _NOT_WORD[0x61:0x7B] = _NOT_WORD[0x80:] = False


@dataclass(frozen=True)
class FactorizationMachine:
    intercept: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The margin of each text; its distinct terms are ``terms[first[i]:first[i + 1]]``."""
        linear = _sums(self.weights[terms], first)
        v = self.factors[terms]
        pairs = _sums(v, first) ** 2 - _sums(v * v, first)
        return self.intercept + linear + 0.5 * pairs.sum(axis=1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Besides whole words, their beginnings of so many bytes are terms: inflected forms share them.
_PREFIXES = (4, 6)


def distinct_terms(texts: list[bytes], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, and where each text's begin."""
    found = W.split(texts, _NOT_WORD)
    hashes, docs = [found.hashes], [found.doc]
    for size in _PREFIXES:
        prefix, of_word = W.prefixes(found, size)
        hashes.append(prefix)
        docs.append(found.doc[of_word])
    ids = (np.concatenate(hashes) % np.uint64(dimensions)).astype(np.int64)
    keys = np.unique(np.concatenate(docs) * dimensions + ids)
    first = np.searchsorted(keys, np.arange(len(texts) + 1) * dimensions)
    return keys % dimensions, first


def fit(
    terms: list[np.ndarray],
    labels: np.ndarray,
    dimensions: int,
    n_factors: int = 8,
    epochs: int = 20,
    batch: int = 256,
    rate: float = 0.3,
    shrink: float = 1e-4,
    least_ratio: float = 1.0,
    least_rows: int = 3,
    spread: float = 0.05,
) -> FactorizationMachine:
    """Logistic loss, Adagrad steps over mini-batches.

    A term's value is the log ratio of its smoothed shares among toxic and other rows, so
    that terms seen in few rows start small. Those under ``least_ratio`` say little alone
    but may in a pair: they have a fixed value. Terms in fewer than ``least_rows`` rows,
    from which no pair can be learned, have none.
    """
    rng = np.random.default_rng(7)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    intercept = float(np.log(share / (1 - share)))
    weights = np.zeros(dimensions)
    factors = np.zeros((dimensions, n_factors))
    toxic = np.repeat(labels == 1, [len(t) for t in terms])
    if toxic.all() or not toxic.any():
        return FactorizationMachine(intercept, weights, factors)
    flat = np.concatenate(terms)
    with_term = np.bincount(flat[toxic], minlength=dimensions) + 1.0
    without = np.bincount(flat[~toxic], minlength=dimensions) + 1.0
    value = np.log(with_term / (labels.sum() + 2)) - np.log(without / ((labels == 0).sum() + 2))
    neutral = np.abs(value) < least_ratio
    value[neutral] = 0.5
    value[with_term + without < least_rows + 2] = 0
    used_at_all = value != 0
    terms = [t[used_at_all[t]] for t in terms]
    factors[used_at_all] = rng.normal(0, spread, (int(used_at_all.sum()), n_factors))
    seen_w, seen_v, seen_0 = np.full(dimensions, 1e-2), np.full((dimensions, n_factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            sizes = np.array([len(terms[i]) for i in chosen])
            first = np.concatenate([[0], np.cumsum(sizes)])
            c = np.concatenate([terms[i] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), sizes)
            x = value[c]
            v = factors[c] * x[:, None]
            total = _sums(v, first)
            margin = intercept + _sums(weights[c] * x, first)
            margin += 0.5 * (total**2 - _sums(v * v, first)).sum(axis=1)
            error = (_sigmoid(margin) - labels[chosen]) / len(chosen)
            by_term = np.argsort(c, kind="stable")
            used, starts = np.unique(c[by_term], return_index=True)
            if len(used):
                ends = np.append(starts, len(c))
                push = error[row] * x
                grad_w = _sums(push[by_term], ends) + shrink * weights[used]
                grad_v = _sums((push[:, None] * (total[row] - v))[by_term], ends)
                grad_v += shrink * factors[used]
                seen_w[used] += grad_w**2
                seen_v[used] += grad_v**2
                weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
                factors[used] -= 0.2 * rate * grad_v / np.sqrt(seen_v[used])
            grad_0 = error.sum()
            seen_0 += grad_0**2
            intercept -= rate * grad_0 / np.sqrt(seen_0)
    weights *= value
    factors *= value[:, None]
    return FactorizationMachine(intercept, weights.astype(np.float32), factors.astype(np.float32))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    dimensions: int = 1 << 18,
    label: str = "toxic",
    **settings,
) -> FactorizationMachine:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) name."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    @F.arrow_udf("binary")
    def hashed(column: pa.Array) -> pa.Array:
        out = []
        texts = W.as_bytes(column)
        for a, b in W.slices([len(t) for t in texts], _SLICE):
            terms, first = distinct_terms(texts[a:b], dimensions)
            out += [
                terms[i:j].astype(np.int32).tobytes()
                for i, j in zip(first[:-1], first[1:], strict=True)
            ]
        return pa.array(out, pa.binary())

    # At most max_rows ids, so they fit to every task.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = (
        known.select("doc_id", "label", hashed("text").alias("terms"))
        .orderBy("doc_id", "terms")
        .limit(max_rows)
        .collect()
    )
    return fit(
        [np.frombuffer(r["terms"], dtype=np.int32) for r in rows],
        np.array([r["label"] for r in rows]),
        dimensions,
        **settings,
    )


def score(text: Column, model: FactorizationMachine) -> Column:
    """The probability, as the model has it, that a text is toxic."""
    dimensions = len(model.weights)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        texts = W.as_bytes(column)
        parts = [
            _sigmoid(model.margins(*distinct_terms(texts[a:b], dimensions)))
            for a, b in W.slices([len(t) for t in texts], _SLICE)
        ]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return scored(text)
