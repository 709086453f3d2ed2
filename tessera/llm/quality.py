"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts, with an estimated class prior, fit a linear model on surface features by
minimising the non-negative unbiased risk: where the estimated risk on negatives falls below zero, the step goes
against it instead. The class prior is estimated from the same two samples, never from negatives: a classifier of
positives against unlabelled texts is fitted on one half, and the prior is the least ratio, over thresholds of its
score, of the share of the other half's unlabelled texts above to that of its positives, where both are sure enough.
Features are frequencies of character classes and of their pairs, and ratios of repetition.

Defined cases: null reads as the empty text, which is scored like any other; repeated rows are scored alike; an empty
table gives an empty result; without a positive training row all scores are the prior's (0.5); extra columns are
ignored; texts are read whole, however long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, crc_bucket, documents, labels, shingles, short_batches, span_hashes, word_spans

#: The model is fitted on about so many positives and unlabelled texts at most (documented bounds of the sample).
FIT_POSITIVE, FIT_UNLABELLED = 6_000, 12_000
PAIRS = 256
THRESHOLD = 0.5


def _classes() -> np.ndarray:
    """A class for each byte: lower, upper, digit, space, line end, start and rest of other characters, each sign its own."""
    out = np.full(256, 6, np.int64)
    out[128:192] = 7
    for i, c in enumerate(range(33, 127)):
        ch = chr(c)
        out[c] = 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit() else 8 + i % 64
    out[32], out[10], out[:10], out[11:32] = 4, 5, 0, 0
    return out


CLASS = _classes()
SINGLE = 128


def features(text: str | None) -> np.ndarray:
    """A fixed number of surface features, whatever the length."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(SINGLE + PAIRS + 12, np.float32)
    if not len(raw):
        return out
    c = CLASS[raw]
    out[:SINGLE] = np.sqrt(np.bincount(c, minlength=SINGLE)[:SINGLE] / len(c))
    pair = (c[:-1] * 61 + c[1:] * 17 + (c[:-1] == c[1:])) % PAIRS
    out[SINGLE : SINGLE + PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / len(c))
    starts, ends = word_spans(raw)
    n = len(starts)
    if n:
        words = span_hashes(raw, starts, ends)
        size = ends - starts
        _, counts = np.unique(words, return_counts=True)
        five = shingles(words, 5)
        first, last = c[starts], c[ends - 1]
        out[SINGLE + PAIRS :] = [
            np.log1p(n) / 10, size.mean() / 10, size.std() / 10, size.max() / (size.max() + 30),
            len(counts) / n, counts.max() / n, (words[1:] == words[:-1]).mean() if n > 1 else 0, 1 - len(np.unique(five)) / len(five),
            (first == 2).mean(), (last >= 8).mean(), (size <= 2).mean(), np.log1p((raw == 10).sum()) / np.log1p(n),
        ]
    return out


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 60, rate: float = 0.02, damp: float = 1e-4) -> np.ndarray:
    """Weights of a linear model (constant last) of least non-negative risk under the logistic loss; without a prior, of positives against unlabelled."""
    random = np.random.default_rng(7)
    w, m, v, t = np.zeros(positive.shape[1] + 1), 0.0, 0.0, 0
    p, u = (np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1) for x in (positive, unlabelled))
    batch = 512
    steps = max(1, len(u) // batch)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    mean = np.zeros_like(w)
    for epoch in range(epochs):
        for _ in range(steps):
            a, b = p[random.integers(0, len(p), batch)], u[random.integers(0, len(u), batch)]
            za, zb = a @ w, b @ w
            # Means of the loss's gradient: of positives as positive and as negative, and of unlabelled as negative.
            as_positive, as_negative, rest = -(a.T @ sigmoid(-za)) / batch, (a.T @ sigmoid(za)) / batch, (b.T @ sigmoid(zb)) / batch
            if prior is None:
                grad = as_positive + rest + damp * w
            else:
                risk = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
                negative = rest - prior * as_negative
                grad = (prior * as_positive + negative if risk >= 0 else -negative) + damp * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (0.5 ** (epoch * 3 / epochs)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            if epoch >= epochs * 2 // 3:
                mean += w
    return mean / max(1, steps * (epochs - epochs * 2 // 3))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled, from both samples alone, kept off 0 and 1."""
    w = fit_nnpu(positive[::2], unlabelled[::2], None, epochs=20)
    p, u = (np.sort(x[1::2] @ w[:-1]) for x in (positive, unlabelled))
    if not len(p) or not len(u):
        return 0.5
    above = lambda x: 1 - np.searchsorted(x, p, "left") / len(x)
    ours, theirs = above(p), above(u)
    slack = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (p, u))
    best = int(np.argmin((theirs + slack) / ours))
    return float(min(0.99, max(0.01, theirs[best] / ours[best])))


def fit(docs: DataFrame, marks: DataFrame) -> dict:
    """Fit on trusted positives of marks (doc_id, quality) and unlabelled docs; nothing of the samples reaches the driver."""
    marks = marks.select(F.col("doc_id").cast("long"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    good = marks.where("quality = 1")
    good = bounded(good, F.col("doc_id"), FIT_POSITIVE, good.count()).select("doc_id", F.lit(1).alias("trusted"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    short_batches(docs.sparkSession)
    unlabelled = bounded(texts, F.concat(F.lit("u"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), FIT_UNLABELLED, texts.count())
    rows = texts.join(F.broadcast(good), "doc_id").select("text", "trusted").unionByName(unlabelled.select("text", F.lit(0).alias("trusted")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(x).tobytes() for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], ["x", "trusted"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sorted((y, x) for b in batches for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        x = np.stack([np.frombuffer(r, np.float32) for _, r in kept]) if kept else np.zeros((0, 1), np.float32)
        y = np.array([y for y, _ in kept], bool)
        if y.any() and not y.all():
            centre, scale = x[~y].mean(0), x[~y].std(0) + 1e-3
            good, rest = (x[y] - centre) / scale, (x[~y] - centre) / scale
            prior = estimate_prior(good, rest)
            w = fit_nnpu(good, rest, prior)
            model = {"w": (w[:-1] / scale).tolist(), "c": float(w[-1] - (w[:-1] * centre / scale).sum()), "prior": prior}
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)])], ["model"])

    found = rows.mapInArrow(measure, "x binary, trusted int").repartition(1).mapInArrow(train, "model string").collect()
    return json.loads(found[0][0]) if found else {"w": [], "c": 0.0}


def score_documents(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for each row of docs."""
    w, c = np.array(model["w"]), model["c"]
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([float(features(x) @ w) if len(w) else 0.0 for x in b.column(1).to_pylist()]) + c
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), crc_bucket(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held), labels(spark, sf_dir).where(~held))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
