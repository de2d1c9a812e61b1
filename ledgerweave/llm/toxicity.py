"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are taken as labelled; every other training text is
unlabelled, a mixture in which a share ``prior`` is toxic too.  For a scoring
function f and the sigmoid loss, the risk of calling everything by the sign of f
is estimated without any negative example:

    prior * E_P[loss(f, toxic)]  +  max(0, E_U[loss(f, clean)] - prior * E_P[loss(f, clean)])

(Kiryo, Niu, du Plessis, Sugiyama 2017).  The second part estimates the risk on
clean texts and can't be negative; where a batch makes it so, the step goes the
other way, which keeps the model from fitting the unlabelled texts one by one.

Features are the presence of words and of word beginnings.  They are counted in
Spark over the training texts, and the ``FEATURES`` of most information are kept.
The classifiers (linear, several seeds, averaged) are fitted with numpy on a
bounded sample and applied to every whole text inside Spark tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import Memo, once, with_columns
from ledgerweave.workspace import Workspace

#: Training texts read at most, of each kind.  They are chosen by a hash of their key.
MAX_POSITIVE = 6_000
MAX_UNLABELLED = 18_000
#: Features of the model at most, and the information (nats over the toxic texts) that a feature must bring.
FEATURES = 1_024
LEAST_GAIN = 12.0
#: Class prior where no label says anything about it.
DEFAULT_PRIOR = 0.1

_BUCKETS = 1 << 24
_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5)


def features(chunk: str) -> tuple[int, ...]:
    """Hashed features of what stands between two spaces: its words and how they begin."""
    found = []
    for word in _WORD.findall(chunk.lower()):
        found.append(f"w{word}")
        found += [f"{n}{word[:n]}" for n in _BEGINNINGS if len(word) >= n]
    return tuple(zlib.crc32(f.encode()) % _BUCKETS for f in found)


@dataclass(frozen=True)
class Model:
    """Feature buckets in rising order; a weight per classifier and feature; a bias per classifier."""

    buckets: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def probabilities(self, present: np.ndarray) -> float:
        margins = self.weights[:, present].sum(axis=1) + self.biases
        return float((1 / (1 + np.exp(-margins))).mean())


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(text, positive)``: at most ``MAX_POSITIVE`` toxic texts and ``MAX_UNLABELLED`` of all others.

    ``labels`` holds ``key`` and ``toxic``; nulls and repeated rows in it count once.  Only keys move
    to choose the sample, and the chosen keys, bounded by the two limits, meet the texts in a broadcast.
    """
    toxic = labels.where("toxic = 1").select(key).where(F.col(key).isNotNull()).distinct()
    chance = F.xxhash64(F.col(key), F.lit("toxicity"))
    keys = docs.select(key).where(F.col(key).isNotNull())
    positive = toxic.orderBy(chance, key).limit(MAX_POSITIVE)
    unlabelled = (
        keys.join(toxic, key, "left_anti").distinct().orderBy(chance, key).limit(MAX_UNLABELLED)
    )
    chosen = positive.withColumn("positive", F.lit(True)).union(unlabelled.withColumn("positive", F.lit(False)))
    return docs.select(key, text).join(F.broadcast(chosen), key).select(F.col(text).alias("text"), "positive")


def prior_of(labels: DataFrame) -> float:
    """Share of toxic rows among labelled ones; ``DEFAULT_PRIOR`` without labels of both kinds."""
    n, toxic = labels.select(F.count("toxic"), F.sum("toxic")).first()
    return min(0.9, max(0.001, toxic / n)) if n and toxic and toxic < n else DEFAULT_PRIOR


def _feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = Memo(features)
    for batch in batches:
        for kind, texts in batch.groupby("positive")["text"]:
            found = [_present(text, memo) for text in texts]
            buckets, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"bucket": buckets, "positive": bool(kind), "n": n})


def _chosen_features(rows: DataFrame, positives: int, others: int) -> np.ndarray:
    """The buckets that tell most about being a confirmed toxic text."""
    counts = (
        rows.mapInPandas(_feature_counts, "bucket long, positive boolean, n long")
        .groupBy("bucket")
        .agg(
            F.coalesce(F.sum(F.when(F.col("positive"), F.col("n"))), F.lit(0)).alias("p"),
            F.coalesce(F.sum(F.when(~F.col("positive"), F.col("n"))), F.lit(0)).alias("u"),
        )
        .where("p + u >= 3")
    )
    p, u = (F.col("p") + 0.5) / (positives + 1), (F.col("u") + 0.5) / (others + 1)
    gain = p * F.log(p / u) + (1 - p) * F.log((1 - p) / (1 - u))
    telling = counts.where((p > u) & (positives * gain >= LEAST_GAIN))
    best = telling.orderBy(F.desc(gain), "bucket").limit(FEATURES).select("bucket")
    return np.sort(np.array([r.bucket for r in best.collect()], dtype=np.int64))


def _present(text: str | None, memo: Memo) -> np.ndarray:
    found = set()
    for chunk in set((text or "").split()):
        hit = memo[chunk]
        if hit:
            found.update(hit)
    return np.fromiter(found, dtype=np.int64, count=len(found))


def _memo(buckets: np.ndarray) -> Memo:
    """Positions in the model of a chunk's features; most chunks have none."""
    place = {int(b): i for i, b in enumerate(buckets)}
    return Memo(lambda chunk: tuple(place[b] for b in features(chunk) if b in place))


def non_negative_step(
    w: np.ndarray, b: float, toxic: np.ndarray, unlabelled: np.ndarray, prior: float
) -> tuple[np.ndarray, float, float, float]:
    """Gradient of the corrected risk on one batch: for the weights, for the bias, and both risks.

    Where the risk on clean texts comes out negative, the gradient is that of climbing back.
    """
    s_p, s_u = (1 / (1 + np.exp(-(x @ w + b))) for x in (toxic, unlabelled))
    on_toxic = prior * (1 - s_p).mean()
    on_clean = s_u.mean() - prior * s_p.mean()
    g_p, g_u = s_p * (1 - s_p) / len(s_p), s_u * (1 - s_u) / len(s_u)
    if on_clean >= 0:
        # prior * (1 - s) + (-prior * s) on the toxic side: twice the same slope
        return unlabelled.T @ g_u - 2 * prior * (toxic.T @ g_p), g_u.sum() - 2 * prior * g_p.sum(), on_toxic, on_clean
    return prior * (toxic.T @ g_p) - unlabelled.T @ g_u, prior * g_p.sum() - g_u.sum(), on_toxic, on_clean


def fit_linear(
    toxic: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    seed: int,
    steps: int = 400,
    rate: float = 0.05,
    shrink: float = 3e-3,
) -> tuple[np.ndarray, float]:
    """One classifier by Adam over batches drawn with replacement; weights that earn little shrink to 0."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 0.01, toxic.shape[1]).astype(np.float32), np.float32(-1)
    mean, square = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        p = toxic[rng.integers(0, len(toxic), min(len(toxic), 512))].astype(np.float32)
        u = unlabelled[rng.integers(0, len(unlabelled), min(len(unlabelled), 1536))].astype(np.float32)
        g_w, g_b, _, _ = non_negative_step(w, b, p, u, prior)
        g = np.append(g_w, g_b).astype(np.float32)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        step = (rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - np.float32(rate * shrink), 0)
    return w, b


def fit(ws: Workspace, training: DataFrame, prior: float, classifiers: int = 3) -> Model:
    """Fit on ``(text, positive)``.  Without a toxic or without an unlabelled text the score is 0 for all."""
    rows = ws.write(training.select("text", "positive"), "toxicity", toxic="positive")
    positives = ws.count(rows, "toxic")
    others = ws.rows(rows) - positives
    buckets = _chosen_features(rows, positives, others) if positives and others else np.zeros(0, np.int64)
    if not len(buckets):
        return Model(buckets, np.zeros((1, 0)), np.full(1, -30.0))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _memo(buckets)
        for batch in batches:
            bits = np.zeros((len(batch), len(buckets)), np.uint8)
            for row, text in zip(bits, batch["text"]):
                row[_present(text, memo)] = 1
            packed = pd.Series([r.tobytes() for r in np.packbits(bits, axis=1)], dtype=object)
            yield pd.DataFrame({"positive": batch["positive"], "bits": packed})

    # The rows are bounded by the sample, FEATURES bits each; sorted, so that every run fits the same.
    # Many texts have the same features, or none, so equal rows are counted before they are sorted.
    encoded = rows.mapInPandas(encode, "positive boolean, bits binary").groupBy("positive", "bits").agg(F.count("*").alias("n"))
    encoded = encoded.orderBy("positive", "bits").collect()
    times = [r.n for r in encoded]
    x = np.unpackbits(np.frombuffer(b"".join(r.bits for r in encoded), np.uint8).reshape(len(encoded), -1), axis=1)
    x = np.repeat(x[:, : len(buckets)], times, axis=0)
    p = np.repeat([r.positive for r in encoded], times)
    fitted = [fit_linear(x[p], x[~p], prior, seed) for seed in range(classifiers)]
    return Model(buckets, np.array([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def scorer(model: Model) -> Column:
    """A function from text to score, for use in ``withColumn``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = once(("toxicity", model.buckets.tobytes()), lambda: _memo(model.buckets))
        empty = model.probabilities(np.zeros(0, np.int64))
        for texts in batches:
            present = (_present(text, memo) for text in texts)
            yield pd.Series([model.probabilities(p) if len(p) else empty for p in present], dtype=float)

    return score


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts get the score of a text without any known feature; repeated rows get the
    same score each; an empty table stays empty; columns named like the two results give way.
    """
    scored = with_columns(docs, score=scorer(model)(F.col(text)))
    return with_columns(scored, predicted=(F.col("score") >= threshold).cast("int"))
